"""Near-duplicate embeddings by sorted projection passes.

Vectors with equal label and components form a class, and classes are compared. In each pass,
classes are ordered by label and then by the concatenated signs of random projections; each is
compared with a bounded number of neighbours before it, and what is verified links. Links of all
passes unite to components. As a window bounds partners, all pairs of classes with equal label and
length are then compared exactly in tiles: components that a missed pair joins are united, and links
are counted whole. A tile is a run of the order of one pass; two tiles whose centres are further apart
than their radii and the threshold's angle allow hold no link, and aren't compared.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component, and
those with a null label, link with nothing; equal rows link with each other, also where ids repeat;
a row with a null id takes part, but never names a component, and is not kept; vectors of different
lengths don't link; an empty table gives an empty table; other columns are ignored. Labels may be of
any type that can be grouped, and components of any numeric type; cosines are those of the given
numbers in double precision.

A label of n distinct vectors without any structure costs n * n / 2 comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_dimension, stage, unstage
from .components import connected_components

MIN_COSINE = 0.98
PASSES = 8
BITS = 32
WINDOW = 64
#: Rows of a block of the order, and of a tile that are compared at once.
BLOCK_ROWS = 2048
TILE_ROWS = 512
#: Bytes of a tile's vectors.
TILE_BYTES = 1 << 19
SEED = 20240101


def usable(embedding: Column) -> Column:
    sound = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(embedding.isNotNull() & sound & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array([x.values.to_numpy(zero_copy_only=False) for x in column], float)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by the largest component first so that squares don't vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def with_codes(classes: DataFrame, number: int) -> DataFrame:
    """Add dim and code: the signs of BITS random projections, the first in the highest bit."""
    schema = "cls long, label long, embedding array<double>, dim int, code long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column(2)], np.int32)
            codes = np.zeros(len(sizes), np.int64)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                planes = np.random.default_rng([SEED, number, int(dim)]).standard_normal((int(dim), BITS))
                codes[at] = (_matrix(batch.column(2).take(pa.array(at))) @ planes > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes), pa.array(codes)], names=["cls", "label", "embedding", "dim", "code"])

    return classes.select("cls", "label", "embedding").mapInArrow(run, schema)


def _forest(pairs: np.ndarray, n: int) -> list[int]:
    """Of pairs of positions, those that join two sets."""
    root, used = list(range(n)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, (a, b) in enumerate(pairs.tolist()):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            used.append(i)
    return used


def pass_links(classes: DataFrame, number: int, min_cosine: float, window: int) -> DataFrame:
    """A spanning forest of the links (a, b) that one pass finds in each block of its order."""
    order = with_codes(classes, number).repartitionByRange("label", "dim", "code", "cls").sortWithinPartitions("label", "dim", "code", "cls")
    placed = stage(order.withColumn("at", F.monotonically_increasing_id()), "projection-order")
    part, pos = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = {r["part"]: r["n"] for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # a row per partition
    if not sizes:
        return placed.select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    starts, total = [], 0
    for k in range(max(sizes) + 1):
        starts.append(total)
        total += sizes.get(k, 0)
    offset = F.element_at(F.array(*[F.lit(x) for x in starts]), (part + 1).cast("int"))
    ranked = placed.select("cls", "label", "dim", "embedding", (offset + pos).alias("rank"))
    block = F.floor(F.col("rank") / BLOCK_ROWS)
    again = F.when(F.col("rank") % BLOCK_ROWS >= BLOCK_ROWS - window, F.array(block, block + 1)).otherwise(F.array(block))
    dealt = ranked.withColumn("block", F.explode(again))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("rank")
        cls, label, dim = (t[c].to_numpy() for c in ("cls", "label", "dim"))
        found = [np.empty((0, 2), np.int64)]
        for first in np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (dim[1:] != dim[:-1])]):
            n = int(np.searchsorted(np.r_[(label[first:] != label[first]) | (dim[first:] != dim[first]), True], True))
            x = _unit(_matrix(t["embedding"].slice(first, n).combine_chunks()))
            for d in range(1, min(window, n - 1) + 1):
                near = np.flatnonzero(np.einsum("ij,ij->i", x[d:], x[:-d]) >= min_cosine) + first
                found.append(np.stack([near, near + d], 1))
        pairs = np.concatenate(found)
        pairs = pairs[_forest(pairs, len(cls))]
        return pa.table({"a": cls[pairs[:, 0]], "b": cls[pairs[:, 1]]})

    links = stage(dealt.groupBy("block").applyInArrow(run, "a long, b long"), "projection-links")
    unstage(placed)
    return links


def pack_tiles(members: DataFrame) -> DataFrame:
    """Tiles of classes (cls, label, dim, component, embedding, rows) with equal label and dim, one in a
    row: their scaled vectors, the unit vector of their sum, and the widest angle to it."""
    schema = "label long, dim int, tile long, centre array<double>, radius double, cls array<long>, component array<long>, rows array<long>, vectors array<double>"
    types = [("label", pa.int64()), ("dim", pa.int32()), ("tile", pa.int64()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), *[(c, pa.list_(pa.int64())) for c in ("cls", "component", "rows")], ("vectors", pa.list_(pa.float64()))]

    def tile(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        x = _unit(_matrix(t["embedding"].combine_chunks()))
        middle = x.sum(0)
        centre = middle / max(np.linalg.norm(middle), 1e-300)
        cls = t["cls"].to_numpy()
        out = [[t["label"][0].as_py()], [x.shape[1]], [int(cls[0])], [centre], [float(np.arccos(np.clip((x @ centre).min(), -1, 1)))], *[[t[c].to_numpy()] for c in ("cls", "component", "rows")], [x.ravel()]]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, (_, k) in zip(out, types, strict=True)], names=[n for n, _ in types])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, key = [], 0, None
        for batch in batches:
            label, dim = batch.column("label").to_numpy(), batch.column("dim").to_numpy()
            first = 0
            while first < len(label):
                here = (label[first], dim[first])
                if held and (here != key or count >= max(1, TILE_BYTES // (8 * int(key[1])))):
                    yield tile(held)
                    held, count = [], 0
                key = here
                most = max(1, TILE_BYTES // (8 * int(dim[first]))) - count
                part = (label[first : first + most] == label[first]) & (dim[first : first + most] == dim[first])
                n = len(part) if part.all() else int(np.argmin(part))
                held.append(batch.slice(first, n))
                count, first = count + n, first + n
        if held:
            yield tile(held)

    coded = with_codes(members, 0).select("cls", "code").join(members, "cls")
    order = coded.repartitionByRange("label", "dim", "code", "cls").sortWithinPartitions("label", "dim", "code", "cls")
    return stage(order.select("cls", "label", "dim", "component", "rows", "embedding").mapInArrow(run, schema), "projection-packed")


def compare_all(members: DataFrame, min_cosine: float) -> DataFrame:
    """All pairs of the classes (cls, label, dim, component, embedding, rows) with equal label and dim.

    Rows (a, null, linked): class a links with that many rows of other classes in one pair of tiles;
    rows (a, b, null): components a and b are joined by a link.
    """
    keys = ("label", "dim")
    packed = pack_tiles(members)
    metas = packed.select(*keys, F.col("tile").alias("i"), F.col("centre").alias("x"), F.col("radius").alias("r"))
    others = packed.select(*keys, F.col("tile").alias("j"), F.col("centre").alias("y"), F.col("radius").alias("s"))
    widest = F.acos(F.lit(min_cosine)) + F.col("r") + F.col("s") + 1e-6
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.aggregate(F.zip_with("x", "y", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x))))
    pairs = stage(metas.join(others, [*keys]).where((F.col("i") == F.col("j")) | (F.col("i") < F.col("j")) & (apart <= widest)).select("i", "j"), "projection-tiles")
    asked = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("tile"))
    dealt = asked.join(packed.drop(*keys, "centre", "radius"), "tile")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("tile").combine_chunks()
        same = key[0] == key[1]
        cls, component, rows = ([x.values.to_numpy() for x in t[c]] for c in ("cls", "component", "rows"))
        x = [v.values.to_numpy().reshape(len(c), -1) for v, c in zip(t["vectors"], cls, strict=True)]
        linked = [np.zeros(len(c), np.int64) for c in cls]
        joined = np.empty((0, 2), np.int64)
        for first in range(0, len(cls[0]), TILE_ROWS):
            part = slice(first, first + TILE_ROWS)
            near = x[0][part] @ x[-1].T >= min_cosine
            if same:
                near[np.arange(len(near)), np.arange(first, first + len(near))] = False
            left, right = np.nonzero(near)
            linked[0][part] += np.bincount(left, rows[-1][right], len(near)).astype(np.int64)
            if not same:
                linked[1] += np.bincount(right, rows[0][part][left], len(cls[1])).astype(np.int64)
            pairs = np.stack([component[0][part][left], component[-1][right]], 1)
            joined = np.unique(np.concatenate([joined, pairs[pairs[:, 0] != pairs[:, 1]]]), axis=0)
        names, at = np.unique(joined, return_inverse=True)
        joined = joined[_forest(at.reshape(-1, 2), len(names))]
        cls, linked = np.concatenate(cls), np.concatenate(linked)
        cls, linked = cls[linked > 0], linked[linked > 0]
        a = pa.array(np.concatenate([cls, joined[:, 0]]))
        b = pa.concat_arrays([pa.nulls(len(cls), pa.int64()), pa.array(joined[:, 1])])
        return pa.table({"a": a, "b": b, "linked": pa.concat_arrays([pa.array(linked), pa.nulls(len(joined), pa.int64())])})

    compared = stage(dealt.select("i", "j", "tile", "cls", "component", "rows", "vectors").groupBy("i", "j").applyInArrow(run, "a long, b long, linked long"), "projection-compared")
    unstage(packed)
    return compared


def near_duplicates(vectors: DataFrame, min_cosine: float = MIN_COSINE, passes: int = PASSES, window: int = WINDOW) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors (vec_id, embedding, label)."""
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    # 128 bits of two hash chains name a class; its vectors have equal numbers and labels
    name = F.struct(F.xxhash64("label", "embedding").alias("h"), F.xxhash64(F.lit(SEED), "embedding", "label").alias("g"))
    rows = rows.withColumn("name", F.when(usable(F.col("embedding")) & F.col("label").isNotNull(), name))
    labels = stage(rows.where("name is not null").select("label").distinct().withColumn("label_id", F.monotonically_increasing_id()), "projection-labels")
    grouped = rows.where("name is not null").groupBy("name").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("rows"), F.min("vec_id").alias("first"))
    numbered = join_dimension(grouped.withColumn("cls", F.monotonically_increasing_id()), labels, "label", F.col("cls"))
    classes = stage(numbered.select("name", "cls", F.col("label_id").alias("label"), "embedding", "rows", "first"), "projection-classes")
    links = None
    for number in range(passes):
        found = pass_links(classes, number, min_cosine, window)
        links = found if links is None else links.union(found)
    parts = connected_components(links, "projection").withColumnRenamed("node", "cls")
    members = stage(classes.join(parts, "cls", "left").withColumn("component", F.coalesce("component", "cls")).withColumn("dim", F.size("embedding")), "projection-members")
    compared = compare_all(members, min_cosine)
    merged = connected_components(compared.select("a", "b"), "projection-merged").select(F.col("node").alias("component"), F.col("component").alias("whole"))
    counts = compared.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("linked").alias("linked"))
    counted = members.drop("embedding").join(counts, "cls", "left").withColumn("links", F.coalesce("linked", F.lit(0)) + F.col("rows") - 1).where("links > 0")
    counted = stage(counted.join(merged, "component", "left").select("name", "links", "first", F.coalesce("whole", "component").alias("component")), "projection-counted")
    firsts = counted.groupBy("component").agg(F.min("first").alias("component_first"))
    result = stage(counted.join(stage(firsts, "projection-firsts"), "component").select("name", "links", "component_first"), "projection-result")
    judged = join_dimension(rows.select("vec_id", "name"), result, "name", F.col("vec_id"))
    component = F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("component_first"))
    return judged.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
