"""Nearest neighbours by inner product: a navigable small-world graph per shard, results merged.

Vectors are dealt to shards of bounded size by a hash of their id. Each shard becomes one row with a
hierarchical graph in flat neighbour arrays: nodes draw a top layer, and in every layer a node links
to a diverse choice of its nearest nodes, of the nodes before it in a random order (the long links
that insertion would have made) and of those that chose it. Inner products turn into distances by
one added coordinate. Searches descend through the layers with a beam, for many queries at once, and
rescore what they find in double precision. Queries are held against all shards in passes of bounded
size; a pass is broadcast, a task merges the best of its shards, and a query's best of all tasks are
merged.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component, and rows
with a null id, take no part; equal vectors are one node that lists its ids; rows that repeat an id
are one candidate, with their best score, and one query, with the smallest vector; ties go to the
smaller id; vectors of different lengths don't meet; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage, unstage
from .projection_dedup import usable

NEIGHBOURS = 20
SHARD_ROWS = 8192
#: Links of a node chosen among its nearest, among the nodes before it, and among those that chose it.
NEAR, EARLY, BACK = 16, 6, 10
CANDIDATES = 40
#: Beam width at the bottom and in the upper layers, and nodes expanded at a time.
BEAM, UPPER_BEAM, STEP = 256, 16, 8
QUERY_BLOCK = 256
#: Bytes of query vectors that are broadcast in one pass.
PASS_BYTES = 16 << 20
SEED = 7


def _diverse(points: np.ndarray, own: np.ndarray, cands: np.ndarray, dists: np.ndarray, most: int) -> np.ndarray:
    """Of candidates in order of distance, those nearer to their node than to any chosen before, and
    then the nearest of the rest: positions (rows, most), -1 where there are none."""
    rows, k = cands.shape
    at = points[np.maximum(cands, 0)]
    norms = (at * at).sum(2)
    between = norms[:, :, None] + norms[:, None, :] - 2 * at @ at.transpose(0, 2, 1)
    valid = (cands >= 0) & np.isfinite(dists)
    chosen = np.zeros((rows, k), bool)
    for j in range(k):
        apart = np.where(chosen[:, :j], between[:, j, :j], np.inf).min(1, initial=np.inf)
        chosen[:, j] = valid[:, j] & (dists[:, j] < apart) & (chosen.sum(1) < most)
    rank = np.where(chosen, 0, np.where(valid, 1, 2)) * k + np.arange(k)
    order = np.argsort(rank, 1)[:, :most]
    return np.where(np.take_along_axis(valid, order, 1), np.take_along_axis(cands, order, 1), -1)


def build_layer(points: np.ndarray) -> np.ndarray:
    """Flat neighbour array (nodes, links) of one layer, by position, -1 where there is none."""
    n = len(points)
    k = min(CANDIDATES, n - 1)
    if k < 1:
        return np.full((n, 1), -1, np.int32)
    norms = (points * points).sum(1)
    near, early = np.full((n, NEAR), -1, np.int64), np.full((n, EARLY), -1, np.int64)
    for a in range(0, n, 512):
        own = np.arange(a, min(a + 512, n))
        d = np.maximum(norms[own, None] + norms[None] - 2 * points[own] @ points.T, 0)
        d[own - a, own] = np.inf
        for late, into in ((False, near), (True, early)):
            seen = np.where(np.arange(n)[None] < own[:, None], d, np.inf) if late else d
            best = np.argpartition(seen, k - 1, 1)[:, :k]
            dist = np.take_along_axis(seen, best, 1)
            order = np.argsort(dist, 1, kind="stable")
            best, dist = np.take_along_axis(best, order, 1), np.take_along_axis(dist, order, 1)
            found = _diverse(points, own, np.where(np.isfinite(dist), best, -1), dist, into.shape[1])
            into[own, : found.shape[1]] = found
    back = np.full((n, BACK), -1, np.int64)
    to, source = np.concatenate([near, early], 1).ravel(), np.repeat(np.arange(n), NEAR + EARLY)
    source, to = source[to >= 0], to[to >= 0]
    dist = ((points[source] - points[to]) ** 2).sum(1)
    order = np.lexsort((dist, to))
    source, to = source[order], to[order]
    place = np.arange(len(to)) - np.searchsorted(to, to)
    back[to[place < BACK], place[place < BACK]] = source[place < BACK]
    links = np.sort(np.concatenate([near, early, back], 1), 1)
    links[:, 1:][links[:, 1:] == links[:, :-1]] = -1
    return links.astype(np.int32)


class Graph:
    """Distinct vectors of a shard, their ids, and per layer its nodes and their links."""

    def __init__(self, vectors: np.ndarray, id_starts: np.ndarray, ids: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.vectors, self.id_starts, self.ids, self.layers = vectors, id_starts, ids, layers

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray) -> Graph:
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        new = np.r_[True, (vectors[1:] != vectors[:-1]).any(1)]
        starts = np.r_[np.flatnonzero(new), len(ids)]
        nodes = vectors[starts[:-1]]
        n = len(nodes)
        shuffled = np.random.default_rng([SEED, n]).permutation(n)
        squares = (nodes * nodes).sum(1)
        points = np.concatenate([nodes, np.sqrt(np.maximum(squares.max() - squares, 0))[:, None]], 1).astype(np.float32)
        layers, size = [], n
        while True:
            members = shuffled[:size]  # a layer's nodes are the first of one random order
            local = build_layer(points[members])
            layers.append((members.astype(np.int32), np.where(local >= 0, members[local], -1).astype(np.int32)))
            if size <= NEAR:
                break
            size = max(1, size // NEAR)
        return cls(nodes, starts.astype(np.int64), ids, layers)

    def descend(self, queries: np.ndarray, beam: int) -> np.ndarray:
        """Positions (queries, beam) of the nodes found, -1 where there are fewer."""
        n = len(self.vectors)
        if n <= beam:
            return np.tile(np.arange(n), (len(queries), 1))
        single = self.vectors.astype(np.float32)
        asked = queries.astype(np.float32)
        entry = np.tile(self.layers[-1][0].astype(np.int64), (len(queries), 1))
        for level in range(len(self.layers) - 1, -1, -1):
            members, links = self.layers[level]
            at = np.full(n, -1, np.int64)
            at[members] = np.arange(len(members))
            entry = _beam(single, asked, at, links, entry, beam if level == 0 else UPPER_BEAM)
        return entry

    def search(self, query_ids: np.ndarray, queries: np.ndarray, most: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, vec id, score) of the best found for each query, its own id left out."""
        found = self.descend(queries, beam)
        row, _ = np.nonzero(found >= 0)
        node = found[found >= 0]
        counts = np.minimum(self.id_starts[node + 1] - self.id_starts[node], most + 1)
        scores = np.einsum("ij,ij->i", queries[row], self.vectors[node])
        row, scores = np.repeat(row, counts), np.repeat(scores, counts)
        ids = self.ids[np.repeat(self.id_starts[node] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
        other = ids != query_ids[row]
        row, ids, scores = row[other], ids[other], scores[other]
        order = np.lexsort((-scores, ids, row))
        row, ids, scores = row[order], ids[order], scores[order]
        first = np.r_[True, (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])][: len(row)]
        row, ids, scores = row[first], ids[first], scores[first]
        order = np.lexsort((ids, -scores, row))
        row, ids, scores = row[order], ids[order], scores[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < most
        return query_ids[row[best]], ids[best], scores[best]


def _beam(vectors: np.ndarray, queries: np.ndarray, at: np.ndarray, links: np.ndarray, entry: np.ndarray, beam: int) -> np.ndarray:
    """Best-first search of one layer for all queries together, STEP nodes of each at a time."""
    rows = np.arange(len(queries))
    seen = np.zeros((len(queries), len(vectors)), bool)
    pool = np.full((len(queries), beam), -1, np.int64)
    score = np.full((len(queries), beam), -np.inf, np.float32)
    fresh = entry
    active, todo = rows, np.zeros((len(queries), beam), bool)
    while len(active):
        fresh = np.sort(fresh, 1)
        fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1
        ok = (fresh >= 0) & ~seen[active[:, None], np.maximum(fresh, 0)]
        r, c = np.nonzero(ok)
        new = fresh[r, c]
        seen[active[r], new] = True
        value = np.full(fresh.shape, -np.inf, np.float32)
        value[r, c] = np.einsum("ij,ij->i", queries[active[r]], vectors[new])
        nodes = np.concatenate([pool[active], np.where(ok, fresh, -1)], 1)
        values = np.concatenate([score[active], value], 1)
        open_ = np.concatenate([todo[active], ok], 1)
        keep = np.argsort(-values, 1, kind="stable")[:, :beam]
        pool[active], score[active] = np.take_along_axis(nodes, keep, 1), np.take_along_axis(values, keep, 1)
        todo[active] = np.take_along_axis(open_, keep, 1)
        active = active[todo[active].any(1)]
        waiting = todo[active]
        turn = waiting & (np.cumsum(waiting, 1) <= STEP)
        todo[active] = waiting & ~turn
        chosen = np.full((len(active), STEP), -1, np.int64)
        r, c = np.nonzero(turn)
        chosen[r, (np.cumsum(turn, 1) - 1)[r, c]] = pool[active[r], c]
        fresh = np.where(chosen[:, :, None] >= 0, links[at[np.maximum(chosen, 0)]], -1).reshape(len(active), STEP * links.shape[1]).astype(np.int64)
    return pool


def build_graphs(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard and vector length, with the graph in flat arrays; vectors (vec_id, embedding)."""
    shards = max(1, math.ceil(vectors.count() / shard_rows))
    schema = "shard int, dim int, vectors binary, id_starts binary, ids binary, members array<binary>, links array<binary>"

    def run(key: tuple, t: pa.Table) -> pa.Table:
        dim = key[1].as_py()
        x = t["embedding"].combine_chunks()
        g = Graph.build(t["vec_id"].to_numpy(), x.flatten().to_numpy().astype(float).reshape(-1, dim))
        row = {"shard": key[0].as_py(), "dim": dim, "vectors": g.vectors.tobytes(), "id_starts": g.id_starts.tobytes(), "ids": g.ids.astype(np.int64).tobytes(), "members": [m.tobytes() for m, _ in g.layers], "links": [x.tobytes() for _, x in g.layers]}
        types = [("shard", pa.int32()), ("dim", pa.int32()), ("vectors", pa.binary()), ("id_starts", pa.binary()), ("ids", pa.binary()), ("members", pa.list_(pa.binary())), ("links", pa.list_(pa.binary()))]
        return pa.Table.from_pylist([row], pa.schema(types))

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).withColumn("dim", F.size("embedding"))
    return stage(dealt.groupBy("shard", "dim").applyInArrow(run, schema), "hnsw-graphs")


def load_graph(row: dict) -> Graph:
    members = [np.frombuffer(m, np.int32) for m in row["members"]]
    links = [np.frombuffer(x, np.int32).reshape(len(m), -1) for m, x in zip(members, row["links"], strict=True)]
    return Graph(np.frombuffer(row["vectors"]).reshape(-1, row["dim"]), np.frombuffer(row["id_starts"], np.int64), np.frombuffer(row["ids"], np.int64), list(zip(members, links, strict=True)))


def merged(one: tuple, other: tuple, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best of two results (query id, vec id, score) for each query; an id found twice counts once."""
    query, ids, scores = (np.concatenate(x) for x in zip(one, other, strict=True))
    order = np.lexsort((-scores, ids, query))
    query, ids, scores = query[order], ids[order], scores[order]
    first = np.r_[True, (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])][: len(query)]
    query, ids, scores = query[first], ids[first], scores[first]
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    kept = np.arange(len(query)) - np.searchsorted(query, query) < most
    return query[kept], ids[kept], scores[kept]


def search_graphs(graphs: DataFrame, queries: DataFrame, neighbours: int = NEIGHBOURS, beam: int = BEAM) -> DataFrame:
    """The best of each shard for each of queries (vec_id, embedding): query_id, vec_id, score."""
    spark = graphs.sparkSession
    asked = stage(queries.select("vec_id", "embedding", F.size("embedding").alias("dim")), "hnsw-queries")
    total = asked.agg(F.sum(8 * (F.col("dim") + 1)).alias("bytes")).first()["bytes"] or 0
    passes = max(1, math.ceil(total / PASS_BYTES))
    shards = max(1, graphs.count())
    found = None
    for number in range(passes):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == number).collect()  # about PASS_BYTES
        by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for dim in {r["dim"] for r in part}:
            mine = sorted((r["vec_id"], r["embedding"]) for r in part if r["dim"] == dim)
            by_dim[dim] = (np.array([i for i, _ in mine], np.int64), np.array([v for _, v in mine], float))
        sent = spark.sparkContext.broadcast(by_dim)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
            for batch in batches:
                for i in range(batch.num_rows):
                    (row,) = batch.slice(i, 1).to_pylist()
                    graph = load_graph(row)
                    ids, vectors = sent.value.get(row["dim"], (np.empty(0, np.int64), None))
                    for a in range(0, len(ids), QUERY_BLOCK):
                        new = graph.search(ids[a : a + QUERY_BLOCK], vectors[a : a + QUERY_BLOCK], neighbours, beam)
                        best[row["dim"], a] = merged(best[row["dim"], a], new, neighbours) if (row["dim"], a) in best else new
            for out in best.values():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["query_id", "vec_id", "score"])

        tasks = max(1, min(shards, 2 * spark.sparkContext.defaultParallelism))  # a task keeps its shards' best together
        best = stage(graphs.repartition(tasks).mapInArrow(run, "query_id long, vec_id long, score double"), "hnsw-found")
        found = best if found is None else found.union(best)
    unstage(asked)
    return found


def nearest(vectors: DataFrame, is_query: Column, neighbours: int = NEIGHBOURS, beam: int = BEAM, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the nearest vectors to the rows (vec_id, embedding) picked."""
    sound = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    graphs = build_graphs(sound, shard_rows)
    queries = sound.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    found = search_graphs(graphs, queries, neighbours, beam)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= neighbours).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest_query(vectors: DataFrame) -> DataFrame:
    return nearest(vectors, F.col("vec_id") % 20 == 0)
