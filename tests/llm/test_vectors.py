import numpy as np
import pytest
from pyspark.sql import functions as F

from mixweave.llm import hnsw
from mixweave.llm import projection_dedup as P

NAN, INF = float("nan"), float("inf")


def frame(spark, rows, extra=False):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label) for i, v, label in rows], "vec_id long, embedding array<float>, label int")
    if extra:
        for name in ("cls", "code", "rows", "component", "kept", "rank", "score", "query_id"):
            df = df.withColumn(name, F.lit("x"))
    return df


def brute_links(rows):
    x = [np.array(v, float) / np.linalg.norm(np.array(v, float)) for _, v, _ in rows]
    root = {i: i for i, _, _ in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = dict.fromkeys(root, 0)
    for a, (i, _, li) in enumerate(rows):
        for b, (j, _, lj) in enumerate(rows[:a]):
            if li == lj and x[a] @ x[b] >= 0.98:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return links, {i: find(i) for i in root}


def clustered(seed, groups=12, size=25, dim=24, labels=3):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        center = rng.normal(size=dim)
        for _ in range(size):
            v = (center + rng.normal(size=dim) * rng.choice([0.0, 0.1, 0.5])).astype(np.float32)
            rows.append((len(rows), v.tolist(), g % labels))
    rng.shuffle(rows)
    return [(int(i), v, int(label)) for i, v, label in rows]


@pytest.mark.parametrize("small", [False, True])
def test_links_equal_all_pairs(spark, small, monkeypatch):
    if small:  # several blocks of the order and tiles of a component
        monkeypatch.setattr(P, "BLOCK_ROWS", 64)
        monkeypatch.setattr(P, "TILE_ROWS", 4)
    rows = clustered(1)
    links, component = brute_links(rows)
    out = {r["vec_id"]: r for r in P.near_duplicates(frame(spark, rows), window=32).collect()}
    assert {i: r["n_links"] for i, r in out.items()} == links
    assert {i: r["component_id"] for i, r in out.items()} == component
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out.values())


def test_pairs_that_no_window_meets(spark, monkeypatch):
    monkeypatch.setattr(P, "TILE_BYTES", 24 * 8 * 30)  # several tiles of a label
    rows = clustered(3)
    links, component = brute_links(rows)
    out = {r["vec_id"]: r for r in P.near_duplicates(frame(spark, rows), passes=1, window=1).collect()}
    assert {i: r["n_links"] for i, r in out.items()} == links
    assert {i: r["component_id"] for i, r in out.items()} == component


def test_text_labels_long_labels_and_doubles(spark):
    near = float(np.cos(np.arccos(0.98) + 1e-9)), float(np.sin(np.arccos(0.98) + 1e-9))  # below the threshold in double, not in single precision
    over = float(np.cos(np.arccos(0.98) - 1e-9)), float(np.sin(np.arccos(0.98) - 1e-9))
    for kind, x, y in (("string", "a", "b"), ("long", 1 << 40, (1 << 40) + (1 << 32)), ("date", __import__("datetime").date(2020, 1, 1), __import__("datetime").date(2021, 1, 1))):
        rows = [(1, [1.0, 0.0], x), (2, list(over), x), (3, [1.0, 0.0], y), (4, list(near), y), (5, [1.0, 0.0], None)]
        out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in P.near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}")).collect()}
        assert out == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5)}


def test_tiles_that_are_apart_are_not_compared(spark, monkeypatch):
    """Tight groups in tiles of their own: most pairs of tiles go, and no link is lost."""
    monkeypatch.setattr(P, "TILE_BYTES", 24 * 8 * 10)
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(8, 24))
    rows = [(i, (centers[i % 8] + 0.02 * rng.normal(size=24)).tolist(), 0) for i in range(400)]
    members = spark.createDataFrame([(i, 0, 24, i, 1, v) for i, v, _ in rows], "cls long, label long, dim int, component long, rows long, embedding array<double>")
    seen = []
    monkeypatch.setattr(P, "stage", lambda df, name, f=P.stage: seen.append((name, f(df, name))) or seen[-1][1])
    linked = {r["a"]: r["n"] for r in P.compare_all(members, 0.98).where("b is null").groupBy("a").agg(F.sum("linked").alias("n")).collect()}
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.98).sum(1) - 1
    assert linked == {i: n for i, n in enumerate(want.tolist()) if n}
    pairs = next(df for name, df in seen if name == "projection-tiles").count()
    assert pairs < 0.4 * 40 * 41 / 2


EDGES = [(1, [1, 0], 0), (2, [1, 0], 0), (3, [1, 0], 1), (4, [1, 0], None), (5, None, 0), (6, [], 0), (7, [0, 0], 0), (8, [NAN, 1], 0), (9, [INF, 1], 0), (10, [None, 1], 0), (11, [1, 0, 0], 0), (12, [1e-30, 0], 0), (None, [1, 0], 0), (20, [0, 1], 1), (20, [0, 1], 1)]


def test_edges_of_dedup(spark):
    out = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in P.near_duplicates(frame(spark, EDGES, extra=True)).collect()), key=str)
    want = [(1, 3, 1, True), (2, 3, 1, False), (12, 3, 1, False), (None, 3, 1, False), (20, 1, 20, True), (20, 1, 20, True)] + [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)]
    assert out == sorted(want, key=str)
    assert P.near_duplicates(frame(spark, EDGES).limit(0)).count() == 0


def brute_nearest(ids, x, wanted, most=20):
    out = {}
    for i in wanted:
        s = x @ x[list(ids).index(i)]
        out[i] = [(ids[k], s[k]) for k in np.lexsort((ids, -s)) if ids[k] != i][:most]
    return out


def test_recall_against_brute_force(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = sorted((r["vec_id"], r["embedding"]) for r in vectors.collect())
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    want = brute_nearest(ids, x, [i for i in ids if i % 20 == 0])
    got = {}
    for r in hnsw.nearest(vectors, vectors["vec_id"] % 20 == 0, shard_rows=1024).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.keys() == want.keys()
    hits = sum(len({v for v, _ in want[q]} & {v for v, _ in got[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    score = {(q, v): s for q in want for v, s in want[q]}
    assert all(abs(s - score.get((q, v), s)) < 1e-12 for q in got for v, s in got[q])


def test_inner_products_of_unequal_lengths_and_copies():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16)) * rng.uniform(0.2, 3, (3000, 1))
    x[500:1500] = x[500]
    ids = np.arange(3000)
    g = hnsw.Graph.build(ids, x)
    assert len(g.vectors) == 2001 and len(g.layers) >= 3
    asked = np.r_[ids[::50], 700]
    q, v, s = g.search(asked, x[asked], 20, 256)
    want = brute_nearest(ids, x, asked.tolist())
    hits = sum(len({b for a, b in zip(q, v) if a == k} & {b for b, _ in want[k]}) for k in asked.tolist())
    assert hits >= 0.9 * 20 * len(asked)


def test_edges_of_search(spark):
    out = hnsw.nearest(frame(spark, EDGES, extra=True), F.col("vec_id") < 3).orderBy("query_id", "rank").collect()
    best = {q: [r["vec_id"] for r in out if r["query_id"] == q] for q in (1, 2)}
    assert best == {1: [2, 3, 4, 12, 20], 2: [1, 3, 4, 12, 20]}
    assert [r["rank"] for r in out if r["query_id"] == 1] == [1, 2, 3, 4, 5]
    assert hnsw.nearest_query(frame(spark, EDGES).limit(0)).count() == 0


def test_passes_of_queries(spark, monkeypatch):
    rows = clustered(2, groups=4, size=30)
    once = hnsw.nearest(frame(spark, rows), F.col("vec_id") % 5 == 0).collect()
    monkeypatch.setattr(hnsw, "PASS_BYTES", 1000)
    again = hnsw.nearest(frame(spark, rows), F.col("vec_id") % 5 == 0).collect()
    assert sorted(once) == sorted(again) and len(once) == 24 * 20
