from pyspark.sql import functions as F

from mixweave.llm import common, mixing


def brute_targets(sizes):
    """Shares by weight, capped at twice the size, the excess reshared until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    return target


def test_targets_equal_resharing_step_by_step(spark):
    for sizes in ({f"s{i}": 10_000 + i * i % 17 for i in range(7)}, {"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 1000, "c": 7, None: 300}, {"x": 5}, {"a": 0, "b": 0}, {"a": 1, "b": 10**6, "c": 3, "d": 50, "e": 2}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_edges(docs_of, edges):
    docs = docs_of(edges, extra=True)
    planned = mixing.plan_mix(docs)
    rows = planned.collect()
    assert len(rows) == len(edges) and all(0 <= r["copies"] <= 2 for r in rows)
    sizes = {r["doc_id"]: r["size"] for r in rows}
    assert sizes[2] == sizes[3] == sizes[5] == 0 and sizes[6] == 40_000
    twice = [r["copies"] for r in rows if r["doc_id"] == 1]
    assert twice[0] == twice[1]  # repeated rows draw alike
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in rows)
    assert mixing.plan_mix(docs.limit(0)).count() == 0


def test_words_taken_come_near_the_targets_and_reruns_agree(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"))
    take = lambda: mixing.plan_mix(docs).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("t"), F.first("target").alias("w")).orderBy("source").collect()
    first = take()
    assert first == take()
    assert all(abs(r["t"] - r["w"]) < 0.1 * r["w"] for r in first)


def test_the_join_without_broadcast_gives_the_same(docs_of, edges, monkeypatch):
    with_broadcast = sorted(map(str, mixing.mixing_query(docs_of(edges)).collect()))
    monkeypatch.setattr(common, "fits_broadcast", lambda df: False)
    assert sorted(map(str, mixing.mixing_query(docs_of(edges)).collect())) == with_broadcast
