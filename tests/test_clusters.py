import numpy as np
import pytest
from pyspark.sql import functions as F

from mixweave.config import DiscoveryConfig, FilterConfig
from mixweave.operators import clusters, discovery, filters, selection
from mixweave.operators.clusters import merge_centroids


def docs_of(spark, rows, schema="doc_id long, cluster_id int, tokens long, q1 double"):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize(("budget", "kept"), [(5, 1), (6, 2), (15, 3), (0, 0)])
def test_the_document_that_crosses_the_budget_stays(spark, budget, kept):
    docs = docs_of(spark, [(i, 0, 5, 1.0) for i in range(3)])
    chosen = selection.select_by_mixture(docs, [1.0], budget, fallback=False)
    assert sorted(r["doc_id"] for r in chosen.collect()) == list(range(kept))


def test_budget_counts_documents_in_no_cluster_and_skips_unknown_clusters(spark):
    docs = docs_of(spark, [(0, 0, 4, 1.0), (1, 0, 4, 1.0), (2, -1, 8, 1.0), (3, 7, 4, 1.0)])
    chosen = selection.select_by_mixture(docs, [0.4, 0.6])  # 0.4 of 20 tokens are 8
    assert {r["doc_id"]: r["probability"] for r in chosen.collect()} == {0: 1.0, 1: 1.0}


def test_an_empty_selection_falls_back_to_a_sample(spark):
    docs = docs_of(spark, [(i, -1, 1, 1.0) for i in range(150)])
    assert selection.select_by_mixture(docs, [1.0]).count() == 100


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_prefix_sum_in_two_levels(spark, width):
    rows = [(i * 3, i % 2, i + 1, 1.0) for i in range(20)]
    out = selection.prefix_sum(docs_of(spark, rows), "tokens", "cluster_id", range_docs=width).collect()
    for r in out:
        assert r["before"] == sum(t for i, c, t, _ in rows if c == r["cluster_id"] and i < r["doc_id"])


def test_tiers_are_not_ntile(spark):
    docs = spark.createDataFrame([(i, 0, float(i)) for i in range(5)], "doc_id long, domain int, q1 double")
    tiers = discovery.quality_tiers(docs, ["q1"], 3).orderBy("doc_id").collect()
    assert [r["cluster_id"] for r in tiers] == [0, 0, 1, 1, 2] or [r["cluster_id"] for r in tiers] == [(k * 3 - 1) // 5 for k in range(1, 6)]


def test_dropped_documents_are_not_resurrected(spark):
    rows = [(0, 0, 1, 5.0), (1, 0, 1, 0.0), (2, 1, 1, 2.0)]
    out = filters.DocAndClusterFilter(FilterConfig(doc_composite_min=1.0, cluster_avg_threshold=3.0)).apply(docs_of(spark, rows), ["q1"])
    assert {r["doc_id"]: r["cluster_id"] for r in out.collect()} == {0: 0, 1: -1, 2: -1}


def test_all_zero_quality_is_unjudged(spark):
    out = clusters.cluster_quality(docs_of(spark, [(0, 0, 1, 0.0), (1, 1, 1, None)]), ["q1"]).collect()
    assert [r["quality"] for r in out] == [5.0, 5.0]


def test_when_all_are_pruned_discovery_keeps_and_filters_do_not(spark):
    docs = docs_of(spark, [(0, 0, 1, 1.0), (1, 4, 1, 2.0)])
    assert {r["cluster_id"] for r in clusters.prune(docs, ["q1"], 3.0).collect()} == {-1}
    assert {r["cluster_id"] for r in clusters.prune(docs, ["q1"], 3.0, keep_all_if_none=True).collect()} == {0, 1}


def test_propagation_takes_the_smaller_of_equally_common_clusters(spark):
    docs = spark.createDataFrame([(0, 0, 2), (1, 0, 1), (2, 0, -1), (3, 1, -1)], "doc_id long, domain int, cluster_id int")
    out = clusters.propagate(docs, F.col("doc_id") < 2)
    assert {r["doc_id"]: r["cluster_id"] for r in out.collect()} == {0: 2, 1: 1, 2: 1, 3: 0}


def brute_merge(centroids, docs, target):
    """The method word by word, with a full matrix each time."""
    at, groups = {k: np.array(v, np.float32) for k, v in centroids.items()}, {k: [k] for k in centroids}
    while len(groups) > target:
        names = list(groups)
        x = np.array([at[n] for n in names], float)
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        np.fill_diagonal(d, np.inf)
        i, j = divmod(int(np.argmin(d)), len(names))
        a, b = names[i], names[j]
        mean = (at[a] * docs[a] + at[b] * docs[b]) / (docs[a] + docs[b])
        groups[min(a, b)] = groups.pop(a) + groups.pop(b)
        at[min(a, b)] = np.asarray(mean, np.float32)
    final = {n: i for i, n in enumerate(sorted(groups))}
    return {old: final[n] for n, olds in groups.items() for old in olds}


@pytest.mark.parametrize("seed", range(5))
def test_merging_keeps_order_and_weights(seed):
    rng = np.random.default_rng(seed)
    centroids = {i: rng.normal(size=3).tolist() for i in range(12)}
    docs = {i: int(rng.integers(1, 9)) for i in range(12)}
    ids, merged = merge_centroids(centroids, docs, 4)
    assert ids == brute_merge(centroids, docs, 4) and sorted(merged) == [0, 1, 2, 3]


def test_merging_by_distance_only_without_a_target():
    centroids = {0: [0.0], 1: [1.0], 2: [9.0]}
    assert merge_centroids(centroids, {0: 1, 1: 1, 2: 1}, None, 1.5)[0] == {0: 0, 1: 0, 2: 1}
    assert merge_centroids(centroids, {0: 1, 1: 1, 2: 1}, 1, 1.5)[0] == {0: 0, 1: 0, 2: 0}
    assert merge_centroids({}, {}, 3) == ({}, {})


def test_domains_follow_declared_names(spark):
    docs = spark.createDataFrame([(0, "b"), (1, "a"), (2, None), (3, "z")], "doc_id long, name string")
    declared = discovery.code_domains(docs, "name", ["b", "a"]).orderBy("doc_id").collect()
    assert [r["domain"] for r in declared] == [0, 1, -1, -1]
    found = discovery.code_domains(docs, "name").orderBy("doc_id").collect()
    assert [r["domain"] for r in found] == [1, 0, -1, 2]


def test_quality_discovery_ends_with_the_wanted_clusters(spark):
    docs = spark.createDataFrame([(i, i % 3, i + 1, float(i % 5 + 1)) for i in range(90)], "doc_id long, domain int, tokens long, q1 double")
    out, info = discovery.QualityClusterDiscovery(DiscoveryConfig(k_init=12, k_enhanced=4, prune_threshold=1.5)).discover(docs, ["q1"])
    assert {r["cluster_id"] for r in out.collect()} - {-1} == {0, 1, 2, 3} == {r["cluster_id"] for r in info.collect()}


def test_registries_refuse_unknown_names():
    with pytest.raises(ValueError):
        filters.get_filter(FilterConfig(method="?"))
    with pytest.raises(ValueError):
        discovery.get_discovery(DiscoveryConfig(method="?"))


@pytest.mark.parametrize(("parts", "width"), [(2, 1), (5, 3), (1000, 1 << 16)])
def test_ranks_in_parts(spark, parts, width):
    rows = [(i, i % 2, float(v)) for i, v in enumerate([3, 1, 1, 1, 2, 1, 5, 1, 1, 4, 1, 2, 2, 9, 1, 1, 0, 1])]
    out = selection.ranked(spark.createDataFrame(rows, "doc_id long, g int, v double"), "g", "v", parts=parts, range_docs=width).collect()
    assert len(out) == len(rows)
    for r in out:
        mine = sorted((v, i) for i, g, v in rows if g == r["g"])
        assert (r["rank"], r["group_rows"]) == (mine.index((r["v"], r["doc_id"])) + 1, len(mine))


@pytest.mark.parametrize("n", [0, 1, 37, 500, 9999])
def test_large_samples_equal_small_ones(spark, n, monkeypatch):
    docs = spark.range(500).withColumnRenamed("id", "doc_id")
    by_sort = {r[0] for r in selection.hash_sample(docs, n).collect()}
    monkeypatch.setattr(selection, "TOP_SAMPLE", -1)
    assert {r[0] for r in selection.hash_sample(docs, n).collect()} == by_sort and len(by_sort) == min(n, 500)
