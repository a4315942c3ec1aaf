"""Queries over the test tables, each with the SQL that DuckDB answers it with.

Documents stand for a collection: the language is the domain, four characters are a token, and the
criteria q1 to q3 are made from the columns. Events stand for proxy results: a configuration is
user_id % 16 and a benchmark is an event type.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DiscoveryConfig, FilterConfig, MixtureConfig, SearchConfig
from ..functions import columns as C
from ..functions import models
from ..functions.hashing import unit_hash
from ..operators import blending, clusters, discovery, filters, scoring, search, selection
from ..schema import DatasetSchema
from ..sources import results, shards, sinks
from ..sources.staging import staged
from .pipeline import run_pipeline

QUALITY = ("q1", "q2", "q3")
TIERS = 4
CLUSTERS = 16
WEIGHTS = tuple((i + 1) / 136 for i in range(CLUSTERS))
BENCHMARKS = ("click", "login", "purchase", "signup", "view")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_BOUND = """
dom AS (SELECT lang, (row_number() OVER (ORDER BY lang) - 1)::INT AS code FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)),
docs AS (SELECT doc_id, lang, source, n_chars, greatest(coalesce(n_chars, 0) // 4, 1)::BIGINT AS tokens, coalesce(code, -1)::INT AS domain,
         (1 + n_chars % 5)::DOUBLE AS q1, (1 + doc_id % 5)::DOUBLE AS q2, (1 + length(source) % 5)::DOUBLE AS q3
  FROM documents LEFT JOIN dom USING (lang))"""
_TIERED = (
    _BOUND
    + """,
placed AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY (q1 + q2 + q3) / 3, doc_id) AS rn, count(*) OVER (PARTITION BY domain) AS n FROM docs),
tiered AS (SELECT * EXCLUDE (rn, n), (domain * 4 + (rn * 4 - 1) // n)::INT AS cluster_id FROM placed)"""
)
_QUALITY = (
    _TIERED
    + """,
quality AS (SELECT cluster_id, count(*)::BIGINT AS num_docs, sum(q1 + q2 + q3) / (count(*) * 3) AS quality FROM tiered GROUP BY 1),
kept AS (SELECT cluster_id, (row_number() OVER (ORDER BY cluster_id) - 1)::INT AS new_id FROM quality WHERE quality >= 3.0),
pruned AS (SELECT t.* EXCLUDE (cluster_id), coalesce(new_id, -1)::INT AS cluster_id FROM tiered t LEFT JOIN kept USING (cluster_id))"""
)
_WEIGHTS = f"weights AS (SELECT (i)::INT AS cluster_id, (i + 1) / 136.0::DOUBLE AS weight FROM range({CLUSTERS}) r(i))"
_SELECT = (
    _TIERED
    + ", "
    + _WEIGHTS
    + """,
budgeted AS (SELECT t.*, weight, floor(weight * (SELECT sum(tokens) FROM docs)::DOUBLE)::BIGINT AS budget,
    coalesce(sum(tokens) OVER (PARTITION BY cluster_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
    sum(tokens) OVER (PARTITION BY cluster_id)::BIGINT AS cluster_tokens
  FROM tiered t JOIN weights USING (cluster_id)),
selected AS (SELECT * FROM budgeted WHERE before < budget)"""
)
_RESULTS = """
results AS (SELECT (user_id % 16)::BIGINT AS config_id, event_type AS benchmark, avg(value) AS acc, max(value) - avg(value) AS nll FROM events WHERE value IS NOT NULL GROUP BY 1, 2)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents bound to the engine's columns, without their texts."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", "n_chars", C.tokens_from_chars(F.col("n_chars")).alias("tokens"),
        (1 + F.col("n_chars") % 5).cast("double").alias("q1"), (1 + F.col("doc_id") % 5).cast("double").alias("q2"), (1 + F.length("source") % 5).cast("double").alias("q3"),
    )
    return discovery.code_domains(docs, "lang")


def tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.quality_tiers(documents(spark, sf_dir), QUALITY, TIERS)


def labelled(docs: DataFrame, *more: str) -> DataFrame:
    """What selection reads of labelled documents, staged: it is read several times."""
    return staged(docs.select("doc_id", "cluster_id", "tokens", *more), "labelled")


def proxy_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("value is not null")
    return events.groupBy((F.col("user_id") % 16).alias("config_id"), F.col("event_type").alias("benchmark")).agg(F.avg("value").alias("acc"), (F.max("value") - F.avg("value")).alias("nll"))


def six(column: str):
    return F.round(column, 6).alias(column)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# Scans


@query("SELECT doc_id, regexp_extract('shard_' || lpad(doc_id::VARCHAR, 9, '0') || '_v2.parquet', '([0-9]+)', 1)::INT AS shard FROM documents")
def s2_shard_number(spark, sf_dir):
    name = F.concat(F.lit("shard_"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit("_v2.parquet"))
    return table(spark, sf_dir, "documents").select("doc_id", C.shard_number(name).alias("shard"))


@query("SELECT doc_id, lang, (1 + n_chars % 5)::DOUBLE AS q1, n_chars AS char_count, greatest(n_chars // 4, 1)::BIGINT AS tokens FROM documents")
def s3_metadata_scan(spark, sf_dir):
    schema = DatasetSchema.from_dict({"domain_col": "lang", "quality_cols": ["q1"], "text_col": "text", "char_count_col": "n_chars"})
    docs = table(spark, sf_dir, "documents").withColumn("q1", (1 + F.col("n_chars") % 5).cast("double"))
    return shards.scan_metadata(docs, schema)


@query("SELECT p AS position, want AS doc_id, coalesce(text, '') AS text FROM (SELECT page_id AS p, (page_id * 7) % 1500 AS want FROM pages) LEFT JOIN documents ON want = doc_id")
def s8_text_lookup(spark, sf_dir):
    wanted = table(spark, sf_dir, "pages").select(F.col("page_id").alias("position"), ((F.col("page_id") * 7) % 1500).alias("doc_id"))
    return shards.read_texts(table(spark, sf_dir, "documents"), wanted)


@query("WITH t AS (SELECT (max(doc_id) + 1) // 2 AS half FROM documents), w AS (SELECT 2 * doc_id AS p, doc_id AS want FROM documents UNION ALL SELECT 2 * doc_id + 1, doc_id + half FROM documents, t) SELECT p AS position, want AS doc_id, coalesce(text, '') AS text FROM w LEFT JOIN documents ON want = doc_id")
def s8_text_lookup_all(spark, sf_dir):
    """Every id once, and ids from the middle to half beyond the last, so that some repeat and some aren't there."""
    docs = table(spark, sf_dir, "documents")
    half = docs.agg(F.floor((F.max("doc_id") + 1) / 2).alias("half"))
    wants = F.posexplode(F.array(F.col("doc_id"), F.col("doc_id") + F.col("half")))
    wanted = docs.select("doc_id").crossJoin(F.broadcast(half)).select(F.col("doc_id").alias("own"), wants.alias("nth", "doc_id"))
    return shards.read_texts(docs, wanted.select((2 * F.col("own") + F.col("nth")).alias("position"), "doc_id"))


@query("SELECT doc_id, source AS shard_file, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS row_in_file, (SELECT count(*) FROM documents e WHERE e.source < d.source) + row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS global_id FROM documents d WHERE source IS NOT NULL")
def s10_global_index(spark, sf_dir):
    """Sources stand for files; each document's place is counted and routed back to its file."""
    docs = table(spark, sf_dir, "documents").where("source is not null").select("doc_id", F.col("source").alias("shard_file"))
    files = selection.prefix_sum(docs.withColumn("one", F.lit(1)), "one", "shard_file", into="row_in_file").drop("one")
    offsets = shards.shard_offsets(files)
    ided = shards.with_doc_id(files.withColumnRenamed("doc_id", "own_id"), offsets)
    routed = shards.route(ided.select("doc_id"), offsets).withColumnRenamed("doc_id", "global_id")
    return ided.select(F.col("own_id").alias("doc_id"), F.col("doc_id").alias("global_id")).join(routed, "global_id").select("doc_id", "shard_file", F.col("row_in_file").cast("long").alias("row_in_file"), "global_id")


@query("SELECT source AS shard_file, count(*)::BIGINT AS n_rows, (sum(count(*)) OVER (ORDER BY source) - count(*))::BIGINT AS first_row FROM documents WHERE source IS NOT NULL GROUP BY source")
def s12_shard_offsets(spark, sf_dir):
    files = shards.shard_offsets(table(spark, sf_dir, "documents").where("source is not null").select(F.col("source").alias("shard_file")))
    return files.select("shard_file", F.col("rows").alias("n_rows"), F.col("start").alias("first_row"))


@query("SELECT count(*)::BIGINT AS first_rows FROM documents WHERE source = (SELECT min(source) FROM documents)")
def s13_first_shard_rows(spark, sf_dir):
    files = table(spark, sf_dir, "documents").where("source is not null").select(F.col("source").alias("shard_file"))
    return spark.createDataFrame([(shards.first_shard_rows(files),)], "first_rows long")


_CSV = "SELECT event_id AS run, CASE WHEN event_id % 11 = 0 THEN 'STEM' WHEN event_id % 13 = 0 THEN 'CORE' ELSE event_type END || ', 0.5, ' || CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE (event_id % 1000)::VARCHAR || '.25' END || CASE WHEN event_id % 5 = 0 THEN '' ELSE ', ' || (event_id % 10)::VARCHAR END AS line FROM events"


def _csv_lines(spark, sf_dir):
    e = F.col("event_id")
    name = F.when(e % 11 == 0, "STEM").when(e % 13 == 0, "CORE").otherwise(F.col("event_type"))
    acc = F.when(e % 7 == 0, F.lit("n/a")).otherwise(F.concat((e % 1000).cast("string"), F.lit(".25")))
    loss = F.when(e % 5 == 0, F.lit("")).otherwise(F.concat(F.lit(", "), (e % 10).cast("string")))
    return table(spark, sf_dir, "events").select(e.alias("run"), F.concat(name, F.lit(", 0.5, "), acc, loss).alias("value"))


@query(f"WITH lines AS ({_CSV}), parts AS (SELECT run, string_split(line, ',') AS p FROM lines) SELECT run, trim(p[1]) AS task, try_cast(trim(p[3]) AS DOUBLE) AS acc, coalesce(try_cast(trim(p[4]) AS DOUBLE), 0.0) AS nll, trim(p[1]) = 'STEM' AS is_aggregate FROM parts WHERE len(p) >= 3 AND (try_cast(trim(p[3]) AS DOUBLE) IS NOT NULL OR trim(p[1]) = 'STEM') AND trim(p[1]) <> 'CORE'")
def s16_eval_csv(spark, sf_dir):
    return results.parse_eval_csv(_csv_lines(spark, sf_dir))


@query("SELECT event_type AS task, arg_max((event_id % 100) / 128.0::DOUBLE, event_id) AS accuracy, arg_max((event_id % 50) / 64.0::DOUBLE, event_id) AS centered FROM events GROUP BY 1")
def s17_eval_log(spark, sf_dir):
    e = F.col("event_id")
    line = F.concat(F.lit("Evaluating: "), F.col("event_type"), F.lit(" (5-shot, type: mc)... accuracy: "), ((e % 100) / 128.0).cast("decimal(12,8)").cast("string"), F.lit(" | centered: "), ((e % 50) / 64.0).cast("decimal(12,8)").cast("string"), F.lit(" | time: 1.5s"))
    return results.parse_eval_log(table(spark, sf_dir, "events").select(line.alias("value"), e.alias("line_no"))).select("task", "accuracy", "centered")


# Scalar functions


@query("SELECT doc_id, greatest(coalesce(n_chars, 0) // 4, 1)::BIGINT AS tokens, greatest(coalesce(length(text), 0) // 4, 1)::BIGINT AS text_tokens, coalesce(length(text), 0)::BIGINT AS chars FROM documents")
def p1_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.tokens_from_chars(F.col("n_chars")).alias("tokens"), C.tokens_from_text(F.col("text")).alias("text_tokens"), C.char_count(F.col("text")).alias("chars"))


@query("SELECT (sum(n_chars) // 4)::BIGINT AS corpus_tokens, sum(greatest(n_chars // 4, 1))::BIGINT AS document_tokens FROM documents")
def p4_total_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(C.total_tokens(F.col("n_chars")).alias("corpus_tokens"), F.sum(C.tokens_from_chars(F.col("n_chars"))).alias("document_tokens"))


@query(f"WITH {_BOUND} SELECT doc_id, domain FROM docs")
def p6_domain_codes(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", "domain")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE coalesce(value, 0.0) END AS cell FROM events")
def p7_clean_cells(spark, sf_dir):
    value = F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", C.clean(value).alias("cell"))


@query(f"WITH {_BOUND} SELECT doc_id, round((q1 + q2 + q3) / 3, 6) AS mean, q3 >= 2.0 AND (q1 + q2 + q3) / 3 >= 3.0 AS passes FROM docs")
def p9_doc_predicate(spark, sf_dir):
    config = FilterConfig(doc_english_min=2.0, doc_composite_min=3.0)
    return documents(spark, sf_dir).select("doc_id", F.round(C.row_mean([F.col(q) for q in QUALITY]), 6).alias("mean"), filters.passes(QUALITY, config).alias("passes"))


@query("SELECT count(*)::BIGINT AS n FROM events WHERE value IS NOT NULL AND isfinite(value)")
def p11_finite(spark, sf_dir):
    return table(spark, sf_dir, "events").where(C.is_finite(F.col("value"))).agg(F.count("*").alias("n"))


_W = "list_transform([1, 2, 3, 4], lambda k: CASE WHEN vec_id % 10 = 0 THEN 0.0 ELSE ((vec_id % (k + 3)) + 1)::DOUBLE END)"


def _raw_weights():
    return F.array(*[F.when(F.col("vec_id") % 10 == 0, F.lit(0.0)).otherwise((F.col("vec_id") % (k + 3) + 1).cast("double")) for k in range(1, 5)])


@query(f"WITH w AS (SELECT vec_id, {_W} AS raw FROM embeddings), n AS (SELECT vec_id, list_transform(raw, lambda x: CASE WHEN list_sum(raw) < 1e-10 THEN 0.25 ELSE x / list_sum(raw) END) AS w FROM w) SELECT vec_id, round(w[1], 6) AS w1, round(w[4], 6) AS w4, round(list_sum(w), 6) AS total FROM n")
def p12_normalized_weights(spark, sf_dir):
    w = table(spark, sf_dir, "embeddings").select("vec_id", C.normalized_weights(_raw_weights()).alias("w"))
    return w.select("vec_id", F.round(F.get("w", F.lit(0)), 6).alias("w1"), F.round(F.get("w", F.lit(3)), 6).alias("w4"), F.round(C.array_sum(F.col("w")), 6).alias("total"))


@query("SELECT vec_id, 'C2' AS label, (vec_id % 5)::DOUBLE AS weight FROM embeddings")
def p13_weights_by_label(spark, sf_dir):
    labels = F.array(*[F.lit(f"C{i}") for i in range(4)])
    w = F.array(*[(F.col("vec_id") % (i + 3)).cast("double") for i in range(4)])
    return table(spark, sf_dir, "embeddings").select("vec_id", F.lit("C2").alias("label"), F.element_at(C.weights_by_label(labels, w), "C2").alias("weight"))


@query("SELECT vec_id, round_even(vec_id / 128.0::DOUBLE, 4) AS key1 FROM embeddings")
def p14_weights_key(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.get(C.weights_key(F.array(F.col("vec_id") / 128.0)), F.lit(0)).alias("key1"))


@query(f"WITH {_TIERED}, t AS (SELECT cluster_id, sum(tokens)::DOUBLE AS n FROM tiered GROUP BY 1) SELECT cluster_id, round(n / sum(n) OVER () * count(*) OVER (), 6) AS concentration, round(n / sum(n) OVER () * count(*) OVER () * n / sum(n) OVER (), 6) AS alpha FROM t")
def p15_concentration(spark, sf_dir):
    rows = clusters.token_counts(tiered(spark, sf_dir)).orderBy("cluster_id").collect()  # a row per cluster
    sampler = search.DirichletSampler([r["num_tokens"] for r in rows])
    found = zip(rows, sampler.concentration, sampler.concentration * sampler.shares, strict=True)
    return spark.createDataFrame([(r["cluster_id"], float(c), float(a)) for r, c, a in found], "cluster_id int, concentration double, alpha double").select("cluster_id", six("concentration"), six("alpha"))


@query("""
SELECT d::INT AS depth, (((d * 64 + 127) // 128) * 128)::BIGINT AS width,
  (d * 12 * w * w + ((d + 1) // 2) * 12 * (w // 128) + 32768 * w)::BIGINT AS scaling
FROM (SELECT d, ((d * 64 + 127) // 128) * 128 AS w FROM range(4, 30, 2) r(d))
""")
def p16_model_sizes(spark, sf_dir):
    rows = [(d, models.model_width(d), models.scaling_params({"n_layer": d})) for d in range(4, 30, 2)]
    return spark.createDataFrame(rows, "depth int, width long, scaling long")


@query("SELECT d::INT AS depth, greatest(1, floor(d * 1e7 / 500000))::BIGINT AS steps, least(50, greatest(3, ceil(d * 1e6 * (1 - 0.7::DOUBLE) / 0.7::DOUBLE / 500000)))::BIGINT AS shards FROM range(1, 60) r(d)")
def p19_schedules(spark, sf_dir):
    rows = [(d, models.training_iterations(None, float(d), 10_000_000), models.general_shards(d * 1_000_000, 0.7)) for d in range(1, 60)]
    return spark.createDataFrame(rows, "depth int, steps long, shards long")


@query("SELECT n::INT AS samples, least(4, greatest(2, floor(log2(greatest(n / 10.0, 2.0)))::INT + 2)) AS max_depth, greatest(3, least(5, n // 20))::INT AS min_leaf, least(1.0, greatest(0.3, 20.0 / n))::DOUBLE AS column_fraction FROM range(10, 200) r(n)")
def p21_tree_params(spark, sf_dir):
    rows = [(n, *models.tree_params(n, 10), models.column_fraction(n)) for n in range(10, 200)]
    return spark.createDataFrame(rows, "samples int, max_depth int, min_leaf int, column_fraction double")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def p23_norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(C.l2_norm(F.col("embedding")), 6).alias("norm"))


@query("SELECT event_id, printf('%+.4f', event_id / 48.0::DOUBLE - 20) AS shown, trim('  ' || event_type || ' ') AS name, lpad((event_id % 1000)::VARCHAR, 5, '0') AS padded FROM events")
def p25_strings(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", C.signed(e / 48.0 - 20).alias("shown"), F.trim(F.concat(F.lit("  "), "event_type", F.lit(" "))).alias("name"), F.lpad((e % 1000).cast("string"), 5, "0").alias("padded"))


# Clusters


@query(f"WITH {_QUALITY} SELECT cluster_id, num_docs, round(quality, 6) AS quality FROM quality")
def a1_cluster_quality(spark, sf_dir):
    return clusters.cluster_quality(tiered(spark, sf_dir), QUALITY).select("cluster_id", "num_docs", six("quality"))


@query(f"WITH {_TIERED} SELECT cluster_id, count(*)::BIGINT AS num_docs, sum(tokens)::BIGINT AS num_tokens, round(sum(tokens) / count(*), 6) AS avg_tokens, 'C' || cluster_id AS label FROM tiered GROUP BY 1")
def a2_cluster_info(spark, sf_dir):
    return clusters.cluster_info(tiered(spark, sf_dir)).withColumn("avg_tokens", F.round("avg_tokens", 6))


@query(f"WITH {_TIERED}, c AS (SELECT cluster_id, avg(q1) AS q1 FROM tiered WHERE cluster_id % 2 = 0 GROUP BY 1) SELECT t.cluster_id, count(*)::BIGINT AS num_docs, round(coalesce(any_value(c.q1), 0.0), 6) AS first FROM tiered t LEFT JOIN c USING (cluster_id) GROUP BY 1")
def a3_carried_centroids(spark, sf_dir):
    docs = tiered(spark, sf_dir)
    some = discovery.quality_centroids(docs.where("cluster_id % 2 = 0"), QUALITY)
    info = clusters.cluster_info(docs, some)
    return info.select("cluster_id", "num_docs", F.round(F.get("centroid", F.lit(0)), 6).alias("first"))


@query(f"WITH {_TIERED}, c AS (SELECT lang, cluster_id, count(*) AS n FROM tiered GROUP BY 1, 2) SELECT lang, cluster_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, cluster_id) AS rn FROM c) WHERE rn = 1")
def a6_mode(spark, sf_dir):
    return clusters.mode_by(tiered(spark, sf_dir), "lang", "cluster_id")


@query(f"WITH {_TIERED} SELECT cluster_id, round(avg(q1), 6) AS q1, round(avg(q2), 6) AS q2, round(avg(q3), 6) AS q3 FROM tiered GROUP BY 1")
def a8_quality_centroids(spark, sf_dir):
    rows = discovery.quality_centroids(tiered(spark, sf_dir), QUALITY)
    return rows.select("cluster_id", *[F.round(F.get("centroid", F.lit(i)), 6).alias(q) for i, q in enumerate(QUALITY)])


@query(f"""WITH lines AS ({_CSV}), p AS (SELECT run AS line_no, run % 8 AS run, string_split(line, ',') AS p FROM lines),
  r AS (SELECT run, line_no, trim(p[1]) AS task, try_cast(trim(p[3]) AS DOUBLE) AS acc, coalesce(try_cast(trim(p[4]) AS DOUBLE), 0.0) AS nll FROM p WHERE trim(p[1]) <> 'CORE'),
  l AS (SELECT run, task, arg_max(acc, line_no) FILTER (acc IS NOT NULL) AS acc, arg_max(nll, line_no) FILTER (task = 'STEM' OR acc IS NOT NULL) AS nll FROM r WHERE task = 'STEM' OR acc IS NOT NULL GROUP BY 1, 2),
  g AS (SELECT run, max(acc) FILTER (task = 'STEM') AS a, max(nll) FILTER (task = 'STEM') AS n, avg(acc) FILTER (task IN ('click', 'login', 'nowhere')) AS ta, avg(nll) FILTER (task IN ('click', 'login', 'nowhere')) AS tn FROM l GROUP BY 1)
  SELECT run, round(coalesce(a, ta, 0.0), 6) AS acc, round(CASE WHEN coalesce(n, 0.0) <> 0 THEN n ELSE coalesce(tn, 0.0) END, 6) AS nll FROM g""")
def a10_aggregate_metrics(spark, sf_dir):
    """Runs of every eighth line; the validation tasks are two that are there and one that isn't."""
    rows = results.parse_eval_csv(_csv_lines(spark, sf_dir)).withColumn("line_no", F.col("run")).withColumn("run", F.col("run") % 8)
    return results.aggregate_metrics(rows, "run", ["click", "login", "nowhere"]).select("run", six("acc"), six("nll"))


@query("SELECT event_type AS section, round(sum(value), 3) AS total, round(avg(value), 6) AS average, count(*)::BIGINT AS runs FROM events GROUP BY 1")
def a12_timing(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("section"), F.col("value").alias("seconds"))
    return sinks.timing_report(rows).select("section", F.round("total", 3).alias("total"), six("average"), "runs")


@query(f"WITH {_BOUND} SELECT round(1 - sum((q1 - q2) * (q1 - q2)) / (var_pop(q1) * count(*)), 6) AS r2 FROM docs")
def a14_r2(spark, sf_dir):
    return scoring.r2_score(documents(spark, sf_dir), "q1", "q2").select(six("r2"))


@query()
def c2_kmeans_assignment(spark, sf_dir):
    """Vectors by the centroids of a seeded k-means; its numbers are the library's own."""
    vectors = table(spark, sf_dir, "embeddings")
    return clusters.nearest_centroid(vectors, discovery.fit_centroids(vectors, 10, restarts=1)).select("vec_id", "cluster_id", six("score"))


@query(f"WITH c AS (SELECT label, [{', '.join(f'avg(embedding[{i}]::DOUBLE)' for i in range(1, 65))}] AS centroid FROM embeddings WHERE label IS NOT NULL GROUP BY label), s AS (SELECT vec_id, c.label AS cluster_id, list_inner_product(embedding::DOUBLE[], centroid) AS score FROM embeddings, c) SELECT vec_id, cluster_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, cluster_id) AS rn FROM s) WHERE rn = 1")
def j9_nearest_centroid(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    means = [F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(64)]
    centroids = vectors.where("label is not null").groupBy(F.col("label").alias("cluster_id")).agg(F.array(*means).alias("centroid"))
    return clusters.nearest_centroid(vectors.select("vec_id", "embedding"), centroids).select("vec_id", "cluster_id", six("score"))


@query(f"WITH {_QUALITY} SELECT doc_id, cluster_id FROM pruned")
def c5_prune(spark, sf_dir):
    return clusters.prune(tiered(spark, sf_dir), QUALITY, 3.0).select("doc_id", "cluster_id")


@query(f"WITH {_TIERED} SELECT doc_id, cluster_id FROM tiered")
def w3_quality_tiers(spark, sf_dir):
    return tiered(spark, sf_dir).select("doc_id", "cluster_id")


@query()
def c6_merged_clusters(spark, sf_dir):
    docs = clusters.prune(tiered(spark, sf_dir), QUALITY, 2.5, keep_all_if_none=True)
    merged, centroids = clusters.merge_clusters(docs, discovery.quality_centroids(docs, QUALITY), 6)
    return clusters.cluster_info(merged, centroids).withColumn("centroid", F.transform("centroid", lambda x: F.round(x, 5)))


@query()
def c10_quality_discovery(spark, sf_dir):
    config = DiscoveryConfig(k_init=CLUSTERS, k_enhanced=6, prune_threshold=2.5)
    return discovery.QualityClusterDiscovery(config).discover(documents(spark, sf_dir), QUALITY)[0].select("doc_id", "domain", "cluster_id")


@query()
def c8_embedding_discovery(spark, sf_dir):
    docs = documents(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    config = DiscoveryConfig(k_init=8, k_enhanced=4, prune_threshold=0.0, sample_size=400)
    return discovery.EmbeddingClusterDiscovery(config, restarts=1).discover(docs, QUALITY)[0].select("doc_id", "domain", "cluster_id")


_SAMPLED = "sampled AS (SELECT *, doc_id % 4 = 0 AS is_sampled FROM tiered), c AS (SELECT domain, cluster_id, count(*) AS n FROM sampled WHERE is_sampled GROUP BY 1, 2), top AS (SELECT domain, cluster_id AS dominant FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n DESC, cluster_id) AS rn FROM c) WHERE rn = 1)"


@query(f"WITH {_TIERED}, {_SAMPLED} SELECT doc_id, CASE WHEN is_sampled AND cluster_id >= 0 THEN cluster_id ELSE greatest(coalesce(dominant, 0), 0) END::INT AS cluster_id FROM sampled LEFT JOIN top USING (domain)")
def c9_propagation(spark, sf_dir):
    return clusters.propagate(tiered(spark, sf_dir), F.col("doc_id") % 4 == 0).select("doc_id", "cluster_id")


@query(f"WITH {_TIERED} SELECT doc_id, CASE WHEN q3 >= 2.0 AND (q1 + q2 + q3) / 3 >= 3.0 THEN cluster_id ELSE -1 END::INT AS cluster_id FROM tiered")
def f2_doc_filter(spark, sf_dir):
    return filters.DocLevelFilter(FilterConfig(doc_english_min=2.0, doc_composite_min=3.0)).apply(tiered(spark, sf_dir), QUALITY).select("doc_id", "cluster_id")


@query(f"WITH {_QUALITY} SELECT doc_id, cluster_id FROM pruned")
def f3_cluster_filter(spark, sf_dir):
    return filters.ClusterLevelFilter(FilterConfig()).apply(tiered(spark, sf_dir), QUALITY).select("doc_id", "cluster_id")


@query(f"WITH {_TIERED}, f AS (SELECT * EXCLUDE (cluster_id), CASE WHEN q3 >= 2.0 AND (q1 + q2 + q3) / 3 >= 2.5 THEN cluster_id ELSE -1 END AS cluster_id FROM tiered), q AS (SELECT cluster_id FROM f WHERE cluster_id >= 0 GROUP BY 1 HAVING sum(q1 + q2 + q3) / (count(*) * 3) >= 3.0), k AS (SELECT cluster_id, row_number() OVER (ORDER BY cluster_id) - 1 AS new_id FROM q) SELECT doc_id, coalesce(new_id, -1)::INT AS cluster_id FROM f LEFT JOIN k USING (cluster_id)")
def f4_doc_and_cluster_filter(spark, sf_dir):
    config = FilterConfig(doc_english_min=2.0, doc_composite_min=2.5)
    return filters.DocAndClusterFilter(config).apply(tiered(spark, sf_dir), QUALITY).select("doc_id", "cluster_id")


@query(f"WITH {_BOUND}, labelled AS (SELECT d.domain, coalesce(l.quality, 0)::DOUBLE AS quality FROM docs d LEFT JOIN labels l USING (doc_id)) SELECT domain AS cluster_id, count(*)::BIGINT AS num_docs, round(avg(quality), 6) AS quality FROM labelled GROUP BY 1")
def a1_labelled_quality(spark, sf_dir):
    docs = documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("cluster_id", F.col("domain"))
    return clusters.cluster_quality(docs, ["quality"]).select("cluster_id", "num_docs", six("quality"))


# Selection


@query(f"WITH {_SELECT} SELECT doc_id, cluster_id, tokens, round(CASE WHEN budget >= cluster_tokens THEN 1.0 ELSE budget / cluster_tokens::DOUBLE END, 6) AS probability FROM selected")
def d1_select_by_mixture(spark, sf_dir):
    return selection.select_by_mixture(labelled(tiered(spark, sf_dir)), WEIGHTS).select("doc_id", "cluster_id", "tokens", six("probability"))


@query(f"WITH {_TIERED} SELECT doc_id, coalesce(sum(tokens) OVER (PARTITION BY cluster_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM tiered")
def w1_prefix_sum(spark, sf_dir):
    """With ranges of 100 ids, so that the two levels meet also on small tables."""
    return selection.prefix_sum(tiered(spark, sf_dir), "tokens", "cluster_id", range_docs=100).select("doc_id", "before")


_STATS = "o AS (SELECT cluster_id, count(*) AS n, sum(tokens) AS t FROM tiered GROUP BY 1), s AS (SELECT cluster_id, count(*) AS n, sum(tokens) AS t FROM selected GROUP BY 1)"


@query(f"WITH {_SELECT}, {_STATS} SELECT w.cluster_id, round(weight, 6) AS weight, coalesce(o.n, 0)::BIGINT AS original_docs, coalesce(o.t, 0)::BIGINT AS original_tokens, coalesce(s.n, 0)::BIGINT AS selected_docs, coalesce(s.t, 0)::BIGINT AS selected_tokens, round(coalesce(s.n, 0) / greatest(coalesce(o.n, 0), 1), 6) AS ratio FROM weights w LEFT JOIN o USING (cluster_id) LEFT JOIN s USING (cluster_id)")
def d2_mixture_stats(spark, sf_dir):
    docs = labelled(tiered(spark, sf_dir))
    stats = selection.mixture_stats(docs, selection.select_by_mixture(docs, WEIGHTS), WEIGHTS)
    return stats.withColumn("weight", F.round("weight", 6)).withColumn("ratio", F.round("ratio", 6))


@query(f"WITH {_TIERED} SELECT cluster_id, round(count(*) / sum(count(*)) OVER (), 6) AS fraction FROM tiered GROUP BY 1")
def a11_fractions(spark, sf_dir):
    return selection.fractions(clusters.cluster_info(tiered(spark, sf_dir)), "num_docs", "fraction").select("cluster_id", six("fraction"))


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def r3_hash_sample(spark, sf_dir):
    return selection.hash_sample(table(spark, sf_dir, "documents").select("doc_id"), 100)


@query("SELECT doc_id, n_chars FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 250")
def r4_random_baseline(spark, sf_dir):
    return blending.random_baseline(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), 250, seed=7)


# Scores and search


@query(f"""WITH {_RESULTS}, z AS (SELECT config_id, benchmark, (acc - avg(acc) OVER b) / (stddev_pop(acc) OVER b + 1e-12) AS az, -(nll - avg(nll) OVER b) / (stddev_pop(nll) OVER b + 1e-12) AS nz,
  greatest(0.0, least(1.0, greatest(0.0, (1 + 1 - (0.25 / 1000) / (var_pop(acc) OVER b + 1e-12)) / 2))) AS w FROM results WINDOW b AS (PARTITION BY benchmark))
  SELECT config_id, round(sum(w * az + (1 - w) * nz) / 5, 6) AS score FROM z GROUP BY 1""")
def o1_mixture_scores(spark, sf_dir):
    rows = proxy_results(spark, sf_dir)
    names = sorted(r["benchmark"] for r in rows.select("benchmark").distinct().collect())
    return scoring.mixture_scores(rows, rows.select("config_id").distinct(), names, {}).select("config_id", six("score"))


@query(f"""WITH {_RESULTS}, grid AS (SELECT config_id, benchmark FROM (SELECT i::BIGINT AS config_id FROM range(20) r(i)), (SELECT DISTINCT benchmark FROM results))
  SELECT config_id, benchmark, round(coalesce(acc, 0.0), 6) AS acc, round(coalesce(nll, 0.0), 6) AS nll FROM grid LEFT JOIN results USING (config_id, benchmark)""")
def j8_densify(spark, sf_dir):
    rows = proxy_results(spark, sf_dir)
    names = sorted(r["benchmark"] for r in rows.select("benchmark").distinct().collect())
    return scoring.densify(rows, spark.range(20).withColumnRenamed("id", "config_id"), names).select("config_id", "benchmark", six("acc"), six("nll"))


@query(f"WITH {_RESULTS} SELECT benchmark, round(avg(acc), 6) AS mean, round(stddev_pop(acc), 6) AS deviation, round(var_pop(acc), 6) AS variance, arg_min(config_id, (-acc, config_id)) AS best FROM results GROUP BY 1")
def a9_spread(spark, sf_dir):
    return scoring.spread(proxy_results(spark, sf_dir)).select("benchmark", six("mean"), six("deviation"), six("variance"), "best")


@query("WITH pool AS (SELECT round_even(vec_id % 97 / 96.0::DOUBLE, 2) AS key FROM embeddings), tried AS (SELECT DISTINCT round_even(vec_id % 31 / 96.0::DOUBLE, 2) AS key FROM embeddings) SELECT key, count(*)::BIGINT AS n FROM pool WHERE key NOT IN (SELECT key FROM tried) GROUP BY 1")
def j6_novel(spark, sf_dir):
    """Candidates of one weight each that round to none of those tried."""
    ids = np.array([r["vec_id"] for r in table(spark, sf_dir, "embeddings").select("vec_id").collect()])  # a pool of candidates is bounded by configuration
    fresh = search.novel((ids % 97 / 96.0)[:, None], (ids % 31 / 96.0)[:, None], 2)
    return spark.createDataFrame([(float(x),) for x in np.round(fresh[:, 0], 2)], "key double").groupBy("key").agg(F.count("*").alias("n"))


class _FirstWeight(search.Predictor):
    def fit(self, x, y, held_x=None, held_y=None):
        return self

    def predict(self, x):
        return x[:, 0]


@query("SELECT event_id, value FROM events WHERE value IS NOT NULL ORDER BY value, event_id LIMIT 96")
def l2_top_candidates(spark, sf_dir):
    pool = table(spark, sf_dir, "events").where("value is not null").select("event_id", "value")
    return search.top_rows(pool, ["value"], "event_id", _FirstWeight(), 96)


def _search_config():
    return MixtureConfig(search=SearchConfig(configs_per_iter=[15, 8, 4], pool_per_concentration=2000, refine=500), discovery=DiscoveryConfig(k_init=CLUSTERS, k_enhanced=6, prune_threshold=2.5))


@query()
def o5_mixture_search(spark, sf_dir):
    """The dry run's mixture; its results are made up from the ids."""
    tokens = [r["num_tokens"] for r in clusters.token_counts(tiered(spark, sf_dir)).orderBy("cluster_id").collect()]
    best = search.MixtureSearch(_search_config(), tokens).run()
    return spark.createDataFrame([(i, float(w)) for i, w in enumerate(best)], "cluster_id int, weight double").select("cluster_id", six("weight"))


# Joins, sets, sinks


@query(f"WITH {_SELECT} SELECT s.doc_id, d.text FROM selected s JOIN documents d USING (doc_id)")
def j2_selected_texts(spark, sf_dir):
    return selection.selected_texts(selection.select_by_mixture(labelled(tiered(spark, sf_dir)), WEIGHTS), table(spark, sf_dir, "documents"))


@query("WITH a AS (SELECT event_type AS task, round(avg(value), 6) AS x FROM events WHERE user_id % 2 = 0 AND event_type <> 'view' GROUP BY 1), b AS (SELECT event_type AS task, round(avg(value), 6) AS x FROM events WHERE user_id % 2 = 1 AND event_type <> 'click' GROUP BY 1) SELECT task, a.x AS a, b.x AS b, round(a.x - b.x, 6) AS delta FROM a FULL JOIN b USING (task)")
def j7_compare_runs(spark, sf_dir):
    def run(odd: int, without: str):
        e = table(spark, sf_dir, "events").where((F.col("user_id") % 2 == odd) & (F.col("event_type") != without))
        return e.groupBy(F.col("event_type").alias("task")).agg(F.round(F.avg("value"), 6).alias("accuracy"))

    return sinks.compare_runs(run(0, "view"), run(1, "click")).select("task", "a", "b", F.round("delta", 6).alias("delta"))


@query("SELECT task, count(*)::BIGINT AS n FROM (SELECT lang AS task FROM documents UNION ALL SELECT role FROM conversations) GROUP BY 1")
def u1_concatenate(spark, sf_dir):
    both = shards.concatenate(table(spark, sf_dir, "documents").select(F.col("lang").alias("task")), table(spark, sf_dir, "conversations").select("conv_id", F.col("role").alias("task")))
    return both.groupBy("task").agg(F.count("*").alias("n"))


@query("SELECT name FROM (SELECT unnest(['lang', 'quality', 'toxic', 'fluency', 'text', 'n_chars']) AS name) EXCEPT SELECT column_name FROM (DESCRIBE labels)")
def u4_difference(spark, sf_dir):
    """What a schema declares and a table lacks."""
    schema = DatasetSchema.from_dict({"domain_col": "lang", "quality_cols": ["quality", "toxic", "fluency"], "text_col": "text", "char_count_col": "n_chars"})
    return spark.createDataFrame([(c,) for c in schema.missing(table(spark, sf_dir, "labels"))], "name string")


@query("WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, count(*) OVER () AS n FROM documents) SELECT doc_id, (ordinal // 300)::INT AS shard, 'train' AS split FROM o UNION ALL SELECT doc_id, ((n + 299) // 300)::INT, 'val' FROM o WHERE ordinal < greatest(1, n // 100)")
def k2_fixed_size_shards(spark, sf_dir):
    return sinks.plan_shards(table(spark, sf_dir, "documents").select("doc_id"), 300).select("doc_id", "shard", "split")


@query("""
WITH n AS (SELECT (SELECT count(*) FROM documents) AS p, (SELECT count(*) FROM benchmark) AS g),
drawn AS (SELECT i AS position, CASE WHEN ('0x' || substr(md5('42:' || i), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < 0.7 THEN 'primary' ELSE 'general' END AS source FROM range(3000) r(i)),
placed AS (SELECT position, source, (row_number() OVER (PARTITION BY source ORDER BY position) - 1) % CASE source WHEN 'primary' THEN p ELSE g END AS ordinal FROM drawn, n),
texts AS (SELECT 'primary' AS source, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, doc_id, text FROM documents UNION ALL SELECT 'general', row_number() OVER (ORDER BY item_id) - 1, item_id, text FROM benchmark)
SELECT position, source, ordinal, doc_id, text FROM placed JOIN texts USING (source, ordinal)
""")
def m1_blend(spark, sf_dir):
    general = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return blending.blend(table(spark, sf_dir, "documents").select("doc_id", "text"), general, 3000)


@query("""
WITH n AS (SELECT (SELECT count(*) FROM documents) AS p, (SELECT count(*) FROM benchmark) AS g),
drawn AS (SELECT i AS position, CASE WHEN ('0x' || substr(md5('42:' || i), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < 0.7 THEN 'primary' ELSE 'general' END AS source FROM (SELECT unnest(range(2 * p)) AS i FROM n)),
placed AS (SELECT position, source, (row_number() OVER (PARTITION BY source ORDER BY position) - 1) % CASE source WHEN 'primary' THEN p ELSE g END AS ordinal FROM drawn, n),
texts AS (SELECT 'primary' AS source, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, doc_id, text FROM documents UNION ALL SELECT 'general', row_number() OVER (ORDER BY item_id) - 1, item_id, text FROM benchmark)
SELECT position, source, ordinal, doc_id, text FROM placed JOIN texts USING (source, ordinal)
""")
def m1_blend_all(spark, sf_dir):
    """Two rows for each document: at a ratio of 0.7 every document appears and the documents begin anew."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    general = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return blending.blend(docs, general, 2 * docs.count())


@query("SELECT doc_id, ('0x' || substr(md5('42:' || doc_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM documents")
def r6_unit_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", unit_hash(42, F.col("doc_id")).alias("u"))


@query(f"WITH {_QUALITY}, kept_tokens AS (SELECT cluster_id, sum(tokens) AS t FROM pruned WHERE cluster_id >= 0 GROUP BY 1), total AS (SELECT sum(tokens)::DOUBLE AS t FROM docs), k AS (SELECT count(*) AS k FROM kept), p AS (SELECT *, floor((1.0::DOUBLE / (SELECT k FROM k)) * (SELECT t FROM total))::BIGINT AS budget, coalesce(sum(tokens) OVER (PARTITION BY cluster_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pruned WHERE cluster_id >= 0) SELECT cluster_id, count(*)::BIGINT AS original_docs, count(*) FILTER (before < budget)::BIGINT AS selected_docs, coalesce(sum(tokens) FILTER (before < budget), 0)::BIGINT AS selected_tokens FROM p GROUP BY 1")
def mixture_selection_report(spark, sf_dir):
    """The flagship: tiers, pruning, equal weights, budgeted selection and its statistics."""
    docs = labelled(clusters.prune(labelled(tiered(spark, sf_dir), *QUALITY), QUALITY, 3.0))
    k = int(docs.agg(F.max("cluster_id").alias("m")).first()["m"]) + 1
    weights = [1.0 / k] * k
    stats = selection.mixture_stats(docs, selection.select_by_mixture(docs, weights), weights)
    return stats.select("cluster_id", "original_docs", "selected_docs", "selected_tokens")


@query()
def mixture_pipeline(spark, sf_dir):
    """All stages with a dry-run evaluator; the search's mixture decides the selection."""
    run = run_pipeline(documents(spark, sf_dir), QUALITY, _search_config())
    return run.stats.select("cluster_id", six("weight"), "original_docs", "selected_docs", "selected_tokens")
