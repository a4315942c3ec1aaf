"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bottomk_dedup import dedup_query
from .common import table
from .hnsw import nearest_query
from .html_density import html_query
from .mixing import MIXING_SQL, mixing_query
from .piece_table import pieces_query
from .projection_dedup import near_duplicates
from .secret_worklist import secrets_query
from .url_reputation import URL_SQL, url_query
from .warc_merge import WARC_SQL, warc_query
from .weak_quality import quality_query


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_query(table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_query(table(spark, sf_dir, "documents"))


def op3_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_query(table(spark, sf_dir, "pages"))


def op4_warc_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_query(table(spark, sf_dir, "pages"))


def op5_secret_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_query(table(spark, sf_dir, "documents"))


def op6_bottomk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_query(table(spark, sf_dir, "documents"))


def op7_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_query(table(spark, sf_dir, "embeddings"))


def op8_piece_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_query(table(spark, sf_dir, "documents"), piece_model())


def op9_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_query(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op10_projection_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_weak_quality, op2_source_mixing, op3_html_density, op4_warc_merge, op5_secret_worklist, op6_bottomk_dedup, op7_hnsw, op8_piece_table, op9_url_reputation, op10_projection_dedup)}
ORACLES: dict[str, str] = {"op2_source_mixing": MIXING_SQL, "op4_warc_merge": WARC_SQL, "op9_url_reputation": URL_SQL}
