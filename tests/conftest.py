from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


def plain(value):
    """A value as both engines show it."""
    if isinstance(value, bool) or value is None:
        return (0, str(value))
    if isinstance(value, (int, float)):
        return (1, float(f"{value:.9g}"))
    if isinstance(value, (list, tuple)):
        return (2, tuple(plain(v) for v in value))
    return (3, str(value))


@pytest.fixture(scope="session")
def same_rows(spark, sf_dir):
    """Compare a query with its SQL: columns by name, rows in any order."""
    import duckdb

    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")

    def check(query, sql):
        df = query(spark, sf_dir)
        columns = sorted(df.columns)
        mine = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
        found = db.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        theirs = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
        assert mine == theirs

    return check
