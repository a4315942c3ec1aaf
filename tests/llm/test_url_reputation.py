from pyspark.sql import functions as F

from mixweave.llm import url_reputation as U


def judge(spark, urls, outcomes=()):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    seen = spark.createDataFrame(list(outcomes), "host string, n long, k long")
    return {r["page_id"]: r for r in U.filter_urls(pages, seen).collect()}


def test_rules_and_parts(spark):
    out = judge(spark, ["http://A.Example.ORG/es/x?q#f", "https://example.org/en/12", "http://notexample.org/es/", "http://x.com/fr/1", "http://x.com/de/1", "http://x.net/de/1", None, "no scheme", "x://É.com/fr/", "ftp://org", "http://a.com?x=/fr/", "http://one\n.com/fr/a\nb"])
    assert [out[i]["host"] for i in (0, 6, 7, 8)] == ["a.example.org", "", "", "É.com"]
    assert [out[i]["path"] for i in (0, 6, 10, 11)] == ["/es/x", "", "", "/fr/a\nb"]
    assert [out[i]["rule"] for i in range(12)] == ["example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", None, None, None, "com/fr/", None, None, "com/fr/"]
    assert [out[i]["verdict"] for i in range(5)] == ["block", "block", "allow", "allow", "block"]
    assert {out[i]["verdict"] for i in (5, 6, 7, 9, 10)} == {"allow"}


def test_much_bad_evidence_blocks_and_little_does_not(spark):
    outcomes = [(f"h{i}.good.net", 50, 48) for i in range(20)] + [("bad.evil.net", 200, 4), ("new.fine.net", 1, 0)]
    out = judge(spark, ["http://bad.evil.net/", "http://new.fine.net/", "http://h1.good.net/", "http://never.seen.net/"], outcomes)
    assert [out[i]["verdict"] for i in range(4)] == ["block", "allow", "allow", "allow"]
    assert out[1]["good_mean"] > 0.5 and out[0]["good_upper"] < 0.5


def test_domains_and_suffixes(spark):
    df = spark.createDataFrame([("a.b.co.uk",), ("x.y.example.com",), ("localhost",), ("",)], "host string")
    got = [(r[0], r[1]) for r in df.select(U.host_domain(F.col("host")), U.host_suffix(F.col("host"))).collect()]
    assert got == [("b.co.uk", "co.uk"), ("example.com", "com"), ("localhost", "localhost"), ("", "")]


def test_empty_tables_and_repeated_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.net/1", "x"), (1, "http://a.net/1", "x")], "page_id long, url string, host string")
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert U.url_query(pages, labels).count() == 2
    assert U.url_query(pages.limit(0), labels.limit(0)).count() == 0
    outcomes = U.labelled_outcomes(pages, labels).collect()
    assert [(r["host"], r["n"], r["k"]) for r in outcomes] == [("a.net", 2, 0)]


def test_no_python_runs_in_the_plan(spark, sf_dir):
    pages, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("pages", "labels"))
    plan = U.url_query(pages, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
