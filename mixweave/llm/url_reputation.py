"""URL filter by empirical-Bayes host reputation, with DataFrame functions only.

Labelled outcomes of pages are counted by host. Beta-binomial priors shrink them on the way from
suffix to registered domain to host; how strongly is estimated from the data at each level. A host
is blocked if the upper posterior bound of its share of good pages stays below a threshold, so
that little evidence never blocks.

Defined results: a null url, or one without "://", has an empty host and path and is judged by the
corpus prior; null or repeated labels of a document count as its worst one; without any outcome all
hosts are allowed; repeated rows each get a row; other columns are ignored. A rule as long as another
that fits goes first in RULES. Urls of any length are taken whole; an empty url is one without "://".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_dimension, stage

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: A suffix has two labels if the last is a country's (two letters) and the other one of these kinds of
#: registrant; any other suffix is the last label. Private suffixes (hosters) don't count.
KINDS = ("ac", "co", "com", "ed", "edu", "firm", "gen", "go", "gob", "gouv", "gov", "govt", "gv", "id", "ind", "info", "lg", "ltd", "mil", "muni", "ne", "net", "nhs", "nom", "or", "org", "plc", "police", "sch", "school", "web")
TWO_LABELS = rf"^(?:{'|'.join(KINDS)})\.[a-z][a-z]$"
MIN_GOOD = 0.5
Z = 1.6448536269514722
#: Bounds of a prior's weight in pages; the lower one also makes up for a host counting in its domain.
STRENGTH = (5.0, 1000.0)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def host_suffix(host: Column, two_labels: str = TWO_LABELS) -> Column:
    last2 = F.substring_index(host, ".", -2)
    return F.when(last2.rlike(two_labels), last2).otherwise(F.substring_index(host, ".", -1))


def host_domain(host: Column, two_labels: str = TWO_LABELS) -> Column:
    last2 = F.substring_index(host, ".", -2)
    return F.when(last2.rlike(two_labels), F.substring_index(host, ".", -3)).otherwise(last2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as (rule, verdict); nulls where none does."""
    rule = verdict = F.lit(None).cast("string")
    for rhost, rpath, rverdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rhost) | F.endswith(host, F.lit("." + rhost))) & F.startswith(path, F.lit(rpath))
        rule = F.when(fits, F.lit(rhost + rpath)).otherwise(rule)
        verdict = F.when(fits, F.lit(rverdict)).otherwise(verdict)
    return rule, verdict


def prior_strength(level: DataFrame, bounds=STRENGTH) -> float:
    """Pseudo-count of a level's beta prior by the moments of its groups (n, k): one row of sums."""
    s = level.where("n > 0").agg(
        F.count("*").alias("g"), F.sum("n").alias("n"), F.sum("k").alias("k"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"), F.sum(F.col("k").cast("double") * F.col("k") / F.col("n")).alias("kkn"),
    ).first()
    low, high = bounds
    if not s["n"]:
        return high
    p = s["k"] / s["n"]
    room = s["n"] - s["nn"] / s["n"] - (s["g"] - 1)
    if p * (1 - p) == 0 or room <= 0:
        return high
    rho = (s["kkn"] - s["k"] * p - (s["g"] - 1) * p * (1 - p)) / (p * (1 - p) * room)
    return high if rho <= 1 / (1 + high) else max(low, (1 - rho) / rho)


def host_reputation(hosts: DataFrame, min_good: float = MIN_GOOD, z: float = Z) -> DataFrame:
    """Posterior of each host from a staged frame (host, n, k), a row per host.

    Returns host, n, k, mean, upper, verdict.
    """
    hosts = hosts.withColumn("domain", host_domain(F.col("host"))).withColumn("suffix", host_suffix(F.col("host")))
    domains = stage(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "url-domains")
    suffixes = stage(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "url-suffixes")
    every = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    top = (every["k"] + 1) / (every["n"] + 1) if every["n"] else 1.0
    m_suffix, m_domain, m_host = (prior_strength(x) for x in (suffixes, domains, hosts))
    shrunk = lambda k, n, prior, m: (k + prior * m) / (n + F.lit(m))
    of_suffix = stage(suffixes.select("suffix", shrunk(F.col("k"), F.col("n"), F.lit(top), m_suffix).alias("suffix_mean")), "url-suffix-means")
    joined = join_dimension(domains, of_suffix, "suffix", F.col("domain"))
    of_domain = stage(joined.select("domain", shrunk(F.col("k"), F.col("n"), F.col("suffix_mean"), m_domain).alias("domain_mean")), "url-domain-means")
    judged = join_dimension(hosts, of_domain, "domain", F.col("host"))
    mean = shrunk(F.col("k"), F.col("n"), F.col("domain_mean"), m_host)
    judged = judged.withColumn("mean", mean).withColumn("upper", F.col("mean") + z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.lit(m_host) + 1)))
    return judged.select("host", "n", "k", "mean", "upper", F.when(F.col("upper") < min_good, F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, min_good: float = MIN_GOOD, z: float = Z) -> DataFrame:
    """Judge pages (page_id, url) by rules, then by the reputation from outcomes (host, n, k).

    outcomes may hold a host several times. Returns page_id, host, path, rule, verdict and the
    host's mean and upper bound.
    """
    urls = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    zero = F.lit(0).cast("long")
    seen = urls.select("host", zero.alias("n"), zero.alias("k")).union(outcomes.select("host", F.col("n").cast("long"), F.col("k").cast("long")))
    hosts = stage(seen.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "url-hosts")
    reputation = stage(host_reputation(hosts, min_good, z).select("host", "mean", "upper", F.col("verdict").alias("by_host")), "url-reputation")
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    judged = join_dimension(urls, reputation, "host", F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("path")))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, F.col("by_host")).alias("verdict"), F.col("mean").alias("good_mean"), F.col("upper").alias("good_upper"))


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcomes (host, n, k) of pages whose path ends in the number of a labelled document.

    Good is quality 1 and toxic 0. Pages are counted by host and document before they are joined.
    """
    urls = pages.select(url_host(F.col("url")).alias("host"), F.regexp_extract(url_path(F.col("url")), r"/(\d+)(?:\.html)?/?$", 1).alias("number"))
    counted = urls.where("number <> ''").groupBy("host", F.col("number").try_cast("long").alias("doc")).agg(F.count("*").alias("pages"))
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")
    worst = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("doc")).agg(F.min(F.coalesce(good, F.lit(0))).alias("good"))
    return counted.join(worst, "doc").groupBy("host").agg(F.sum("pages").alias("n"), F.sum(F.col("pages") * F.col("good")).alias("k"))


def url_query(pages: DataFrame, labels: DataFrame) -> DataFrame:
    return filter_urls(pages, labelled_outcomes(pages, labels)).select("page_id", "host", "path", "rule", "verdict")


_SHRINK = "(k + {prior} * {m}) / (n + {m})"
_STRENGTH = """
  SELECT CASE WHEN coalesce(sum(n), 0) = 0 THEN 1000.0
    WHEN (sum(k)/sum(n)::DOUBLE) * (1 - sum(k)/sum(n)::DOUBLE) = 0 OR sum(n) - sum(n*n)/sum(n)::DOUBLE - (count(*) - 1) <= 0 THEN 1000.0
    ELSE greatest(5.0, least(1000.0, (1 - greatest(rho, 1/1001.0)) / greatest(rho, 1/1001.0))) END AS m
  FROM (SELECT *, (sum(k*k/n::DOUBLE) OVER () - sum(k) OVER () * (sum(k) OVER () / sum(n) OVER ()::DOUBLE) - (count(*) OVER () - 1) * (sum(k) OVER () / sum(n) OVER ()::DOUBLE) * (1 - sum(k) OVER () / sum(n) OVER ()::DOUBLE))
     / nullif((sum(k) OVER () / sum(n) OVER ()::DOUBLE) * (1 - sum(k) OVER () / sum(n) OVER ()::DOUBLE) * (sum(n) OVER () - sum(n*n) OVER () / sum(n) OVER ()::DOUBLE - (count(*) OVER () - 1)), 0) AS rho
    FROM {level} WHERE n > 0) GROUP BY rho
  UNION ALL SELECT 1000.0 WHERE NOT EXISTS (SELECT 1 FROM {level} WHERE n > 0)
"""
_LAST2 = "array_to_string(string_split(host, '.')[-2:], '.')"
_FITS = "((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
_LONGEST = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
URL_SQL = rf"""
WITH urls AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), worst AS (
  SELECT doc_id AS doc, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good FROM labels WHERE doc_id IS NOT NULL GROUP BY 1
), outcomes AS (
  SELECT host, count(*) AS n, sum(good) AS k
  FROM (SELECT host, try_cast(regexp_extract(path, '/(\d+)(?:\.html)?/?$', 1) AS BIGINT) AS doc FROM urls) JOIN worst USING (doc) GROUP BY host
), hosts AS (
  SELECT host, coalesce(n, 0) AS n, coalesce(k, 0) AS k,
         CASE WHEN regexp_matches({_LAST2}, '{TWO_LABELS}') THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE {_LAST2} END AS domain,
         CASE WHEN regexp_matches({_LAST2}, '{TWO_LABELS}') THEN {_LAST2} ELSE string_split(host, '.')[-1] END AS suffix
  FROM (SELECT DISTINCT host FROM urls) LEFT JOIN outcomes USING (host)
), domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY 1),
top AS (SELECT CASE WHEN sum(n) > 0 THEN (sum(k) + 1) / (sum(n) + 1)::DOUBLE ELSE 1.0 END AS p FROM suffixes),
m_suffix AS ({_STRENGTH.format(level="suffixes")}), m_domain AS ({_STRENGTH.format(level="domains")}), m_host AS ({_STRENGTH.format(level="hosts")}),
of_suffix AS (SELECT suffix, (k + p * m) / (n + m) AS suffix_mean FROM suffixes, top, m_suffix),
of_domain AS (SELECT domain, (k + suffix_mean * m) / (n + m) AS domain_mean FROM domains JOIN of_suffix USING (suffix), m_domain),
means AS (SELECT host, n, m, (k + domain_mean * m) / (n + m) AS mean FROM hosts JOIN of_domain USING (domain), m_host),
judged AS (SELECT host, CASE WHEN mean + {Z} * sqrt(mean * (1 - mean) / (n + m + 1)) < {MIN_GOOD} THEN 'block' ELSE 'allow' END AS by_host FROM means)
SELECT page_id, host, path,
  CASE {" ".join(f"WHEN {_FITS.format(h=h, p=p)} THEN '{h + p}'" for h, p, _ in _LONGEST)} END AS rule,
  CASE {" ".join(f"WHEN {_FITS.format(h=h, p=p)} THEN '{v}'" for h, p, v in _LONGEST)} ELSE by_host END AS verdict
FROM urls JOIN judged USING (host)
"""
