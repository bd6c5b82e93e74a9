"""URL filters by empirical-Bayes host reputation, under explicit host and path rules.

Each labelled page is an outcome (bad or not) of its host, registered domain and suffix. From the top down, each level's
rate is shrunk to its parent's by a beta-binomial prior: the prior's mean is the parent's shrunken rate, its strength is
fitted to the spread of the level's rates around their parents (method of moments). A host is blocked when the lower
bound of its posterior bad rate is above BLOCK. Rules come first.

A page's outcome is the row of `labels` with its id: bad if quality is 0 or toxic is 1; several rows count as one, bad if
any is. The suffix is the last label of the host, or the last two where a country's code follows one of SECOND (co.uk); the
registered domain is the suffix and one label more.

Defined cases: a null url, or one without "://", has an empty host and path and fits no rule; hosts without outcomes get
their parent's rate; null labels are no outcome; repeated pages each get a row and each count as an outcome; empty tables
give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small

RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
BLOCK, Z = 0.5, 1.6448536269514722
LEAST_RHO, MOST_RHO = 0.001, 0.5

#: Labels under which countries register domains.
SECOND = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "mil", "ne", "net", "nom", "or", "org")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's text and its verdict, or nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def suffix_of(host: Column) -> Column:
    deep = host.rlike(f"(^|[.])({'|'.join(SECOND)})[.][a-z]{{2}}$")
    return F.when(deep, F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    own = F.substring_index(host, ".", -2)
    return F.when(suffix_of(host) == own, F.substring_index(host, ".", -3)).otherwise(own)


def _shrunk(level: DataFrame, key: str) -> DataFrame:
    """(key, rate, bound) from (key, n, k, mean), a written table: mean is the parent's rate. The strength is one number for the level."""
    n, k, mean = F.col("n"), F.col("k"), F.col("mean")
    spread = level.where("n > 0").agg(F.sum(n * (k / n - mean) * (k / n - mean)).alias("q"), F.sum(mean * (1 - mean)).alias("v"), F.sum(mean * (1 - mean) * (n - 1)).alias("w"))
    rho = F.greatest(F.lit(LEAST_RHO), F.least(F.lit(MOST_RHO), F.coalesce(F.try_divide(F.col("q") - F.col("v"), F.col("w")), F.lit(LEAST_RHO))))
    m = F.lit(spread.select((1 / rho - 1).alias("m")).first()[0])
    a, b = mean * m + k, (1 - mean) * m + n - k
    rate = a / (a + b)
    return level.select(key, rate.alias("rate"), (rate - F.lit(Z) * F.sqrt(rate * (1 - rate) / (a + b + 1))).alias("bound"))


def reputations(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, rate, bound) of every host of `pages` (page_id, host)."""
    bad = F.when((labels["quality"] == 0) | (labels["toxic"] == 1), 1).when(labels["quality"].isNotNull() | labels["toxic"].isNotNull(), 0)
    outcomes = labels.select(labels["doc_id"].alias("page_id"), bad.alias("bad")).groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = pages.join(outcomes, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    hosts = materialize(hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    top = hosts.agg(((F.coalesce(F.sum("k"), F.lit(0)) + 1.0) / (F.coalesce(F.sum("n"), F.lit(0)) + 2.0)).alias("mean")).first()[0]
    level = _shrunk(materialize(suffixes.withColumn("mean", F.lit(top)), "suffixes"), "suffix").select("suffix", F.col("rate").alias("mean"))
    level = _shrunk(materialize(domains.join(level, "suffix"), "domains"), "domain").select("domain", F.col("rate").alias("mean"))
    return _shrunk(materialize(hosts.join(level, "domain"), "host_means"), "host")


def judged(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    host, path = split_url(pages["url"])
    parsed = pages.select(pages["page_id"].alias("page_id"), host.alias("host"), path.alias("path"))
    poor = small(reputations(parsed, labels).where(F.col("bound") > BLOCK).select("host", F.lit(True).alias("poor")))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return parsed.join(poor, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("poor"), "block").otherwise("allow")).alias("verdict"))


def op6_url_filters(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _level_sql(name: str, key: str, source: str) -> str:
    return f"""
{name}_m AS (
  SELECT 1.0::DOUBLE / greatest(0.001::DOUBLE, least(0.5::DOUBLE, coalesce((q - v) / nullif(w, 0), 0.001::DOUBLE))) - 1.0::DOUBLE AS m FROM (
    SELECT sum(n * (k::DOUBLE / n - mean) * (k::DOUBLE / n - mean)) AS q, sum(mean * (1.0::DOUBLE - mean)) AS v, sum(mean * (1.0::DOUBLE - mean) * (n - 1)) AS w
    FROM {source} WHERE n > 0)
), {name} AS (
  SELECT {key}, rate, rate - {Z!r}::DOUBLE * sqrt(rate * (1.0::DOUBLE - rate) / (mean * m + k + (1.0::DOUBLE - mean) * m + n - k + 1.0::DOUBLE)) AS bound
  FROM (SELECT *, (mean * m + k) / (mean * m + k + (1.0::DOUBLE - mean) * m + n - k) AS rate FROM {source}, {name}_m)
)"""


OP6_SQL = f"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), o AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad FROM labels GROUP BY doc_id
), h0 AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k, CASE WHEN regexp_matches(host, '(^|[.])({"|".join(SECOND)})[.][a-z]{{2}}$') THEN regexp_extract(host, '([^.]*[.])?([^.]*[.])?[^.]*$', 0) ELSE regexp_extract(host, '([^.]*[.])?[^.]*$', 0) END AS domain,
    CASE WHEN regexp_matches(host, '(^|[.])({"|".join(SECOND)})[.][a-z]{{2}}$') THEN regexp_extract(host, '([^.]*[.])?[^.]*$', 0) ELSE string_split(host, '.')[-1] END AS suffix
  FROM p LEFT JOIN o ON page_id = doc_id GROUP BY host
), d0 AS (
  SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h0 GROUP BY domain, suffix
), s1 AS (
  SELECT suffix, n, k, (SELECT (coalesce(sum(k), 0) + 1.0::DOUBLE) / (coalesce(sum(n), 0) + 2.0::DOUBLE) FROM d0) AS mean FROM (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d0 GROUP BY suffix)
), {_level_sql("s", "suffix", "s1")}
, d1 AS (SELECT d0.*, rate AS mean FROM d0 JOIN s USING (suffix))
, {_level_sql("d", "domain", "d1")}
, h1 AS (SELECT h0.*, rate AS mean FROM h0 JOIN d USING (domain))
, {_level_sql("h", "host", "h1")}
, r AS (
  SELECT page_id, host, path, bound, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM p JOIN h USING (host)
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN bound > 0.5::DOUBLE THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
