"""URL filters: host-suffix and path-prefix expressions joined to rules on short hash prefixes.

DataFrame functions only. Every distinct (host, path) is expanded once, so a host or an address that holds a third of
all rows costs no more than one that occurs once, until the last join, whose hot side adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernsieve.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of the digest that the equi-join uses.
PREFIX_DIGITS = 8
#: Up to this many rules are sent to all executors; more are joined by a shuffle.
BROADCAST_RULES = 100_000
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to ``pages``; columns of these names are replaced.

    A rule (host, path, verdict) fits its host and all subdomains if the page's path starts with the rule's. The
    longest rule wins; of equally long ones the one with the longer host, then ``block``. A null address, or one
    without ``://``, has empty host and path and gets the default verdict, as does one that no rule fits. Rules with
    a null field fit nothing; repeated rules count once. Empty tables give empty results.
    """
    rules = rules.dropna().select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).distinct()
    # how many labels and path characters rules have: sizes of a rule set, not of the pages
    shape = rules.agg(F.count("*").alias("n"), F.collect_set(F.size(F.split("r_host", r"\."))).alias("labels"), F.collect_set(F.length("r_path")).alias("chars")).first()
    labels, chars = sorted(shape["labels"]) or [1], sorted(shape["chars"]) or [0]
    expression = lambda host, path: F.concat(host, F.lit("\n"), path)
    coded = rules.withColumn("digest", F.sha2(expression(F.col("r_host"), F.col("r_path")), 256)).withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    coded = F.broadcast(coded) if shape["n"] <= BROADCAST_RULES else coded
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    judged = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    parts = F.split("host", r"\.")
    suffixes = F.array_distinct(F.array(*[F.when(F.size(parts) >= n, F.array_join(F.slice(parts, -n, n), ".")) for n in labels]))
    prefixes = F.array_distinct(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in chars]))
    exploded = (
        judged.select("host", "path").where("host <> ''").distinct()
        .withColumn("suffix", F.explode(F.array_compact(suffixes)))
        .withColumn("prefix", F.explode(F.array_compact(prefixes)))
        .withColumn("full", F.sha2(expression(F.col("suffix"), F.col("prefix")), 256))
    )
    rank = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), F.col("r_verdict") == "block", F.col("r_host"), F.col("r_path"))
    best = (
        exploded.join(coded, F.substring("full", 1, PREFIX_DIGITS) == F.col("short"))
        .where((F.col("full") == F.col("digest")) & (F.col("suffix") == F.col("r_host")) & (F.col("prefix") == F.col("r_path")))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), rank).alias("best"))
    )
    return judged.join(best, ["host", "path"], "left").select(*keep, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES) + " AS r(host, path, verdict)")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (
  SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
