"""URL filters: host suffixes and path prefixes, looked up by short hash prefix, confirmed by digest.

Each URL is expanded into its host suffixes, and these meet the hosts of the rules; with those that are a rule's host, it is expanded into
the (host suffix, path prefix) expressions with as many characters of the path as that host's rules have.
Both meet the rules in an equi-join on the first 32 bits of their SHA-256; the full digest
then confirms, and the longest confirmed rule gives the verdict. All of it is DataFrame code, and rules of any number and shape are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = "host string, path string, verdict string"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if the URL is null or has no `://`."""
    at = F.instr(url, "://")
    after = F.coalesce(F.when(at > 0, url.substr(at + F.lit(3), F.length(url))), F.lit(""))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) rules as a DataFrame of host, path, verdict."""
    return spark.createDataFrame([(h, p, v) for v, h, p in rules], RULES)


def filter_urls(pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to every row of `pages`.

    A rule fits its host and all subdomains, if the URL's path starts with the rule's path. Of
    several, the longest rule text (host and path) wins, then the longer host, then block before
    allow. Rows without a fitting rule get a null rule and `default`. Columns of `pages` with one of the
    four names are replaced. Null URLs, and URLs without `://`, have empty host and path; repeated
    rows are each judged; rules with a null part are ignored.

    Rules are expected to be far fewer than URLs; Spark broadcasts them only if they are under
    its size threshold and else shuffles both sides by the hash prefix. Distinct URLs are judged
    once, and the verdicts are joined back to the rows by URL; Spark may split a hot URL. The driver learns one number: how many labels a rule's host has
    at most. Column names that begin with `__` are the operator's own.
    """
    host, path = split_url(F.col(url))
    pages = pages.drop(*({"host", "path", "rule", "verdict"} & set(pages.columns) - {url}))
    rules = (
        rules.select("host", "path", "verdict")
        .where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
        .withColumn("host", F.translate("host", UPPER, LOWER))
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
    )
    labels = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("n")).first().n
    if labels is None:
        return pages.withColumns({"host": host, "path": path, "rule": F.lit(None).cast("string"), "verdict": F.lit(default)})

    short = lambda digest: F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    hosts = rules.groupBy("host").agg(F.sort_array(F.collect_set(F.length("path"))).alias("__chars")).select("__chars", F.sha2("host", 256).alias("__own"))
    parts = F.split("__host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda n: F.concat_ws(".", F.slice(parts, F.size(parts) - n + F.lit(1), n)))
    prefixes = F.transform(F.filter("__chars", lambda n: n <= F.length("__path")), lambda n: F.sha2(F.concat(F.col("__suffix"), F.lit("\n"), F.col("__path").substr(F.lit(1), n)), 256))
    full = rules.select(
        F.concat("host", "path").alias("__rule"), F.length("host").alias("__n_host"), F.col("verdict").alias("__verdict"), F.sha2(F.concat_ws("\n", "host", "path"), 256).alias("__digest")
    )
    found = (
        pages.select(F.col(url).alias("__url")).distinct()
        .withColumns({"__host": split_url(F.col("__url"))[0], "__path": split_url(F.col("__url"))[1]})
        .select("__url", "__path", F.explode(suffixes).alias("__suffix"))
        .withColumn("__named", F.sha2("__suffix", 256)).withColumn("__short", short(F.col("__named")))
        .join(hosts.withColumn("__short", short(F.col("__own"))), "__short").where(F.col("__named") == F.col("__own"))
        .select("__url", F.explode(prefixes).alias("__expression")).withColumn("__short", short(F.col("__expression")))
        .join(full.withColumn("__short", short(F.col("__digest"))), "__short").where(F.col("__expression") == F.col("__digest"))
        .groupBy("__url")
        .agg(F.max(F.struct(F.length("__rule").alias("n"), "__n_host", (F.col("__verdict") == "block").alias("b"), "__rule", "__verdict")).alias("__best"))
    )
    return (
        pages.withColumns({"host": host, "path": path})
        .join(found, F.col(url) == F.col("__url"), "left")
        .withColumns({"rule": F.col("__best.__rule"), "verdict": F.coalesce(F.col("__best.__verdict"), F.lit(default))})
        .drop("__url", "__best")
    )
