"""URL rules by hashed expressions.

A rule is a host and a path; it fits its host and all subdomains when the url's path starts with the rule's. Each URL becomes the
expressions (host suffix, path prefix up to a slash); rules are keyed by their host and their path up to the last slash. Both sides
meet on a short prefix of the SHA-256 of the expression; the full digest and the whole rule path are confirmed afterwards, and the
longest rule wins (block before allow, should both be as long). A URL is expanded only as deep as the deepest rule, which loses
nothing. The rules join as an ordinary table: Spark broadcasts it while it is small by its statistics and sorts and merges otherwise.

Defined results: a null url or one without :// has an empty host and path and gets the default verdict; empty tables give empty
results; an empty rule table gives every url the default verdict; repeated rows are judged one by one; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcount.llm.common import LOWER, UPPER

PREFIX = 8  # hex digits that the first join compares


def split_url(url: Column) -> tuple[Column, Column]:
    """host (A-Z lower-cased) and path."""
    at = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.coalesce(F.regexp_extract(url, at, 1), F.lit("")), UPPER, LOWER), F.coalesce(F.regexp_extract(url, at, 2), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit(" "), path), 256)


def keyed_rules(rules: DataFrame) -> DataFrame:
    """rules: host, path, verdict."""
    key = F.regexp_extract("path", r"(?s)^(.*/)?", 1)
    return rules.select(
        F.concat("host", "path").alias("rule"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"),
        F.size(F.split("host", r"\.")).alias("labels"), F.size(F.split("path", "/")).alias("depth"), _digest(F.col("host"), key).alias("rule_digest"),
    ).withColumn("short", F.substring("rule_digest", 1, PREFIX))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages: page_id, url. Returns page_id, host, path, rule, verdict."""
    keyed = keyed_rules(rules)
    deepest = keyed.agg(F.max("labels"), F.max("depth")).first()
    labels, depth = deepest[0] or 1, deepest[1] or 1
    host, path = split_url(F.col("url"))
    urls = pages.select(F.monotonically_increasing_id().alias("uid"), "page_id", host.alias("host"), path.alias("path"))
    suffixes = F.expr(f"transform(sequence(1, least({labels}, size(split(host, '[.]')))), k -> substring_index(host, '.', -k))")
    prefixes = F.expr(f"transform(sequence(0, least({depth}, size(split(path, '/')) - 1)), k -> if(k = 0, '', concat(substring_index(path, '/', k), '/')))")
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: _digest(h, p))))
    met = (
        urls.withColumn("digest", F.explode(expressions)).withColumn("short", F.substring("digest", 1, PREFIX))
        .join(keyed, "short", "left")
        .withColumn("fit", F.when((F.col("digest") == F.col("rule_digest")) & F.startswith("path", "rule_path"),
            F.struct(F.length("rule").alias("n"), (F.col("rule_verdict") == "block").alias("b"), "rule", F.col("rule_verdict").alias("v"))))
    )
    best = met.groupBy("uid").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("fit").alias("fit"))
    return best.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.v", F.lit(default)).alias("verdict"))
