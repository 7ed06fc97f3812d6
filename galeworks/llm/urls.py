"""URL filter by host-suffix and path-prefix expressions (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galeworks.llm.common import ascii_lower

#: Hexadecimal digits of the hash prefix that rules and expressions are joined on.
PREFIX_DIGITS = 8


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or where there is no '://'."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to the id and url columns of pages.

    Each distinct (host, path) is expanded into the host suffixes and path prefixes whose label counts and lengths
    occur among the rules (both are read from the rules and small whatever the number of pages), equi-joined with the
    rules on a short hash prefix; full digests confirm. The longest fitting rule wins, then the longer host, then block.
    Null urls, urls without '://' and empty hosts fit no rule: rule null, verdict `default`. Rules with a null part are
    ignored. Every input row gives one output row; rows that repeat are judged alike. Columns of pages named like
    the added ones are replaced.

    A place is expanded into as many expressions as the rules have label counts times path lengths: some hundreds where
    thousands of rules have paths of any length, a few where they end at the same depths. Places are judged once each; pages meet
    their place again by a join that adaptive execution splits where one place is very common.
    """
    host, path = url_parts(F.col(url_col))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parted = pages.select(*kept).withColumns({"host": host, "path": path})
    rules = rules.select("host", "path", "verdict").where("host is not null and path is not null and verdict is not null").distinct()
    shapes = rules.agg(
        F.sort_array(F.collect_set(F.size(F.split("host", r"\.")))).alias("labels"), F.sort_array(F.collect_set(F.length("path"))).alias("lengths")
    ).first()
    n_labels = F.size(F.split("host", r"\."))
    suffixes = [F.when(n_labels >= n, F.substring_index("host", ".", -n)) for n in shapes["labels"]]
    prefixes = [F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in shapes["lengths"]]
    pairs = [F.when(s.isNotNull() & p.isNotNull(), F.concat(s, p)) for s in suffixes for p in prefixes]
    places = parted.where("host <> ''").select("host", "path").distinct()
    looked = places.withColumn("expression", F.explode(F.array_compact(F.array(*pairs) if pairs else F.array().cast("array<string>"))))
    looked = looked.withColumn("digest", F.sha2("expression", 256)).withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    keyed = rules.select(
        F.sha2(F.concat("host", "path"), 256).alias("rule_digest"),
        F.concat("host", "path").alias("rule"),
        F.length("host").alias("rule_host"),
        "verdict",
    ).withColumn("short", F.substring("rule_digest", 1, PREFIX_DIGITS))
    hits = looked.join(keyed, "short").where("digest = rule_digest")
    best = hits.groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule").alias("n"), F.col("rule_host").alias("h"), (F.col("verdict") == "block").alias("b"), "rule", "verdict")).alias("best")
    )
    out = parted.join(best, ["host", "path"], "left")
    return out.select(*kept, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
