"""URL filters by hashed expressions, with DataFrame operations only.

A URL expands into every suffix of its host, at label borders, combined with every prefix of its path that has the length of some rule's
path. An expression joins the rules on the first 8 hex digits of its SHA-256 alone; the full digest confirms what has met. Of the rules that
fit, the longest wins (host and path together, then the longer host, then block before allow).

Each distinct URL is judged once. Null URLs and those without `://` have an empty host and path, no rule fits, and they take no part in any shuffle. A rule with null
in any column fits nothing; a repeated rule counts once. Without a fitting rule the verdict is `default`. Empty tables give empty results. Columns of
pages other than page_id and url are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rule tables of up to this many rows may be broadcast; larger ones join by shuffle.
BROADCAST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str = "url") -> Column:
    return F.translate(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: str = "url") -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\x00"), path), 256)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages. rules: verdict, host, path (strings)."""
    kept = rules.select("verdict", "host", "path").dropna().distinct()
    size = kept.count()
    # Distinct lengths, at most as many as a URL has characters.
    lengths = [r[0] for r in kept.select(F.length("path")).distinct().collect()]
    listed = kept.select(_digest(F.col("host"), F.col("path")).alias("full"), F.struct(F.length(F.concat("host", "path")).alias("n"), F.length("host").alias("h"), (F.col("verdict") == "block").alias("b"), F.concat("host", "path").alias("rule"), "verdict").alias("won"))
    listed = listed.withColumn("prefix", F.substring("full", 1, 8))
    if size <= BROADCAST_RULES:
        listed = F.broadcast(listed)
    parts = pages.select("url").distinct().select("url", host_of().alias("host"), path_of().alias("path")).where("host <> ''")
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    expanded = parts.withColumn("suffix", F.explode(suffixes))
    expanded = expanded.withColumn("length", F.explode(F.array(*map(F.lit, lengths)) if lengths else F.expr("array()").cast("array<int>"))).where("length <= length(path)")
    hashed = expanded.select("url", _digest(F.col("suffix"), F.expr("substring(path, 1, length)")).alias("digest"))
    hits = hashed.join(listed, F.substring("digest", 1, 8) == F.col("prefix"))
    best = hits.groupBy("url").agg(F.max(F.when(F.col("digest") == F.col("full"), F.col("won"))).alias("won")).withColumnRenamed("url", "judged")
    rows = pages.select("page_id", "url", host_of().alias("host"), path_of().alias("path"))
    verdict = [F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict")]
    joined = rows.where("host <> ''").join(best, F.col("url") == F.col("judged"), "left").select("page_id", "host", "path", *verdict)
    bare = rows.where("host = ''").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return joined.unionByName(bare)
