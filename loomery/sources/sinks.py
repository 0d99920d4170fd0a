"""Writers. Each is one distributed write; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as X


def text_shard(stories: DataFrame, path: str) -> int:
    """K1: one cleaned line for each story, empty ones dropped; the count comes with the write."""
    seen = Observation()
    rows = stories.select(X.story_line(F.col("text")).alias("value")).filter("value <> ''")
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.text(path)
    return seen.get["n"]


def pair_files(pairs: DataFrame, native: str, records: str) -> None:
    """K2, K4: native lines and JSON records of the same pairs."""
    pairs.select(X.native_line(F.col("user"), F.col("assistant")).alias("value")).write.text(native)
    record(pairs).write.text(records)


def record(pairs: DataFrame) -> DataFrame:
    """K3: the JSON record of each pair."""
    return pairs.select(F.to_json(F.struct(F.struct("user").alias("query"), F.struct("assistant").alias("response"))).alias("value"))


def by_domain(facts: DataFrame, path: str) -> None:
    """K5."""
    facts.write.partitionBy("domain").parquet(path)


def append_json(rows: DataFrame, path: str) -> None:
    """K8."""
    rows.write.mode("append").json(path)


def remember(index: DataFrame, learned: DataFrame, path: str) -> None:
    """Appends learned pairs whose key is new."""
    fresh = learned.withColumn("key", X.question_key(F.col("user"))).filter("key <> ''").join(index.select("key"), "key", "left_anti")
    fresh.groupBy("key").agg(F.min_by(F.struct("user", "assistant"), "ord").alias("p")).select("key", "p.user", "p.assistant").write.mode("append").parquet(path)


def manifest(docs: DataFrame) -> DataFrame:
    """Counts and an order-free fingerprint of a corpus, one row."""
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text")).alias("n_chars"), F.sum(F.octet_length("text")).alias("n_bytes"), F.sha2(F.sum(F.conv(F.substring(F.md5("text"), 1, 12), 16, 10).cast("decimal(38,0)")).cast("string").cast("binary"), 256).alias("fingerprint"))
