"""A corpus pipeline of five stages, each written and read again as Parquet.

Language ID drops documents without a language, SimHash deduplication keeps one document of each near-duplicate
component (texts whose five-word shingles have a similarity of 0.8 or more), decontamination drops documents that hold a benchmark
window, mixing keeps documents by their fitted rates, and sharding deals what is left into shards.

Edge cases, for every stage: an empty table gives an empty one. Columns beyond those of documents, whatever their names, are returned as they are.
A null id is an id like any other; rows are decided by their own id and text, so null and repeated ids neither drop a clean document nor keep a contaminated one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm import decontamination, language_id, mixing, sharding, similar
from loomery.llm.common import crc_bucket, join_hot, materialize, shared_folder, table
from loomery.llm.queries import WEIGHTS

#: A document goes whose best language is not likelier than all others together.
LEAST_LANGUAGE_SCORE = 0.5
#: Up to so many keys of dropped rows are broadcast to the texts; with more, they meet in a shuffle.
FEW_KEYS = 1 << 20


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a recognised language; null, empty and letterless texts have none and go. Repeated rows stay repeated."""
    model = language_id.train(docs, F.coalesce(crc_bucket(F.col("doc_id"), 4) != 2, F.lit(False)))
    return language_id.recognised(docs, model, LEAST_LANGUAGE_SCORE)


def _without(docs: DataFrame, keys: DataFrame, how: str = "left_anti") -> DataFrame:
    """The rows of ``docs`` (with ``_th``) whose id and text hash are not in ``keys`` (k_id, k_th); ids may be null or repeated."""
    return docs.join(keys, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("_th") == F.col("k_th")), how)


def _few(keys: DataFrame) -> DataFrame:
    """``keys``, written once and marked for a broadcast if there are few, so that no text is shuffled."""
    keys = materialize(keys)
    return F.broadcast(keys) if keys.count() <= FEW_KEYS else keys


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: that of the smallest id, null ids last. Of rows that repeat id and text one stays; null and empty texts are one component."""
    rows = materialize(similar.components(docs))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "th")
    least = rows.groupBy("component").agg(F.min_by(F.struct("doc_id", "th"), order).alias("first"), F.count(F.lit(1)).alias("n"))
    found = materialize(join_hot(rows, least, "component", "n", rows.count()).select(F.col("doc_id").alias("k_id"), F.col("th").alias("k_th"), (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))).alias("first")))
    marked = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id"), F.xxhash64("text").alias("_th"))
    kept = _without(marked, _few(found.filter("not first").select("k_id", "k_th").distinct()))
    repeated = _few(found.filter("first").groupBy("k_id", "k_th").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k_id", "k_th"))
    if not repeated.take(1):
        return kept.select("_row.*")
    # Only rows of repeated keys meet in one place.
    twice = _without(kept, repeated, "left_semi").dropDuplicates(["doc_id", "_th"])
    return _without(kept, repeated).select("_row.*").unionByName(twice.select("_row.*"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. Null and empty texts hold none; repeated rows stay or go together."""
    # The operator gets the text's hash as its id: hits belong to texts, whatever ids are null or repeated.
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    hit = decontamination.decontaminate(texts, table(spark, sf_dir, "benchmark")).filter("contaminated").select(F.col("doc_id").alias("k_th")).distinct()
    marked = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64("text").alias("_th"))
    return marked.join(_few(hit), F.col("_th") == F.col("k_th"), "left_anti").select("_row.*")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the rates that bring the domains' tokens to their weights ask for a copy; without labels all rates are 1.

    Each stays once: a second copy would undo the deduplication, so rates above 1 are left to the reader of ``op10``.
    """
    return mixing.chosen(docs, table(spark, sf_dir, "labels"), WEIGHTS)


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; nulls, repeats and ties as in ``sharding.shard``."""
    return sharding.shard(docs, 16)


STAGES = [("language_id", language_stage), ("simhash_dedup", dedup_stage), ("decontamination", decontaminate_stage), ("soft_mixing", mix_stage), ("sharding", shard_stage)]

#: The trained stages have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the ``documents`` of ``sf_dir``; stages are written below ``spark.checkpoint.dir``."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
