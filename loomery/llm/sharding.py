"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; the rank as a fraction of the source's
rows is a row's place in the whole. Rows sorted by that fraction are cut into shards of equal row counts
(law ``rows``), so every shard holds each source in proportion.

Ranks and places are two-level prefix sums: counts of narrow hash ranges first, then row numbers within one range. No
source, however large, is ever in one task. Sources of few rows start at an offset of their own, or they would all meet in the middle.

Edge cases: a null source is a source of its own; null and empty texts have size 1 and checksum 0;
null and repeated ids are shuffled by their texts. Rows that agree in id, size and checksum are interchangeable. Empty tables give an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize


def shard(documents: DataFrame, shards: int = 16, seed: int = 13, range_rows: int = 50_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("\x00")).alias("source"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    # Null and repeated ids are shuffled by their texts.
    rows = materialize(rows.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size")))
    total = rows.count()
    ranges = max(64, -(-total // range_rows))
    rows = rows.withColumn("range", F.floor((F.shiftrightunsigned("key", 33) / float(1 << 31)) * ranges).cast("long"))

    cells = rows.groupBy("source", "range").agg(F.count(F.lit(1)).alias("cell"))
    own = W.partitionBy("source")
    cells = cells.select("source", "range", (F.sum("cell").over(own.orderBy("range")) - F.col("cell")).alias("before"), F.sum("cell").over(own).alias("of"))
    local = F.row_number().over(W.partitionBy("source", "range").orderBy("key", "doc_id", "size", "text_crc32"))
    ranked = rows.withColumn("local", local).join(cells, ["source", "range"])
    offset = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "source"), 33) / float(1 << 31)
    placed = ranked.withColumn("fraction", (F.col("before") + F.col("local") - offset) / F.col("of"))
    placed = placed.withColumn("stripe", F.least(F.lit(ranges - 1), F.greatest(F.lit(0), F.floor(F.col("fraction") * ranges))).cast("long"))
    placed = materialize(placed.select("doc_id", "size", "text_crc32", "key", "source", "fraction", "stripe"))

    stripes = placed.groupBy("stripe").agg(F.count(F.lit(1)).alias("n"))
    stripes = stripes.select("stripe", (F.sum("n").over(W.orderBy("stripe")) - F.col("n")).alias("before"))  # one row for each range_rows rows
    local = F.row_number().over(W.partitionBy("stripe").orderBy("fraction", "key", "source", "doc_id", "size", "text_crc32"))
    at = placed.withColumn("local", local).join(stripes, "stripe").withColumn("at", F.col("before") + F.col("local") - 1)
    at = at.withColumn("shard", F.expr(f"cast((at * {shards}) div {max(1, total)} as int)")).withColumn("first", F.expr(f"(shard * cast({total} as bigint) + {shards - 1}) div {shards}"))
    return at.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("at") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
