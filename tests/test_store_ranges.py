"""Shards of several ranges each, and characters by code point."""

from pyspark.sql import functions as F

from loomery.operators import tokens as K
from loomery.sources import token_store as S


def test_a_shard_of_many_ranges_is_one_stream(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "RANGE_ROWS", 10)
    rows = spark.range(400).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("id")).cast("long").alias("doc_id"), F.array_repeat(F.col("id").cast("int"), (F.col("id") % 7).cast("int")).alias("ids"))
    made = S.write_shards(rows, f"{tmp_path}/s", 4)
    per = S._pieces(spark, f"{tmp_path}/s").groupBy("shard", "piece").count().collect()
    assert len(per) > 20 and len(made["shards"]) == 4 and max(r["count"] for r in per) < 40
    got = S.read_shards(spark, f"{tmp_path}/s").orderBy("shard", "nth").collect()
    assert len(got) == 400 and got[0]["start"] == 0 and all(a["stop"] == b["start"] and a["stop"] - a["start"] == len(a["ids"]) for a, b in zip(got, got[1:], strict=False))
    assert all(r["nth"] == (0 if i == 0 or got[i - 1]["shard"] != r["shard"] else got[i - 1]["nth"] + 1) for i, r in enumerate(got))
    assert S.verify(spark, f"{tmp_path}/s").collect() == []


def test_characters_without_a_lambda(spark):
    vocab = spark.createDataFrame([("a", 0), (" ", 1), ("é", 2), ("😀", 3), ("<eos>", 4)], "ch string, id int")
    df = spark.createDataFrame([("a é😀zé",), ("",), (None,)], "text string").select(K.encoder(vocab)(F.col("text")).alias("ids"))
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [r["ids"] for r in df.collect()] == [[0, 1, 2, 3, 2], [], None]
    assert [r[0] for r in df.select(K.decoder(vocab)(F.concat("ids", F.array(F.lit(4), F.lit(99), F.lit(-1))))).collect()] == ["a é😀é", "", None]
