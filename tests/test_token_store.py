"""Token shards: layout, refusal of damaged stores, the check and the cache."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from loomery.sources import token_store as S

SOS, EOS = 900, 901


def stories(spark, n=200):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.array(F.lit(SOS)), F.transform(F.sequence(F.lit(0), (F.col("id") % 7).cast("int")), lambda x: x), F.array(F.lit(EOS))).cast("array<int>").alias("ids"))


def files(path):
    return sorted(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def test_shards_join_to_one_stream(spark, tmp_path):
    made = S.write_shards(stories(spark), f"{tmp_path}/s", 5, "sha", 10, SOS, EOS)
    rows = S.read_shards(spark, f"{tmp_path}/s").orderBy("start").collect()
    assert len(made["shards"]) == 5 and made["stories"] == 200 and made["tokens"] == rows[-1]["stop"] == sum(len(r["ids"]) for r in rows)
    assert [r["doc_id"] for r in rows] == list(range(200))
    assert rows[0]["start"] == 0 and all(a["stop"] == b["start"] for a, b in zip(rows, rows[1:], strict=False))
    assert S.verify(spark, f"{tmp_path}/s").collect() == []


def test_hot_null_and_repeated_ids_are_spread(spark, tmp_path):
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("id")).cast("long").alias("doc_id"), F.array(F.col("id").cast("int")).alias("ids"))
    same = spark.range(2000).select(F.lit(7).cast("long").alias("doc_id"), F.array(F.lit(1)).alias("ids"))
    made = S.write_shards(rows.unionByName(same), f"{tmp_path}/s", 8)
    assert made["stories"] == 6000 and max(s["stories"] for s in made["shards"]) < 2000
    assert S.verify(spark, f"{tmp_path}/s").collect() == []


def test_empty(spark, tmp_path):
    made = S.write_shards(stories(spark).limit(0), f"{tmp_path}/s", 3)
    assert made["shards"] == [] and S.read_shards(spark, f"{tmp_path}/s").collect() == []


def test_damaged_and_uncommitted_stores_are_refused(spark, tmp_path):
    path = f"{tmp_path}/s"
    S.write_shards(stories(spark), path, 5, "sha", 10, SOS, EOS)
    shutil.copytree(path, f"{tmp_path}/open")
    shutil.rmtree(f"{tmp_path}/open/manifest")
    with pytest.raises(S.StoreError, match="not committed"):
        S.read_shards(spark, f"{tmp_path}/open")
    os.remove(files(f"{path}/tokens/shard=2")[0])
    with pytest.raises(S.StoreError, match=r"shards \[2\]"):
        S.read_shards(spark, path)
    assert {(r["problem"], r["shard"]) for r in S.verify(spark, path).collect()} == {("missing", 2)}


def test_every_kind_of_problem(spark):
    rows = [(0, 0, 0, 3, [SOS, 1, EOS]), (0, 1, 4, 6, [SOS, EOS]), (1, 0, 0, 3, [SOS, 1, EOS]), (1, 1, 2, 5, [SOS, 1, EOS]), (2, 0, 1, 3, [SOS, EOS]), (3, 0, 0, 2, [5, EOS]), (3, 1, 2, 4, [SOS, 5]), (4, 0, 0, 5, [SOS, EOS]), (5, 0, 0, 0, [])]
    got = S.problems(spark.createDataFrame(rows, "shard int, nth long, start long, stop long, ids array<int>"), spark.createDataFrame([(0, 2, 6), (1, 2, 6), (2, 1, 3), (3, 3, 4), (4, 1, 5), (9, 1, 1)], "shard int, stories long, tokens long"), EOS, SOS)
    want = {("gap", 0, 1), ("tokens", 0, 1), ("overlap", 1, 1), ("cover", 1, 1), ("cover", 2, 1), ("tokens", 2, 1), ("sos", 3, 1), ("eos", 3, 1), ("stories", 3, 1), ("length", 4, 1), ("unnamed", 5, 1), ("sos", 5, 1), ("eos", 5, 1), ("missing", 9, 1)}
    assert {(r["problem"], r["shard"], r["n"]) for r in got.collect()} == want


def test_cache_hits_and_misses(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    calls = []

    def encode(rows):
        calls.append(1)
        return rows.select("doc_id", F.transform(F.split("text", ""), F.ascii).alias("ids"))

    ask = lambda docs, sha="a": S.cached(docs, f"{tmp_path}/cache", (sha, 9), encode, 4)
    first, reused = ask(docs)
    assert not reused and ask(docs.repartition(3)) == (first, True) and len(calls) == 1
    stale, reused = ask(docs, "b")
    assert stale != first and not reused
    changed, reused = ask(docs.withColumn("text", F.when(F.col("doc_id") == 3, "texts3").otherwise(F.col("text"))))
    assert changed not in (first, stale) and not reused
    os.remove(files(f"{first}/tokens")[0])
    renewed, reused = ask(docs)
    assert not reused and renewed != first and ask(docs) == (renewed, True)
    assert S.read_shards(spark, renewed).count() == 50
    assert ask(docs.limit(0))[1] is False and ask(docs.limit(0))[1] is True
