"""Logs written as they grow, and more rows of one file than are put out at a time."""

import json

from pyspark.sql import functions as F

from loomery.operators import runs as R
from loomery.plans import stream_queries as Q
from loomery.streaming import streams as S


def test_a_log_grows_by_shares_of_its_bytes(spark, tmp_path):
    rows = spark.range(3000).select(F.col("id").alias("event_id"), (F.col("id") % 16).alias("user_id"), F.lit("v").alias("event_type"), F.lit(0.5).alias("value"))
    of = lambda log: ("".join(json.dumps({"event_id": i, "user_id": i % 16, "event_type": "v", "value": 0.5}) + "\n" for i in range(3000) if i % 8 == log) + "not a record\n").encode()
    for until in (0.5, 1.0):
        Q.append(rows.repartition(5), f"{tmp_path}/logs", until)
        for log in range(8):
            assert (tmp_path / "logs" / f"log-{log}.jsonl").read_bytes() == of(log)[: int(len(of(log)) * until)]


def test_live_runs_of_more_rows_than_a_piece(spark, tmp_path):
    rows = spark.range(25_000).select(F.lit("a").alias("file"), F.col("id").alias("ord"), (F.col("id") % 700).alias("step"), F.when(F.col("id") % 7 != 0, F.hash("id") % 1000 / 7.0).alias("loss"))
    rows.repartition(1).write.parquet(f"{tmp_path}/t")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/t")
    got = {r["ord"]: (r["run"], r["action"]) for r in S.drain(S.live_runs(stream), "live").collect()}
    assert got == {r["ord"]: (r["run"], r["action"]) for r in R.decide(R.segments(rows)).collect()} and len(got) > 2 * S.ROWS
