"""Segmented scans: every run query on one file in many ranges, against its SQL; exact percentiles; as-of joins."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.operators import runs as R
from loomery.operators import scan as S
from loomery.plans import evaluation_queries as EQ
from loomery.plans import run_queries as RQ

NAMES = ["run_segments", "last_sample_per_step", "latest_segment", "step_window", "smoothed_series", "exponential_mean", "run_decisions", "loss_forecast", "interval_rollup", "richest_run", "run_trajectory", "percentile_band", "run_perplexity", "checkpoint_trend", "retry_backoff", "decision_overlay"]


@pytest.fixture(scope="module")
def one_file(spark, tmp_path_factory):
    """Events of one type and of one user for most: steps fall, jump, repeat and losses are missing; times tie."""
    d, rng = str(tmp_path_factory.mktemp("one")), random.Random(5)
    rows = [(i, i // 3 * 40, 1 if rng.random() < 0.9 else i % 5, "purchase" if rng.random() < 0.05 else "view", round(rng.random() * 9 + i % 3, 4)) for i in range(3000)]
    df = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double")
    df.select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "event_type", "value").coalesce(3).write.parquet(f"{d}/events.parquet")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    con.execute(f"create view events as select event_id, cast(ts as timestamp) as ts, user_id, event_type, value from '{d}/events.parquet/*.parquet'")
    return d, con


def norm(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v) if v is None or isinstance(v, bool) else str(int(v)) if not isinstance(v, str) and hasattr(v, "__int__") else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_one_file_in_many_ranges(spark, one_file, monkeypatch, name):
    monkeypatch.setattr(S, "RANGES", 64)
    monkeypatch.setattr(S, "LEAST", 1)
    monkeypatch.setattr(S, "CHUNK", 37)
    d, con = one_file
    df = RQ.QUERIES[name](spark, d)
    cols = sorted(df.columns)
    r = con.sql(RQ.SQL[name])
    at = [list(r.columns).index(c) for c in cols]
    assert sorted(tuple(norm(x[c]) for c in cols) for x in df.collect()) == sorted(tuple(norm(x[i]) for i in at) for x in r.fetchall())


def test_ranges_split_a_file(spark, one_file, monkeypatch):
    monkeypatch.setattr(S, "RANGES", 64)
    monkeypatch.setattr(S, "LEAST", 1)
    r = R.segments(RQ.rows(spark, one_file[0]))
    most = r.groupBy("file", "_range").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    assert r.select("_range").distinct().count() == 64 and most <= 2 * 3000 / 64


def test_streamed_decisions_equal_batch(spark, one_file):
    d, con = one_file
    got = sorted(tuple(map(str, (r["file"], r["run"], r["ord"], r["step"], r["action"]))) for r in EQ.live_decisions(spark, d).collect())
    r = con.sql(EQ.SQL["live_decisions"])
    assert got == sorted(tuple(map(str, x)) for x in r.fetchall())


def test_order_statistics(spark, monkeypatch):
    rng = np.random.default_rng(2)
    groups = {"one": rng.normal(0, 1, 1), "two": rng.normal(0, 1, 2), "ties": np.repeat([1.5, -2.0, 7.25], [500, 30, 3]), "many": rng.normal(5, 100, 1500)}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("many", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    for ranges in (1, 7, 64):
        monkeypatch.setattr(S, "RANGES", ranges)
        monkeypatch.setattr(S, "LEAST", 1)
        got = {r["g"]: (r["n"], r["p"]) for r in S.order_statistics(df, ["g"], "x", (0.05, 0.5, 0.95)).collect()}
        assert {k: n for k, (n, _) in got.items()} == {k: len(v) for k, v in groups.items()}
        for k, v in groups.items():
            assert got[k][1] == pytest.approx([np.percentile(v, q) for q in (5, 50, 95)])


def test_as_of(spark, monkeypatch):
    monkeypatch.setattr(S, "RANGES", 9)
    monkeypatch.setattr(S, "LEAST", 1)
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.randrange(60), i) for i in range(200)]
    facts = [(rng.choice("ab"), rng.randrange(60), None if rng.random() < 0.3 else float(i)) for i in range(40)]
    facts = list({(k, o): (k, o, v) for k, o, v in facts}.values())
    got = R.as_of(spark.createDataFrame(rows, "k string, ord long, id long"), spark.createDataFrame(facts, "k string, ord long, v double"), ["k"], "v")
    want = {i: next((v for _, v in sorted(((o2, v) for k2, o2, v in facts if k2 == k and o2 <= o and v is not None), reverse=True)), None) for k, o, i in rows}
    assert {r["id"]: r["v"] for r in got.collect()} == want and got.count() == 200


def test_empty_series(spark):
    none = spark.createDataFrame([], "file string, ord long, step long, loss double")
    runs = R.segments(none)
    for df in (runs, R.smoothed(runs), R.ema(runs, 0.3), R.decide(runs), R.forecast(runs, 5, 10), R.band(runs), R.trajectory(runs), R.trend(runs)):
        assert df.count() == 0
