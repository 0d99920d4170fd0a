"""Open metrics: parsing, aliases, latest values and clocks on small logs."""

import pytest
from pyspark.sql import functions as F

from loomery.operators import metrics as M
from loomery.operators import runs as R


def logs(spark, *lines):
    return spark.createDataFrame([("a.log", i, x) for i, x in enumerate(lines)], "file string, ord long, line string")


def test_every_key_the_last_duplicate_and_no_numbers(spark):
    r = M.parse_log(logs(spark, "x step=7/90 loss=1.5, loss=2.5, tok/s=1e3 a_b/c=-3 lr=nan g=None h=-Inf word=abc step_ms=4", "no step loss=1", "step=8/ loss=1", "step=9/10")).orderBy("ord").collect()
    assert [(x["ord"], x["step"], x["total"]) for x in r] == [(0, 7, 90), (3, 9, 10)]
    assert r[0]["metrics"] == {"loss": 2.5, "tok/s": 1000.0, "a_b/c": -3.0, "lr": None, "g": None, "h": None, "word": None, "step_ms": 4.0}
    assert r[1]["metrics"] == {}


def test_aliases(spark):
    m = spark.sql("select map('toks', 5D, 'tok_s', cast(null as double), 'learning_rate', 2D, 'other', 7D) as m")
    r = m.select(*[M.metric(F.col("m"), n).alias(n) for n in ("tok/s", "LR", "ppl", "other", "missing")]).first()
    assert tuple(r) == (None, 2.0, None, 7.0, None)  # a name that is there ends the search


def test_wide_has_a_column_for_each_name(spark):
    rows = M.parse_log(logs(spark, "step=1/2 a=1", "step=2/2 b=2 c=x"))
    assert M.wide(rows).columns == ["file", "ord", "step", "total", "a", "b", "c"]
    with pytest.raises(ValueError, match="more than 2"):
        M.wide(rows, most=2)


def test_latest_values_are_independent(spark):
    rows = M.parse_log(logs(spark, "step=1/9 loss=3 lr=0.1", "step=2/9 loss=nan", "step=3/9 loss=2 tok_s=5", "step=4/9 loss=none lr=none"))
    assert {(r["metric"], r["value"], r["at"]) for r in M.latest(rows, "file").collect()} == {("loss", 2.0, 2), ("lr", 0.1, 0), ("tok_s", 5.0, 2)}


def test_summary_takes_the_logged_perplexity(spark):
    rows = R.segments(M.resolved(M.parse_log(logs(spark, *[f"step={i}/10 loss={10 - i} ppl={i}" for i in range(1, 6)], *[f"step={i}/10 loss={10 - i}" for i in range(6, 9)]))))
    r = M.summaries(rows, window=1).first()
    assert (r["last"], r["delta"], r["ppl"], r["progress"]) == (2.0, -7.0, 5.0, 80.0) and r["forecast"] == pytest.approx(0.0)
    done = M.summaries(rows.withColumn("total", F.lit(8)), window=1).first()
    assert done["forecast"] is None


def stamped(spark, *rows):
    df = spark.createDataFrame([("a", i, s, x) for i, (s, x) in enumerate(rows)], "file string, ord long, s double, line string")
    return M.parse_log(df.withColumn("ts", F.timestamp_seconds("s")).drop("s"))


@pytest.mark.parametrize(("now", "elapsed", "eta"), [(130.0, 70.0, 20.0), (155.0, 95.0, 0.0), (161.0, 40.0, 50.0), (90.0, 40.0, 50.0)])
def test_clocks_are_moved_on_while_live(spark, now, elapsed, eta):
    rows = stamped(spark, (0.0, "step=50/60 loss=1"), (60.0, "step=1/100 loss=1 elapsed_s=1"), (100.0, "step=41/100 loss=1 elapsed_s=40 eta_s=50 step_ms=500"))
    r = M.session_clocks(rows, F.timestamp_seconds(F.lit(now))).first()
    assert (r["elapsed_s"], r["eta_s"], r["sec_per_step"], r["started_at"].timestamp()) == (elapsed, eta, 0.5, 60.0)


def test_clocks_by_wall_time(spark):
    r = M.session_clocks(stamped(spark, (10.0, "step=1/100 loss=1"), (50.0, "step=21/100 loss=1")), F.timestamp_seconds(F.lit(52.0))).first()
    assert (r["elapsed_s"], r["sec_per_step"], r["eta_s"]) == (40.0, 2.0, 158.0)


def test_tips_fall_back_to_decisions(spark):
    rows = R.segments(M.resolved(M.parse_log(logs(spark, "step=1/9 loss=3", "step=2/9 loss=2", "step=3/9 loss=nan val_loss=none"))))
    decided = spark.createDataFrame([("a.log", 1, 0.5), ("a.log", 2, None)], "file string, ord long, val_loss double")
    r = M.tips(M.series(rows), decided).first()
    assert (r["step"], r["loss"], r["val_loss"], r["delta_loss"], r["dloss"], r["n_points"]) == (3, 2.0, 0.5, -1.0, 0.0, 3)


def test_a_line_is_matched_once(spark):
    """A filter on metrics must not write the parser out again below itself."""
    lines = spark.createDataFrame([("a", 1, "step=1/9 loss=9 loss=nan lr=0.5,, b==2"), ("a", 2, "step=2/9 loss=3 x=1=2")], "file string, ord long, line string")
    found = M.latest(M.parse_log(lines), "file")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert {r["metric"]: (r["value"], r["at"]) for r in found.collect()} == {"loss": (3.0, 2), "lr": (0.5, 1)}
    assert M.parse_log(lines).filter("ord = 1").first()["metrics"] == {"loss": None, "lr": 0.5, "b": None}
