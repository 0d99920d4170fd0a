"""Run telemetry: log rows, segments, smoothing, decisions and summaries.

Rows are (file, ord, step, ...). Windows are partitioned by ranges within a file or run (``scan``), never by a whole one: a log may hold any
share of all rows. Rows without a file are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import scan as S


def segments(rows: DataFrame, gap: int = 2000, strict: bool = True) -> DataFrame:
    """A new run where the step falls (``strict``) or doesn't rise (else), or jumps by more than ``gap``.

    The result keeps ``_range``, the range of ``ord`` that a row lies in; the operators below reuse it.
    """
    r, w = S.ranged(rows), S.local(["file"])
    cut = lambda step, before: F.coalesce(((step < before if strict else step <= before) | (step - before > gap)).cast("int"), F.lit(0))
    r = r.withColumn("_cut", cut(F.col("step"), F.lag("step").over(w)))
    per = r.groupBy("file", "_range").agg(F.min_by("step", "ord").alias("low"), F.max_by("step", "ord").alias("high"), F.sum("_cut").alias("cuts"))
    of_file = W.partitionBy("file").orderBy("_range")  # a row for each range
    per = per.withColumn("edge", cut(F.col("low"), F.lag("high").over(of_file)))
    per = per.select("file", "_range", (F.sum(F.col("edge") + F.col("cuts")).over(of_file) - F.col("cuts")).alias("_base"))
    inner = r.withColumn("_inner", F.sum("_cut").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return inner.join(per, ["file", "_range"]).withColumn("run", F.col("_base") + F.col("_inner")).drop("_base", "_inner", "_cut")


def last_sample(rows: DataFrame) -> DataFrame:
    """The last row of each step within a run; a partial aggregate instead of a sort."""
    rest = [c for c in rows.columns if c not in ("file", "run", "step")]
    return rows.groupBy("file", "run", "step").agg(F.max(F.struct("ord", *[c for c in rest if c != "ord"])).alias("r")).select("file", "run", "step", *[F.col("r")[c].alias(c) for c in rest])


def latest_segment(rows: DataFrame) -> DataFrame:
    """W4."""
    return rows.join(rows.groupBy("file").agg(F.max("run").alias("run")), ["file", "run"], "left_semi")


def step_window(rows: DataFrame, n: int = 1000) -> DataFrame:
    """Steps within n of the run's last."""
    return rows.join(rows.groupBy(*RUN).agg(F.max("step").alias("_m")), RUN).filter(F.col("step") > F.col("_m") - n).drop("_m")


#: What makes a run.
RUN = ["file", "run"]


def _frame(before: int, after: int):
    return W.partitionBy(*RUN, "_chunk").orderBy("nth").rowsBetween(-before, after)


def smoothed(rows: DataFrame, half: int = 2, back: int = 8) -> DataFrame:
    """Centred mean, causal population deviation, carried value, and changes to the first and previous known value."""
    near = S.chunked(S.numbered(rows, RUN), RUN, max(back - 1, half), half)
    dev = F.when(F.col("loss").isNotNull(), F.coalesce(F.stddev_pop("loss").over(_frame(back - 1, 0)), F.lit(0.0)))
    until = W.partitionBy(*RUN, "_chunk").orderBy("nth")
    known = S.last_known(F.col("loss"))
    local = near.withColumns({"mean": F.avg("loss").over(_frame(half, half)), "deviation": dev, "known": known.over(until.rowsBetween(W.unboundedPreceding, 0)), "prev": known.over(until.rowsBetween(W.unboundedPreceding, -1))}).filter("_own")
    at = F.when(F.col("loss").isNotNull(), F.col("nth"))
    per = local.groupBy(*RUN, "_chunk").agg(F.max_by("loss", at).alias("last"), F.min_by("loss", at).alias("head"))
    whole = W.partitionBy(*RUN).orderBy("_chunk").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = per.select(*RUN, "_chunk", S.last_known(F.col("last")).over(S.earlier(RUN, "_chunk")).alias("_known"), F.first("head", ignorenulls=True).over(whole).alias("_first"))
    both = local.join(per, [*RUN, "_chunk"])
    return both.select("file", "run", "ord", "step", "loss", "mean", "deviation", F.coalesce("known", "_known").alias("carried"), (F.col("loss") - F.col("_first")).alias("to_first"), (F.col("loss") - F.coalesce("prev", "_known")).alias("to_previous"))


def ema(rows: DataFrame, alpha: float) -> DataFrame:
    """Exponential mean by ord, nulls carry the state.

    A known value counts by ``1 - alpha`` to the power of its distance, so values beyond ``reach`` are lost in a double's rounding; a
    frame of that many known rows gives the same result as a fold over the whole run, which is never gathered.
    """
    reach = math.ceil(math.log(1e-18) / math.log(1 - alpha)) if alpha < 1 else 0
    r = S.ranged(rows)
    known = S.chunked(S.numbered(r.filter("loss is not null"), RUN), RUN, reach)
    known = known.withColumn("w", F.collect_list("loss").over(_frame(reach, 0))).filter("_own")
    fold = F.aggregate(F.slice("w", F.lit(2), F.size("w")), F.col("w")[0], lambda a, x: x * alpha + a * (1 - alpha))
    both = known.select("file", "run", "ord", "_range", fold.alias("ema")).unionByName(r.filter("loss is null").select("file", "run", "ord", "_range", F.lit(None).cast("double").alias("ema")))
    return S.carry_forward(both, RUN, "ema").select("file", "run", "ord", "ema")


def decide(rows: DataFrame, ratio: float = 1.5, patience: int = 4, max_steps: int = 600, max_wall: float | None = None, remix_below: float | None = None, remix_after: int = 0) -> DataFrame:
    """The action for each evaluation (file, run, ord, step, loss; ``wall`` seconds and ``exact`` share where those limits are given).

    Losses that are not finite are null and count for nothing else. In order: spike over the positive median of the last five known losses, this one included; step and wall
    limits; remix; early stop after ``patience`` known losses without a new best before this one; promote on a new best.
    """
    r = S.ranged(rows)
    near = S.chunked(S.numbered(r.filter("loss is not null"), RUN), RUN, 4)
    median = F.percentile("loss", 0.5).over(_frame(4, 0))
    until = W.partitionBy(*RUN, "_chunk").orderBy("nth").rowsBetween(W.unboundedPreceding, -1)
    local = near.withColumns({"spike": (median > 0) & (F.col("loss") > ratio * median), "best": F.min("loss").over(until)}).filter("_own")
    base = S.carried(local, RUN, "_chunk", _best=(F.min("loss"), F.min))
    best = F.least("best", "_best")  # nulls are left out
    marked = local.join(base, [*RUN, "_chunk"]).withColumn("better", best.isNull() | (F.col("loss") < best)).withColumn("at", F.when(F.col("better"), F.col("nth")))
    base = S.carried(marked, RUN, "_chunk", _best_at=(F.max("at"), F.max))
    placed = marked.withColumn("best_at", F.max("at").over(until)).join(base, [*RUN, "_chunk"])
    stale = F.col("nth") - 1 - F.coalesce(F.greatest("best_at", "_best_at"), F.lit(0))
    action = F.when(F.col("spike"), "spike").when(F.col("step") >= max_steps, "max_steps")
    if max_wall is not None:
        action = action.when(F.col("wall") >= max_wall, "max_wall")
    if remix_below is not None:
        action = action.when((F.col("exact") < remix_below) & (F.col("step") >= remix_after), "remix")
    action = action.when(stale >= patience, "early_stop").when(F.col("better"), "promote").otherwise("continue")
    return placed.select("file", "run", "ord", "step", action.alias("action")).unionByName(r.filter("loss is null").select("file", "run", "ord", "step", F.lit("non_finite").alias("action")))


def finite_stats(rows: DataFrame, *by: str) -> DataFrame:
    """Min, max, mean, first and last known value."""
    known = F.col("loss").isNotNull()
    return rows.groupBy(*by).agg(F.min("loss").alias("min"), F.max("loss").alias("max"), F.avg("loss").alias("mean"), F.min_by("loss", F.when(known, F.col("ord"))).alias("first"), F.max_by("loss", F.when(known, F.col("ord"))).alias("last"), F.count("loss").alias("n"))


def forecast(rows: DataFrame, last: int, target: int, half: int = 2) -> DataFrame:
    """Least-squares line over the smoothed losses of the last ``last`` rows of each run, and its value at a step; null below two points."""
    near = S.chunked(S.numbered(rows, RUN), RUN, half, half).withColumn("mean", F.avg("loss").over(_frame(half, half))).filter("_own")
    r = near.filter((F.col("nth") > F.col("_of") - last) & F.col("mean").isNotNull())
    return r.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("mean", "step").alias("slope"), F.regr_intercept("mean", "step").alias("base")).select("file", "run", "n", "slope", F.when(F.col("n") >= 2, F.col("base") + F.col("slope") * target).alias("forecast"))


def rollup(rows: DataFrame, every: int) -> DataFrame:
    """Means over each interval of steps; with ``ms`` and ``tokens`` of a step also their mean and the tokens a second."""
    more = [F.avg("ms").alias("mean_ms"), F.try_divide(F.sum("tokens") * 1000.0, F.sum("ms")).alias("tok_s")] if {"ms", "tokens"} <= set(rows.columns) else []
    return rows.groupBy("file", "run", F.floor((F.col("step") - 1) / every).alias("bucket")).agg(F.avg("loss").alias("mean_loss"), F.count(F.lit(1)).alias("rows"), F.max("step").alias("last_step"), *more)


def richest(rows: DataFrame, least: int = 50) -> DataFrame:
    """L2: each file's longest run of at least ``least`` rows, or of 2 if there is none; the latest of equals."""
    n = rows.groupBy("file", "run").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    best = n.groupBy("file").agg(F.max(F.struct((F.col("n") >= least).alias("enough"), "n", "run")).alias("b"))
    return best.select("file", "b.run", "b.n")


def trajectory(rows: DataFrame, window: int = 25) -> DataFrame:
    """Of a run's start, lowest and final known loss the step, the loss and the rolling deviation of the last ``window`` known losses."""
    near = S.chunked(S.numbered(S.ranged(rows).filter("loss is not null"), RUN), RUN, window - 1)
    r = near.withColumn("spread", F.stddev_pop("loss").over(_frame(window - 1, 0))).filter("_own")
    point = lambda f, *by: f(F.struct(*by, "step", "loss", "spread"))
    per = r.groupBy(*RUN).agg(point(F.min, "nth").alias("start"), F.min(F.struct("loss", "nth", "step", "spread")).alias("low"), point(F.max, "nth").alias("final"))
    return per.select("file", "run", *[F.col(p)[c].alias(f"{p}_{c}") for p in ("start", "low", "final") for c in ("step", "loss", "spread")])


def band(rows: DataFrame, least: int = 12) -> DataFrame:
    """The 5 and 95 percentiles of series of ``least`` known points or more, widened to hold the last one; shorter series have their least and largest."""
    known = S.ranged(rows).filter("loss is not null")
    per = known.groupBy(*RUN).agg(F.min("loss").alias("least"), F.max("loss").alias("most"), F.max_by("loss", "ord").alias("tip"))
    p = S.order_statistics(known.drop("_range"), RUN, "loss", (0.05, 0.95)).join(per, RUN)
    long = F.col("n") >= least
    return p.select("file", "run", F.when(long, F.least(F.col("p")[0], "tip")).otherwise(F.col("least")).alias("low"), F.when(long, F.greatest(F.col("p")[1], "tip")).otherwise(F.col("most")).alias("high"))


def perplexity(loss: Column) -> Column:
    """A30; null for a null loss, which ``least`` would pass over."""
    return F.when(loss.isNotNull(), F.exp(F.least(loss, F.lit(50.0))))


def trend(rows: DataFrame, stable: float = 0.02) -> DataFrame:
    """Baseline, stable, improving or regressing against the checkpoint before, by step and then ord; lower is better."""
    near = S.chunked(S.numbered(rows, RUN), RUN, 1)  # steps never fall within a run
    d = F.col("loss") - F.lag("loss").over(W.partitionBy(*RUN, "_chunk").orderBy("nth"))
    r = near.withColumn("d", d).filter("_own")
    return r.select("file", "run", "step", F.when(F.col("d").isNull(), "baseline").when(F.abs("d") < stable, "stable").when(F.col("d") < 0, "improving").otherwise("regressing").alias("trend"))


def trailing(events: DataFrame, seconds: float) -> DataFrame:
    """(key, ord, recent): the key's events of the ``seconds`` before each and at its time, by counts up to two moments, each a running sum."""
    micros, span = F.unix_micros(F.col("ts").cast("timestamp")), int(seconds * 1_000_000)
    # At equal times the start of a span stands before events, its end after them.
    kinds = F.array(F.struct((micros - span).alias("t"), F.lit(0).alias("kind")), F.struct(micros.alias("t"), F.lit(1).alias("kind")), F.struct(micros.alias("t"), F.lit(2).alias("kind")))
    marks = events.select("key", "ord", F.explode(kinds).alias("x")).select("key", "ord", "x.t", "x.kind")
    marks = marks.withColumn("at", F.struct("t", "kind", "ord"))
    r = S.in_ranges(marks, "t")
    base = S.carried(r, ["key"], "_range", _before=(F.count(F.when(F.col("kind") == 1, 1)), F.sum))
    seen = F.count(F.when(F.col("kind") == 1, 1)).over(S.local(["key"], "at").rowsBetween(W.unboundedPreceding, 0))
    seen = r.withColumn("seen", seen).join(base, ["key", "_range"]).withColumn("seen", F.col("seen") + F.coalesce("_before", F.lit(0)))
    return seen.groupBy("key", "ord").agg((F.max(F.when(F.col("kind") == 2, F.col("seen"))) - F.max(F.when(F.col("kind") == 0, F.col("seen")))).alias("recent"))


def backoff(events: DataFrame, base: float = 60.0, top: float = 3600.0) -> DataFrame:
    """Per key the events of the hour before each, and the wait after a streak of failures, by time and then ord. Events are (key, ord, ts, failed)."""
    e = S.in_ranges(events.withColumn("_t", F.unix_micros(F.col("ts").cast("timestamp"))), "_t").withColumn("_at", F.struct("_t", "ord"))
    e = S.running(S.numbered(e, ["key"], "_at"), ["key"], "_at", good=(F.when(~F.col("failed"), F.col("nth")), F.max, F.greatest))
    e = e.select("key", "ord", (F.col("nth") - F.coalesce("good", F.lit(0))).alias("streak")).join(trailing(events, 3600), ["key", "ord"])
    return e.select("key", "ord", "recent", "streak", F.when(F.col("streak") > 0, F.least(F.lit(top), base * F.pow(F.lit(2.0), F.col("streak") - 1))).otherwise(0.0).alias("wait"))


def as_of(rows: DataFrame, facts: DataFrame, keys: list[str], *names: str, by: str = "ord") -> DataFrame:
    """``rows`` with the named columns' last known values among the key's ``facts`` before each; at an equal place the fact is first.

    A union and a carry in ranges, so a key of any size is split; no row meets more than one other.
    """
    both = rows.withColumn("_kind", F.lit(1)).unionByName(facts.select(*keys, by, *names).withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    both = S.in_ranges(both, by).withColumn("_at", F.struct(by, "_kind"))
    return S.carry_forward(both, keys, *names, by="_at").filter("_kind = 1").drop("_kind", "_at", "_range")
