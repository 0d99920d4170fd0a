"""Metrics of runs with open names: parsing, latest values, wide tables, summaries, series and clocks.

A row's metrics are a map, so a log may carry any set of names. Windows follow ``scan``: a file of any size is split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import runs as R
from . import scan as S

#: The names that mean one metric, in the order in which they are looked for.
ALIASES = {
    "tok/s": ("tok/s", "tok_s", "toks", "tokens_per_sec"),
    "step_ms": ("step_ms", "stepms", "ms_per_step"),
    "grad_norm": ("grad_norm", "gradnorm"),
    "device_used_mb": ("device_used_mb", "device_mb", "gpu_mb"),
    "lr": ("lr", "learning_rate"),
    "ppl": ("ppl", "val_ppl", "perplexity"),
}
LOSS = ("loss", "avg_loss")
#: A log is live if written within this many seconds; the clocks of its last line are moved on by at most the slack.
LIVE_AGE, CLOCK_SLACK = 60.0, 90.0


def number(raw: Column) -> Column:
    """A metric's value; trailing commas go, what is no finite number is null."""
    x = F.regexp_replace(F.trim(raw), ",+$", "").try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def parse_log(lines: DataFrame) -> DataFrame:
    """(the other columns, step, total, metrics) of the lines that name a step; of a repeated key the last counts.

    Each step is a projection of its own, so that a line is matched once and a value is read once.
    """
    own = [c for c in lines.columns if c != "line"]
    step, total = (F.regexp_extract("line", r"step=(\d+)/(\d+)", i) for i in (1, 2))
    rows = lines.filter(F.rlike("line", F.lit(r"step=\d+/\d"))).select(*own, step.try_cast("long").alias("step"), total.try_cast("long").alias("total"), F.regexp_extract_all("line", F.lit(r"[a-zA-Z0-9_/]+=[^\s]+"), F.lit(0)).alias("_p"))
    # Pairs by place: the name before the first "=", the value without trailing commas; texts that are no number are null.
    pairs = F.transform("_p", lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_replace(F.substr(p, F.instr(p, "=") + 1), ",+$", "").try_cast("double").alias("v")))
    rows = rows.select(*own, "step", "total", pairs.alias("_p"))
    rows = rows.select(*own, "step", "total", F.reverse(F.filter("_p", lambda p: p["k"] != "step")).alias("_p"))
    rows = rows.select(*own, "step", "total", "_p", F.col("_p.k").alias("_k"))
    last = F.filter("_p", lambda p, i: F.array_position("_k", p["k"]) == i + 1)
    finite = lambda p: F.struct(p["k"].alias("k"), F.when(F.abs(p["v"]) < float("inf"), p["v"]).alias("v"))  # noqa: E731  # a NaN is above all
    return S.once(rows.select(*own, "step", "total", F.map_from_entries(F.transform(last, finite)).alias("metrics")))


def metric(metrics: Column, name: str) -> Column:
    """A metric under the first of its names that the map has; a present but unknown value ends the search, as an absent name doesn't."""
    names = next((a for a in ALIASES.values() if name.lower() in a), (name,))
    value = F.lit(None).cast("double")
    for n in reversed(names):
        value = F.when(F.map_contains_key(metrics, n), F.try_element_at(metrics, F.lit(n))).otherwise(value)
    return value


def loss_of(metrics: Column) -> Column:
    """``loss``, else ``avg_loss``."""
    return F.coalesce(*[F.try_element_at(metrics, F.lit(n)) for n in LOSS])


def latest(rows: DataFrame, *keys: str, by: str = "ord") -> DataFrame:
    """(keys, metric, value, at) of each metric's last known value, whatever the other metrics of its row. One partial aggregate."""
    each = rows.select(*keys, by, F.explode("metrics").alias("metric", "value")).filter("value is not null")
    return each.groupBy(*keys, "metric").agg(F.max_by("value", by).alias("value"), F.max(by).alias("at"))


def wide(rows: DataFrame, most: int = 200) -> DataFrame:
    """A column for every metric that any row names, in name order; more than ``most`` names are an error."""
    names = sorted(r["k"] for r in rows.select(F.explode(F.map_keys("metrics")).alias("k")).distinct().limit(most + 1).collect())
    if len(names) > most:
        raise ValueError(f"more than {most} metrics")
    return rows.select(*[c for c in rows.columns if c != "metrics"], *[F.try_element_at("metrics", F.lit(n)).alias(n) for n in names if n not in rows.columns])


def resolved(rows: DataFrame) -> DataFrame:
    """(file, ord, step, total, loss, ppl, tok_s, val_loss) of parsed rows."""
    m = F.col("metrics")
    return rows.select("file", "ord", "step", "total", loss_of(m).alias("loss"), metric(m, "ppl").alias("ppl"), metric(m, "tok/s").alias("tok_s"), F.try_element_at(m, F.lit("val_loss")).alias("val_loss"))


def _near(rows: DataFrame, before: int, after: int) -> DataFrame:
    return S.chunked(S.numbered(rows, R.RUN), R.RUN, before, after)


def summaries(rows: DataFrame, window: int = 9, last: int = 200) -> DataFrame:
    """R2: for each run of ``resolved`` rows the last smoothed loss, its change from the first, perplexity (of the loss where a run logs none), the
    loss forecast at the total from the smoothed losses of the last rows, the mean speed and the progress."""
    half = window // 2
    mean = lambda c: F.avg(c).over(R._frame(half, half))
    near = _near(rows, half, half).withColumn("_exp", R.perplexity(F.col("loss")))
    near = near.withColumns({"m_loss": mean("loss"), "m_ppl": mean("ppl"), "m_exp": mean("_exp")}).filter("_own")
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("nth"))
    tail = F.when(F.col("nth") > F.col("_of") - last, F.col("m_loss"))
    per = near.groupBy(*R.RUN).agg(
        F.max_by("m_loss", at("m_loss")).alias("last"), F.min_by("m_loss", at("m_loss")).alias("first"), F.max_by("m_ppl", at("m_ppl")).alias("ppl"), F.max_by("m_exp", at("m_exp")).alias("exp"), F.count(tail).alias("n"),
        F.regr_slope(tail, F.col("step").cast("double")).alias("slope"), F.regr_intercept(tail, F.col("step").cast("double")).alias("base"), F.avg("tok_s").alias("tok_s"), F.max_by("step", "nth").alias("step"), F.max("total").alias("total"),
    )
    forecast = F.when((F.col("total") > F.col("step")) & (F.col("n") >= 2), F.col("base") + F.col("slope") * F.col("total"))
    return per.select("file", "run", "last", (F.col("last") - F.col("first")).alias("delta"), F.coalesce("ppl", "exp").alias("ppl"), forecast.alias("forecast"), "tok_s", (100 * F.try_divide("step", "total")).alias("progress"))


def series(rows: DataFrame, window: int = 8) -> DataFrame:
    """For each row of ``resolved`` loss, perplexity and speed carried forward, ``val_loss`` as it is, and the deviation of the last ``window`` carried losses."""
    logs_ppl = rows.groupBy(*R.RUN).agg(F.bool_or(F.col("ppl").isNotNull()).alias("_has"))
    r = rows.join(logs_ppl, R.RUN).withColumn("ppl", F.when(F.col("_has"), F.col("ppl")).otherwise(R.perplexity(F.col("loss")))).drop("_has")
    r = S.carry_forward(r, R.RUN, "loss", "ppl", "tok_s")
    spread = F.when(F.col("loss").isNotNull(), F.coalesce(F.stddev_pop("loss").over(R._frame(window - 1, 0)), F.lit(0.0)))
    near = _near(r, window - 1, 0).withColumn("volatility", spread).filter("_own")
    return near.select("file", "run", "ord", "step", "total", "loss", "ppl", "tok_s", "val_loss", "volatility", "nth", "_of")


def tips(of: DataFrame, decisions: DataFrame) -> DataFrame:
    """The last row of each run of ``series``, with changes and counts; ``val_loss`` is the log's last row's, else the last known one of the file's decisions (file, ord, val_loss)."""
    known = F.when(F.col("loss").isNotNull(), F.col("nth"))
    before = F.when(F.col("nth") < F.col("_of"), known)
    per = of.groupBy(*R.RUN).agg(
        F.max_by(F.struct("step", "total", "loss", "ppl", "tok_s", "val_loss"), "nth").alias("tip"), F.min_by("loss", known).alias("head"), F.max_by("loss", before).alias("prev"), F.count(F.lit(1)).alias("n_points"), F.min("loss").alias("least"), F.max("loss").alias("most"), F.avg("loss").alias("mean"),
    )
    decided = decisions.groupBy("file").agg(F.max_by("val_loss", F.when(F.col("val_loss").isNotNull(), F.col("ord"))).alias("decided"))
    return per.join(decided, "file", "left").select("file", "run", "tip.step", "tip.total", "tip.loss", "tip.ppl", "tip.tok_s", F.coalesce("tip.val_loss", "decided").alias("val_loss"), (F.col("tip.loss") - F.col("head")).alias("delta_loss"), (F.col("tip.loss") - F.col("prev")).alias("dloss"), "n_points", F.col("least").alias("loss_min"), F.col("most").alias("loss_max"), F.col("mean").alias("loss_mean"))


def session_clocks(rows: DataFrame, now: Column) -> DataFrame:
    """Elapsed and remaining seconds and seconds a step of each file's current session, of rows (file, ord, ts, step, total, metrics).

    The trailing rows whose step never fell count, of those with a loss. The last line's own clocks are preferred; while the file is live (its last line of any kind is under ``LIVE_AGE``
    seconds old) they are moved on by the line's age up to ``CLOCK_SLACK``. Without them the wall time and the steps of the session count.
    """
    seconds = lambda c: c.cast("timestamp").cast("double")
    m, w, known = F.col("metrics"), S.local(["file"]), F.col("known")
    clocks = [F.try_element_at(m, F.lit(k)).alias(k) for k in ("elapsed_s", "eta_s", "step_ms")]
    r = S.once(S.ranged(rows).select("file", "_range", "ord", seconds(F.col("ts")).alias("t"), "step", "total", *clocks, loss_of(m).isNotNull().alias("known")))
    # Rows without a loss only say when the file was written. One shuffle: ranges are told apart by a row of summary each.
    before = F.last(F.when(known, F.struct("step")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))["step"]
    r = r.withColumn("cut", F.coalesce((known & (F.col("step") < before)).cast("int"), F.lit(0))).withColumn("inner", F.sum("cut").over(w.rowsBetween(W.unboundedPreceding, 0)))
    pick, at = F.struct("t", "step", "total", "elapsed_s", "eta_s", "step_ms"), F.when(known, F.col("ord"))
    per = r.groupBy("file", "_range").agg(
        F.max("t").alias("written"), F.sum("cut").alias("cuts"), F.count(at).alias("n"), F.min_by("step", at).alias("low"), F.max_by("step", at).alias("high"), F.min_by(pick, F.when(known, F.struct(-F.col("inner"), "ord"))).alias("a"), F.max_by(pick, at).alias("b"),
    )
    of_file = W.partitionBy("file").orderBy("_range")  # a row for each range
    ends = per.filter("n > 0").withColumn("fell", F.coalesce(F.col("low") < F.lag("high").over(of_file), F.lit(False)) | (F.col("cuts") > 0) | (F.row_number().over(of_file) == 1))
    session = ends.groupBy("file").agg(F.max_by("a", F.when(F.col("fell"), F.col("_range"))).alias("a"), F.max_by("b", "_range").alias("b"))
    per = session.join(per.groupBy("file").agg(F.max("written").alias("written")), "file")
    age = seconds(now) - F.col("b.t")
    live = (seconds(now) - F.col("written") < LIVE_AGE) & age.between(0.0, CLOCK_SLACK)
    on = F.when(live, age).otherwise(0.0)
    span, steps, left = F.greatest(F.lit(0.0), F.col("b.t") - F.col("a.t")), F.col("b.step") - F.col("a.step"), F.col("b.total") - F.col("b.step")
    own = F.col("b.elapsed_s").isNotNull()
    eta_own = F.when(live, F.greatest(F.lit(0.0), F.col("b.eta_s") - age)).otherwise(F.col("b.eta_s"))
    pace = F.when((span > 0) & (steps > 0), span / steps)
    pace_own = F.when(F.col("b.step_ms") > 0, F.col("b.step_ms") / 1000.0).when(eta_own.isNotNull() & (left > 0), eta_own / left)
    return per.select("file", F.timestamp_seconds("a.t").alias("started_at"), F.when(own, F.col("b.elapsed_s") + on).otherwise(span).alias("elapsed_s"), F.when(own, eta_own).otherwise(pace * F.greatest(F.lit(0), left)).alias("eta_s"), F.when(own, pace_own).otherwise(pace).alias("sec_per_step"))
