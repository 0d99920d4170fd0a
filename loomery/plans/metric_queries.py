"""Registered queries over logs with open metrics, with their SQL. Logs are rendered from events and parsed again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import runs as R
from ..operators import scan as S
from ..sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def lines(spark: SparkSession, d: str) -> DataFrame:
    """(file, ord, ts, line): a log for each event type. Metrics come and go, repeat, and are sometimes no number; every 11th line has no step."""
    e, i = table(spark, d, "events"), F.col("event_id")
    v = F.format_string("%.4f", "value")
    part = lambda when, *xs: F.when(when, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])).otherwise("")
    step = F.when(i % 11 == 10, F.lit("no step here")).otherwise(F.concat(F.lit("[train] step="), (i % 700).cast("string"), F.lit("/"), F.when(i % 2 == 0, "700").otherwise("900")))
    text = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" | INFO | trainer | "), step, F.lit(" loss=9.9 loss="), F.when(i % 7 == 0, F.lit("nan")).otherwise(v), part(i % 3 == 0, " tok_s=", (i % 90).cast("string"), ","),
        part(i % 5 == 1, " tok/s=", (i % 70).cast("string")), part(i % 4 == 0, " lr=0.", F.lpad((i % 1000).cast("string"), 3, "0")), part(i % 6 == 0, " val_loss=", F.when(i % 12 == 0, F.lit("None")).otherwise(v)),
        part(i % 8 == 0, " grad_norm=", F.when(i % 16 == 0, F.lit("-Inf")).otherwise(v)), part(i % 10 < 5, " elapsed_s=", (i % 700).cast("string"), " eta_s=", (F.lit(700) - i % 700).cast("string")), part(i % 20 == 2, " step_ms=", (i % 300).cast("string")),
    )
    return S.once(e.select(F.col("event_type").alias("file"), i.alias("ord"), "ts", text.alias("line")))


#: The same values straight from the events.
ROWS = """select event_type as file, event_id as ord, ts, event_id % 700 as step, case when event_id % 2 = 0 then 700 else 900 end as total, case when event_id % 7 <> 0 then round(value, 4) end as loss, case when event_id % 3 = 0 then event_id % 90 end as tok_s,
  case when event_id % 5 = 1 then event_id % 70 end as tok, case when event_id % 4 = 0 then (event_id % 1000) / 1000.0 end as lr, case when event_id % 6 = 0 and event_id % 12 <> 0 then round(value, 4) end as val_loss,
  case when event_id % 8 = 0 and event_id % 16 <> 0 then round(value, 4) end as grad_norm, case when event_id % 10 < 5 then event_id % 700 end as elapsed_s, case when event_id % 10 < 5 then 700 - event_id % 700 end as eta_s, case when event_id % 20 = 2 then event_id % 300 end as step_ms,
  1 + cast(event_id % 3 = 0 as int) + cast(event_id % 5 = 1 as int) + cast(event_id % 4 = 0 as int) + cast(event_id % 6 = 0 as int) + cast(event_id % 8 = 0 as int) + 2 * cast(event_id % 10 < 5 as int) + cast(event_id % 20 = 2 as int) as n_metrics from events where event_id % 11 <> 10"""
RUNS = f"select *, coalesce(sum(cut) over (partition by file order by ord), 0) as run from (select *, case when step < lag(step) over (partition by file order by ord) or step - lag(step) over (partition by file order by ord) > 2000 then 1 else 0 end as cut from ({ROWS}))"
#: What the operators take as the metric: the first name that a row has.
NAMED = f"select file, run, ord, step, total, loss, null::double as ppl, cast(coalesce(tok, tok_s) as double) as tok_s, val_loss from ({RUNS})"


def parsed(spark: SparkSession, d: str) -> DataFrame:
    return M.parse_log(lines(spark, d))


def runs(spark: SparkSession, d: str) -> DataFrame:
    return R.segments(M.resolved(parsed(spark, d)))


@query(f"select file, ord, step, cast(total as bigint) as total, loss, cast(tok_s as double) as tok_s, cast(tok as double) as \"tok/s\", cast(lr as double) as lr, val_loss, grad_norm, cast(elapsed_s as double) as elapsed_s, cast(eta_s as double) as eta_s, cast(step_ms as double) as step_ms, n_metrics from ({ROWS})")
def parsed_log(spark: SparkSession, d: str) -> DataFrame:
    """Every ``key=value`` of the lines, as a column for each name that occurs."""
    rows = parsed(spark, d).drop("ts").withColumn("n_metrics", F.size("metrics"))
    return M.wide(rows)


EACH = " union all ".join(f"select file, ord, '{n}' as metric, cast({c} as double) as value from ({ROWS})" for n, c in (("loss", "loss"), ("tok_s", "tok_s"), ("tok/s", "tok"), ("lr", "lr"), ("val_loss", "val_loss"), ("grad_norm", "grad_norm"), ("elapsed_s", "elapsed_s"), ("eta_s", "eta_s"), ("step_ms", "step_ms")))


@query(f"select file, metric, arg_max(value, ord) as value, max(ord) as at from ({EACH}) where value is not null group by 1, 2")
def latest_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Each metric's own last value."""
    return M.latest(parsed(spark, d), "file")


@query(f"""with s as (select *, avg(loss) over w as m, avg(case when loss is not null then exp(least(loss, 50.0)) end) over w as x, row_number() over (partition by file, run order by ord desc) as back from ({NAMED}) window w as (partition by file, run order by ord rows between 4 preceding and 4 following)),
t as (select *, case when back <= 200 then m end as tail from s)
select file, run, round(arg_max(m, ord) filter (where m is not null), 6) as last, round(arg_max(m, ord) filter (where m is not null) - arg_min(m, ord) filter (where m is not null), 6) as delta, round(arg_max(x, ord) filter (where x is not null) / 1e6, 6) as ppl,
  round(case when max(total) > arg_max(step, ord) and count(tail) >= 2 and count(distinct case when tail is not null then step end) > 1 then regr_intercept(tail, step) + regr_slope(tail, step) * max(total) end, 4) as forecast, round(avg(tok_s), 6) as tok_s, round(100.0 * arg_max(step, ord) / max(total), 6) as progress from t group by 1, 2""")
def run_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Perplexity in millions, as the losses are far from a model's."""
    s = M.summaries(runs(spark, d))
    return s.select("file", "run", *[F.round(c, 6).alias(c) for c in ("last", "delta")], F.round(F.col("ppl") / 1e6, 6).alias("ppl"), F.round("forecast", 4).alias("forecast"), F.round("tok_s", 6).alias("tok_s"), F.round("progress", 6).alias("progress"))


CARRIED = f"""select file, run, ord, step, total, last_value(loss ignore nulls) over w as loss, last_value(case when loss is not null then exp(least(loss, 50.0)) end ignore nulls) over w as ppl, last_value(tok_s ignore nulls) over w as tok_s, val_loss
  from ({NAMED}) window w as (partition by file, run order by ord rows unbounded preceding)"""


@query(f"""select file, run, ord, step, loss, round(ln(ppl), 6) as log_ppl, tok_s, val_loss, round(case when loss is not null then stddev_pop(loss) over (partition by file, run order by ord rows between 7 preceding and current row) end, 6) as volatility from ({CARRIED})""")
def run_series(spark: SparkSession, d: str) -> DataFrame:
    """R5."""
    s = M.series(runs(spark, d))
    return s.select("file", "run", "ord", "step", "loss", F.round(F.log("ppl"), 6).alias("log_ppl"), "tok_s", "val_loss", F.round("volatility", 6).alias("volatility"))


@query(f"""with c as (select *, row_number() over (partition by file, run order by ord desc) as back from ({CARRIED})), g as (select event_type as file, arg_max(value, event_id) filter (where event_id % 9 = 4) as decided from events group by 1)
select file, run, arg_max(step, ord) as step, cast(arg_max(total, ord) as bigint) as total, max(case when back = 1 then loss end) as loss, max(case when back = 1 then tok_s end) as tok_s, coalesce(max(case when back = 1 then val_loss end), any_value(decided)) as val_loss,
  round(max(case when back = 1 then loss end) - arg_min(loss, ord) filter (where loss is not null), 6) as delta_loss, round(max(case when back = 1 then loss end) - arg_max(loss, ord) filter (where back > 1 and loss is not null), 6) as dloss,
  count(*) as n_points, min(loss) as loss_min, max(loss) as loss_max, round(avg(loss), 6) as loss_mean from c left join g using (file) group by 1, 2""")
def run_tips(spark: SparkSession, d: str) -> DataFrame:
    """Every ninth event stands for a decision with a loss of its own."""
    e = table(spark, d, "events")
    decisions = e.select(F.col("event_type").alias("file"), F.col("event_id").alias("ord"), F.when(F.col("event_id") % 9 == 4, F.col("value")).alias("val_loss"))
    t = M.tips(M.series(runs(spark, d)), decisions)
    return t.drop("ppl").select(*[F.round(c, 6).alias(c) if c in ("delta_loss", "dloss", "loss_mean") else c for c in t.columns if c != "ppl"])


CLOCKS = f"""with n as (select epoch(max(ts)) + 20 as now from events), w as (select event_type as file, epoch(max(ts)) as written from events where event_id % 11 <> 10 group by 1),
k as (select * from ({ROWS}) where loss is not null), s as (select *, sum(cut) over (partition by file order by ord) as run from (select *, case when step < lag(step) over (partition by file order by ord) then 1 else 0 end as cut from k)),
l as (select * from s qualify run = max(run) over (partition by file)), p as (select file, epoch(arg_min(ts, ord)) as t0, epoch(arg_max(ts, ord)) as t1, arg_min(step, ord) as s0, arg_max(step, ord) as s1, arg_max(total, ord) as total, max_by(coalesce(elapsed_s, -1), ord) as el, max_by(coalesce(eta_s, -1), ord) as eta, max_by(coalesce(step_ms, -1), ord) as ms from l group by 1),
a as (select *, now - t1 as age, now - written < 60 and now - t1 between 0 and 90 as live from p join w using (file), n),
b as (select *, case when eta >= 0 then case when live then greatest(0, eta - age) else eta end end as eta_own from a)
select file, round(t0, 3) as started, round(case when el >= 0 then el + case when live then age else 0 end else greatest(0, t1 - t0) end, 3) as elapsed_s, round(case when el >= 0 then eta_own when t1 > t0 and s1 > s0 then (t1 - t0) / (s1 - s0) * greatest(0, total - s1) end, 3) as eta_s,
  round(case when el >= 0 then case when ms > 0 then ms / 1000.0 when eta_own is not null and total > s1 then eta_own / (total - s1) end when t1 > t0 and s1 > s0 then (t1 - t0) / (s1 - s0) end, 6) as sec_per_step from b"""


@query(CLOCKS)
def session_clocks(spark: SparkSession, d: str) -> DataFrame:
    """Seen 20 seconds after the last event."""
    e = table(spark, d, "events")
    now = F.timestamp_seconds(F.lit(e.agg(F.max(F.col("ts").cast("timestamp").cast("double"))).first()[0] + 20))
    c = M.session_clocks(M.parse_log(S.in_ranges(lines(spark, d), "ord")), now)
    return c.select("file", F.round(F.col("started_at").cast("double"), 3).alias("started"), F.round("elapsed_s", 3).alias("elapsed_s"), F.round("eta_s", 3).alias("eta_s"), F.round("sec_per_step", 6).alias("sec_per_step"))
