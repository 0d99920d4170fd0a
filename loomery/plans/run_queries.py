"""Registered queries over run telemetry and arrays, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import runs as R
from ..operators import tensors as A
from ..operators.reports import tensor_role
from ..sources.tables import table, tail

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def rows(spark: SparkSession, d: str) -> DataFrame:
    """Evaluations derived from events: the file is the type, steps start over every 700."""
    return table(spark, d, "events").select(F.col("event_type").alias("file"), F.col("event_id").alias("ord"), (F.col("event_id") % 700).alias("step"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("loss"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    return R.segments(rows(spark, d))


ROWS = "select event_type as file, event_id as ord, event_id % 700 as step, case when event_id % 7 <> 0 then value end as loss from events"
RUNS = f"select file, ord, step, loss, coalesce(sum(cut) over (partition by file order by ord), 0) as run from (select *, case when step < lag(step) over (partition by file order by ord) or step - lag(step) over (partition by file order by ord) > 2000 then 1 else 0 end as cut from ({ROWS}))"
R6 = lambda *cs: ", ".join(f"round({c}, 6) as {c}" for c in cs)


def r6(df: DataFrame, *cs: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in cs else c for c in df.columns])


@query(f"select file, run, count(*) as n, min(step) as first_step, max(step) as last_step from ({RUNS}) group by 1, 2")
def run_segments(spark: SparkSession, d: str) -> DataFrame:
    return runs(spark, d).groupBy("file", "run").agg(F.count(F.lit(1)).alias("n"), F.min("step").alias("first_step"), F.max("step").alias("last_step"))


@query(f"select file, run, step, max(ord) as ord, arg_max(coalesce(loss, -1), ord) as loss from ({RUNS}) group by 1, 2, 3")
def last_sample_per_step(spark: SparkSession, d: str) -> DataFrame:
    return R.last_sample(runs(spark, d)).select("file", "run", "step", "ord", F.coalesce("loss", F.lit(-1.0)).alias("loss"))


@query(f"select * from ({RUNS}) qualify run = max(run) over (partition by file)")
def latest_segment(spark: SparkSession, d: str) -> DataFrame:
    return R.latest_segment(runs(spark, d)).select("file", "ord", "step", "loss", "run")


@query(f"select * from ({RUNS}) qualify step > max(step) over (partition by file, run) - 100")
def step_window(spark: SparkSession, d: str) -> DataFrame:
    return R.step_window(runs(spark, d), 100).select("file", "ord", "step", "loss", "run")


@query(f"""select file, run, ord, step, loss, round(avg(loss) over (w rows between 2 preceding and 2 following), 6) as mean,
  round(case when loss is not null then coalesce(stddev_pop(loss) over (w rows between 7 preceding and current row), 0) end, 6) as deviation,
  last_value(loss ignore nulls) over (w rows between unbounded preceding and current row) as carried,
  round(loss - first_value(loss ignore nulls) over (w rows between unbounded preceding and unbounded following), 6) as to_first,
  round(loss - last_value(loss ignore nulls) over (w rows between unbounded preceding and 1 preceding), 6) as to_previous
  from ({RUNS}) window w as (partition by file, run order by ord)""")
def smoothed_series(spark: SparkSession, d: str) -> DataFrame:
    """W6, W7, W9, W10, J21."""
    return r6(R.smoothed(runs(spark, d)), "mean", "deviation", "to_first", "to_previous")


@query(f"""with k as (select file, run, ord, list_reduce(list(loss) over (partition by file, run order by ord rows between unbounded preceding and current row), lambda a, x: x * 0.3 + a * 0.7) as e from ({RUNS}) where loss is not null)
  select file, run, ord, round(last_value(e ignore nulls) over (partition by file, run order by ord rows between unbounded preceding and current row), 6) as ema from ({RUNS}) left join k using (file, run, ord)""")
def exponential_mean(spark: SparkSession, d: str) -> DataFrame:
    """W8."""
    return r6(R.ema(runs(spark, d), 0.3), "ema")


def decisions_sql(arms: str = "") -> str:
    return f"""with m as (select *, quantile_cont(loss, 0.5) over (w rows between 4 preceding and current row) as med, min(loss) over (w rows between unbounded preceding and 1 preceding) as best, row_number() over w as nth
  from ({RUNS}) where loss is not null window w as (partition by file, run order by ord)),
b as (select *, best is null or loss < best as better from m), c as (select *, coalesce(max(case when better then nth end) over (partition by file, run order by ord rows between unbounded preceding and 1 preceding), 0) as best_at from b)
select file, run, ord, step, case when med > 0 and loss > 1.5 * med then 'spike' when step >= 600 then 'max_steps' {arms} when nth - 1 - best_at >= 4 then 'early_stop' when better then 'promote' else 'continue' end as action from c
union all select file, run, ord, step, 'non_finite' from ({RUNS}) where loss is null"""


@query(decisions_sql("when step * 2.0 >= 1100 then 'max_wall' when (ord % 10) / 10.0 < 0.2 and step >= 300 then 'remix'"))
def run_decisions(spark: SparkSession, d: str) -> DataFrame:
    """W13, with the wall clock and the exact share derived from step and place."""
    rows = runs(spark, d).withColumns({"wall": F.col("step") * 2.0, "exact": (F.col("ord") % 10) / 10.0})
    return R.decide(rows, max_wall=1100, remix_below=0.2, remix_after=300)


@query(f"select file, min(loss) as min, max(loss) as max, round(avg(loss), 6) as mean, arg_min(loss, ord) as first, arg_max(loss, ord) as last, count(loss) as n from ({ROWS}) where loss is not null group by 1")
def finite_stats(spark: SparkSession, d: str) -> DataFrame:
    return r6(R.finite_stats(rows(spark, d), "file"), "mean")


SMOOTH = f"select *, avg(loss) over (partition by file, run order by ord rows between 2 preceding and 2 following) as mean, row_number() over (partition by file, run order by ord desc) as back from ({RUNS})"
LAST = f"select * from ({SMOOTH}) where back <= 20 and mean is not null"


@query(f"select file, run, count(*) as n, round(case when count(distinct step) > 1 then regr_slope(mean, step) end, 6) as slope, round(case when count(distinct step) > 1 then regr_intercept(mean, step) + regr_slope(mean, step) * 1000 end, 4) as forecast from ({LAST}) group by 1, 2")
def loss_forecast(spark: SparkSession, d: str) -> DataFrame:
    """R1, over smoothed losses."""
    f = R.forecast(runs(spark, d), 20, 1000)
    return f.select("file", "run", "n", F.round("slope", 6).alias("slope"), F.round("forecast", 4).alias("forecast"))


@query(f"select file, run, (step - 1) // 50 as bucket, round(avg(loss), 6) as mean_loss, count(*) as rows, max(step) as last_step, round(avg(100 + ord % 50), 6) as mean_ms, round(count(*) * 4096 * 1000.0 / sum(100 + ord % 50), 6) as tok_s from ({RUNS}) where step > 0 group by 1, 2, 3")
def interval_rollup(spark: SparkSession, d: str) -> DataFrame:
    """A step's time derived from its place, 4096 tokens each."""
    rows = runs(spark, d).filter("step > 0").withColumns({"ms": F.col("ord") % 50 + 100, "tokens": F.lit(4096).cast("long")})
    return r6(R.rollup(rows, 50), "mean_loss", "mean_ms", "tok_s")


@query(f"select file, run, n from (select file, run, count(*) as n from ({RUNS}) group by 1, 2 having count(*) >= 2) qualify row_number() over (partition by file order by (n >= 50) desc, n desc, run desc) = 1")
def richest_run(spark: SparkSession, d: str) -> DataFrame:
    return R.richest(runs(spark, d))


@query(f"""with k as (select *, stddev_pop(loss) over (partition by file, run order by ord rows between 24 preceding and current row) as spread from ({RUNS}) where loss is not null)
select file, run, arg_min(step, ord) as start_step, arg_min(loss, ord) as start_loss, round(arg_min(spread, ord), 6) as start_spread, arg_max(step, ord) as final_step, arg_max(loss, ord) as final_loss, round(arg_max(spread, ord), 6) as final_spread,
  (min(row(loss, ord, step, spread)))[3] as low_step, min(loss) as low_loss, round((min(row(loss, ord, step, spread)))[4], 6) as low_spread from k group by 1, 2""")
def run_trajectory(spark: SparkSession, d: str) -> DataFrame:
    """R4."""
    return r6(R.trajectory(runs(spark, d)), "start_spread", "low_spread", "final_spread")


@query(f"select file, run, round(case when count(*) >= 12 then least(quantile_cont(loss, 0.05), arg_max(loss, ord)) else min(loss) end, 6) as low, round(case when count(*) >= 12 then greatest(quantile_cont(loss, 0.95), arg_max(loss, ord)) else max(loss) end, 6) as high from ({RUNS}) where loss is not null group by 1, 2")
def percentile_band(spark: SparkSession, d: str) -> DataFrame:
    """R3."""
    return r6(R.band(runs(spark, d)), "low", "high")


@query(f"select file, run, round(exp(least(avg(loss), 50.0)), 3) as ppl from ({RUNS}) where loss is not null group by 1, 2")
def run_perplexity(spark: SparkSession, d: str) -> DataFrame:
    return runs(spark, d).filter("loss is not null").groupBy("file", "run").agg(F.round(R.perplexity(F.avg("loss")), 3).alias("ppl"))


@query(f"select file, run, step, case when d is null then 'baseline' when abs(d) < 0.02 then 'stable' when d < 0 then 'improving' else 'regressing' end as trend from (select *, loss - lag(loss) over (partition by file, run order by step, ord) as d from ({RUNS}) where loss is not null)")
def checkpoint_trend(spark: SparkSession, d: str) -> DataFrame:
    return R.trend(runs(spark, d).filter("loss is not null"))


@query(f"select file, ord, step, loss from ({ROWS}) qualify row_number() over (partition by file order by ord desc) <= 80")
def log_tail(spark: SparkSession, d: str) -> DataFrame:
    return tail(rows(spark, d), 80)


BACK = """with e as (select event_type as key, event_id as ord, ts, value < 5 as failed from events),
g as (select *, count(*) over (partition by key order by ts range between interval 1 hour preceding and current row) as recent, sum(case when failed then 0 else 1 end) over (partition by key order by ts, ord rows unbounded preceding) as g from e),
s as (select *, sum(case when failed then 1 else 0 end) over (partition by key, g order by ts, ord rows unbounded preceding) as streak from g)
select key, ord, recent, streak, case when streak > 0 then least(3600.0, 60.0 * power(2.0, streak - 1)) else 0.0 end as wait from s"""


@query(BACK)
def retry_backoff(spark: SparkSession, d: str) -> DataFrame:
    return R.backoff(table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("ord"), "ts", (F.col("value") < 5).alias("failed")))


@query("""with e as (select user_id as run, event_id as ord, event_type as kind, value from events), b as (select *, last_value(case when kind = 'purchase' then value end ignore nulls) over (partition by run order by ord rows between unbounded preceding and 1 preceding) as val_loss,
  last_value(case when kind = 'purchase' then ord end ignore nulls) over (partition by run order by ord rows between unbounded preceding and 1 preceding) as decided_at from e) select run, ord, kind, value, val_loss, decided_at from b where kind <> 'purchase'""")
def decision_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Each event of a user with the value and place of the last purchase before it, which stands for a run's decision."""
    e = table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("ord"), F.col("event_type").alias("kind"), "value")
    facts = e.filter("kind = 'purchase'").select("run", "ord", F.col("value").alias("val_loss"), F.col("ord").alias("decided_at"))
    return R.as_of(e.filter("kind <> 'purchase'"), facts, ["run"], "val_loss", "decided_at")


@query("select event_type as name, count(*) as n, round(sum(value), 3) as total, max(value) as largest, round(100 * sum(value) / sum(sum(value)) over (), 4) as share from events group by 1")
def kernel_summary(spark: SparkSession, d: str) -> DataFrame:
    """A19 to A21."""
    from pyspark.sql import Window as W

    per = table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.max("value").alias("largest"))
    return per.select("name", "n", F.round("s", 3).alias("total"), "largest", F.round(100 * F.col("s") / F.sum("s").over(W.partitionBy()), 4).alias("share"))  # one row for each name


def cells(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "label", F.posexplode("embedding").alias("j", "x"))


CELLS = "select vec_id, label, unnest(embedding) as x, unnest(range(len(embedding))) as j from embeddings"


@query(f"select label, count(x) as n, min(x) as min, max(x) as max, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std, round(sqrt(avg(x * x)), 6) as rms, round(sqrt(sum(x * x)), 6) as l2, max(abs(x)) as abs_max, 0::bigint as nans, 0::bigint as infs, round(count(*) filter (where abs(x) < 0.01) / count(x), 6) as near_zero, case when count(*) filter (where abs(x) < 0.01) / count(x) > 0.1 then 'sparse' else '' end as flags from (select label, cast(x as double) as x from ({CELLS})) group by 1")
def tensor_stats(spark: SparkSession, d: str) -> DataFrame:
    """A22, A29, U17."""
    return r6(A.health(A.stats(cells(spark, d), "label")), "mean", "std", "rms", "l2", "near_zero")


@query(f"with c as (select cast(x as double) as x from ({CELLS})), e as (select min(x) as lo, max(x) as hi from c) select cast(least(47, floor((x - lo) / (hi - lo) * 48)) as int) as bin, count(*) as n from c, e group by 1")
def tensor_histogram(spark: SparkSession, d: str) -> DataFrame:
    return A.histogram(cells(spark, d).select(F.col("x").cast("double").alias("x")))


@query(f"select vec_id, row_number() over (partition by vec_id order by abs(x) desc, j) as rank, cast(j as int) as col, cast(x as double) as weight from ({CELLS}) qualify rank <= 5")
def neuron_partners(spark: SparkSession, d: str) -> DataFrame:
    return A.partners(table(spark, d, "embeddings"), 5)


@query("with l as (select vec_id as id, cast(embedding as double[]) as z, label % len(embedding) as t from embeddings), s as (select *, list_sum(list_transform(z, lambda x: exp(x))) as e, z[t + 1] as own from l) select id, cast(len(list_filter(z, lambda x: x > own)) + 1 as int) as rank, round(exp(own) / e, 9) as p, round(ln(e) - own, 9) as loss from s")
def token_ranks(spark: SparkSession, d: str) -> DataFrame:
    """L5, L6, A31."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("logits"), (F.col("label") % F.size("embedding")).cast("int").alias("target"))
    return A.token_ranks(e).select("id", "rank", F.round("p", 9).alias("p"), F.round("loss", 9).alias("loss"))


@query(f"with n as (select vec_id % 6 as layer, label as part, sqrt(sum(x * x)) as norm, count(*) as params from (select vec_id, label, cast(x as double) as x from ({CELLS})) group by 1, 2) select layer, part, round(norm, 6) as norm, params, round(max(norm) over (partition by part) / min(norm) over (partition by part), 6) as ratio, norm = 0 as dead from n")
def layer_norms(spark: SparkSession, d: str) -> DataFrame:
    """A23 to A25."""
    return r6(A.layer_norms(cells(spark, d).select((F.col("vec_id") % 6).alias("layer"), F.col("label").alias("part"), "x")), "norm", "ratio")


@query(f"select vec_id // 64 as bi, j // 8 as bj, round(avg(cast(x as double)), 6) as mean from ({CELLS}) group by 1, 2")
def block_heatmap(spark: SparkSession, d: str) -> DataFrame:
    return r6(A.heatmap(cells(spark, d).select(F.col("vec_id").alias("i"), "j", "x"), 64, 8), "mean")


_PARTS = ("qkv_proj", "mlp_expand", "attn_ln_gamma", "lm_head")
_TENSORS = f"select vec_id % 6 as layer, 'layer_' || vec_id % 6 || '.' || ['{_PARTS[0]}', '{_PARTS[1]}', '{_PARTS[2]}', '{_PARTS[3]}'][label % 4 + 1] as key, case label % 4 when 0 then 'attention' when 1 then 'mlp' when 2 then 'attention' else 'other' end as family, cast(x as double) as x from ({CELLS})"


def tensor_cells(spark: SparkSession, d: str) -> DataFrame:
    """Components of embeddings as cells of named tensors in six layers."""
    leaf = F.element_at(F.array(*map(F.lit, _PARTS)), (F.col("label") % 4 + 1).cast("int"))
    c = cells(spark, d).withColumn("key", F.concat(F.lit("layer_"), (F.col("vec_id") % 6).cast("string"), F.lit("."), leaf))
    return c.select("key", *[v.alias(k) for k, v in tensor_role(F.col("key")).items()], "j", "x")


@query(f"select layer, round(sqrt(sum(x * x) filter (where family = 'attention') / nullif(count(*) filter (where family = 'attention'), 0)), 6) as attention_rms, count(*) filter (where family = 'attention') as attention_params, round(sqrt(sum(x * x) filter (where family = 'mlp') / nullif(count(*) filter (where family = 'mlp'), 0)), 6) as mlp_rms, count(*) filter (where family = 'mlp') as mlp_params, null::double as norm_rms, 0::bigint as norm_params, round(sqrt(sum(x * x) filter (where family = 'other') / nullif(count(*) filter (where family = 'other'), 0)), 6) as other_rms, count(*) filter (where family = 'other') as other_params, round(sqrt(avg(x * x)), 6) as total_rms, count(*) as params from (select layer, case when key like '%lm_head' then 'other' else family end as family, x from ({_TENSORS})) group by 1")
def layer_summary(spark: SparkSession, d: str) -> DataFrame:
    """A23, U16."""
    s = A.layer_summary(tensor_cells(spark, d))
    return s.select(*[F.round(c, 6).alias(c) if c.endswith("_rms") else c for c in s.columns])


@query(f"with n as (select layer, sqrt(sum(case when layer = 4 then 0 else x * x end)) as norm from ({_TENSORS}) group by 1) select round(arg_min(norm, layer), 6) as early, round(arg_max(norm, layer), 6) as late, round(max(norm) filter (where norm > 1e-12) / min(norm) filter (where norm > 1e-12), 6) as ratio, string_agg(layer, ',' order by layer) filter (where norm <= 1e-10) as dead, max(norm) > 1e-12 and min(norm) > 1e-10 and max(norm) / nullif(min(norm), 0) <= 20 as healthy from n")
def gradient_health(spark: SparkSession, d: str) -> DataFrame:
    """Layer 4 is set to zero."""
    rows = tensor_cells(spark, d).withColumn("x", F.when(F.col("layer") == 4, 0.0).otherwise(F.col("x").cast("double")))
    return r6(A.gradient_health(rows), "early", "late", "ratio").withColumn("dead", F.array_join(F.col("dead").cast("array<string>"), ","))


@query(f"""with c as (select key, layer, case when layer = 2 or key = 'layer_3.mlp_expand' then 0 else x end as x from ({_TENSORS})),
f as (select key, layer, max(abs(x)) = 0 as dead, avg(cast(abs(x) < 0.01 as int)) > 0.1 as sparse, max(abs(x)) > 10 as exploding from c group by 1, 2), l as (select layer, bool_and(dead) as dead from f group by 1)
select concat_ws(',', case when bool_or(dead) then 'dead' end, case when bool_or(exploding) then 'exploding' end, case when bool_or(sparse) then 'sparse' end) as flags, (select string_agg(layer, ',' order by layer) from l where dead) as dead_layers, not bool_or(dead or exploding) as ok from f""")
def archive_health(spark: SparkSession, d: str) -> DataFrame:
    """Layer 2 is set to zero, and so is one tensor of layer 3."""
    zero = (F.col("layer") == 2) | (F.col("key") == "layer_3.mlp_expand")
    rows = tensor_cells(spark, d).withColumn("x", F.when(zero, 0.0).otherwise(F.col("x").cast("double")))
    flagged = A.health(A.stats(rows, "key", "layer")).select("key", "layer", F.filter(F.split("flags", ","), lambda f: (f != "") & (f != "constant")).alias("flags"))
    r = A.archive_health(flagged)
    return r.select(F.array_join("flags", ",").alias("flags"), F.array_join(F.col("dead_layers").cast("array<string>"), ",").alias("dead_layers"), "ok")


_LOGITS = "select label, vec_id as id, cast(embedding as double[]) as z, case when vec_id % 5 = 0 then -1 when vec_id % 3 = 0 then list_position(embedding, list_max(embedding)) - 1 else label % len(embedding) end as t from embeddings"


@query(f"""with s as (select *, list_sum(list_transform(z, lambda x: exp(x))) as e, z[t + 1] as own from ({_LOGITS}) where t >= 0), r as (select label, ln(e) - own as loss, len(list_filter(z, lambda x, i: x > own or (x = own and i < t + 1))) + 1 as rank from s), l as (select distinct label from embeddings)
select label, count(rank) as tokens, round(coalesce(avg(loss), 0), 6) as loss, coalesce(bool_and(rank = 1), false) as exact, round(avg(rank), 6) as mean_rank from l left join r using (label) group by 1""")
def token_scores(spark: SparkSession, d: str) -> DataFrame:
    """The rows of a label are the tokens of an answer; every fifth is masked, every third is asked for its best id."""
    z, v = F.col("embedding").cast("array<double>"), F.col("vec_id")
    best = F.array_position(z, F.array_max(z)) - 1
    target = F.when(v % 5 == 0, -1).when(v % 3 == 0, best).otherwise(F.col("label") % F.size("embedding")).cast("int")
    rows = table(spark, d, "embeddings").select("label", v.alias("id"), z.alias("logits"), target.alias("target"))
    return r6(A.token_scores(rows, "label"), "loss", "mean_rank")


@query("with c as (select vec_id as id, cast(embedding as double[]) as z from embeddings), s as (select *, list_sum(list_transform(z, lambda x: exp(x))) as e from c), u as (select id, e, unnest(z) as x, unnest(range(len(z))) as j from s) select id, cast(row_number() over (partition by id order by x desc, j) as int) as place, cast(j as int) as token, round(exp(x) / e, 9) as p from u qualify place <= 5")
def top_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The five best ids of each row."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("logits"), F.lit(0).alias("target"))
    t = A.token_ranks(rows, 5).select("id", F.posexplode("top").alias("i", "b"))
    return t.select("id", (F.col("i") + 1).alias("place"), F.col("b.id").alias("token"), F.round("b.p", 9).alias("p"))
