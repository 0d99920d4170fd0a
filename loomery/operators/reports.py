"""Run listings, clocks, milestones, pool residency, next steps, and checks of packs and arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Fractions of a run at which it is probed, and their names.
MILESTONES = ((0.25, "quarter_1"), (0.5, "quarter_2"), (0.75, "quarter_3"), (1.0, "final"))


def is_run_log(name: Column) -> Column:
    """A session's log, not the aggregate one."""
    return (name != "training.log") & (F.startswith(name, F.lit("training_")) | F.startswith(name, F.lit("unguided_")))


def run_kind(name: Column) -> Column:
    """Unguided, training or other."""
    return F.when(F.startswith(name, F.lit("unguided_")), "unguided").when(F.startswith(name, F.lit("training")), "training").otherwise("other")


def run_label(name: Column) -> Column:
    """The name without its folder, kind and suffix."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"\.[^.]*$", ""), r"^(?:unguided|training)_", "")


def latest_runs(logs: DataFrame, now: Column, most: int = 5, age: float = 60.0) -> DataFrame:
    """Of logs (file, ts) the live ones (younger than ``age`` seconds at ``now``) first, then the newest."""
    last = logs.groupBy("file").agg(F.max("ts").alias("last"), F.count(F.lit(1)).alias("lines"))
    seconds = now.cast("timestamp").cast("double") - F.col("last").cast("timestamp").cast("double")
    return last.withColumn("live", seconds < age).orderBy(F.desc("live"), F.desc("last"), "file").limit(most)


def default_log(logs: DataFrame, preferred: str = "training.log") -> DataFrame:
    """L3: the preferred log if it is there, else the one of most lines, then the newest."""
    per = logs.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.max("ts").alias("last"))
    return per.orderBy(F.desc(F.col("file") == preferred), F.desc("lines"), F.desc("last"), "file").limit(1)


def line_time(line: Column) -> Column:
    """The time at a line's start."""
    return F.try_to_timestamp(F.substring(line, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))


def event_id(ts: Column) -> Column:
    """An event's id from its time, to the microsecond."""
    return F.date_format(ts, "yyyyMMdd'T'HHmmssSSSSSS")


def milestones(runs: DataFrame) -> DataFrame:
    """(run, step, fraction, name) for runs (run, total); of fractions that fall on one step the larger counts."""
    step = lambda f: F.col("total") if f == 1.0 else F.greatest(F.lit(1).cast("long"), F.floor(F.col("total") * f))
    rows = runs.filter("total >= 1").select("run", F.explode(F.array(*[F.struct(step(f).cast("long").alias("step"), F.lit(f).alias("fraction"), F.lit(n).alias("name")) for f, n in MILESTONES])).alias("m"))
    return rows.groupBy("run", "m.step").agg(F.max(F.struct("m.fraction", "m.name")).alias("m")).select("run", "step", "m.fraction", "m.name")


def clocks(rows: DataFrame) -> DataFrame:
    """For each run (run, step, total, ts) elapsed seconds, seconds a step and seconds left."""
    seconds = F.col("ts").cast("timestamp").cast("double")
    per = rows.groupBy("run").agg(F.min(seconds).alias("t0"), F.max(seconds).alias("t1"), F.min("step").alias("s0"), F.max("step").alias("s1"), F.max("total").alias("total"))
    pace = F.when(F.col("s1") > F.col("s0"), (F.col("t1") - F.col("t0")) / (F.col("s1") - F.col("s0")))
    return per.select("run", (F.col("t1") - F.col("t0")).alias("elapsed"), pace.alias("step_seconds"), (pace * F.greatest(F.lit(0), F.col("total") - F.col("s1"))).alias("eta"))


def residency(events: DataFrame) -> DataFrame:
    """Bytes resident after each event (pool, ord, event, key, nbytes) and their peak so far in the pool.

    An allocation sets its key's size, ``clear`` empties the pool and starts a new epoch; the peak lives on.
    """
    w = W.partitionBy("pool").orderBy("ord")
    rows = events.withColumn("epoch", F.sum((F.col("event") == "clear").cast("int")).over(w))
    before = F.lag("nbytes").over(W.partitionBy("pool", "epoch", "key").orderBy("ord"))
    rows = rows.withColumn("change", F.when(F.col("event") == "alloc", F.col("nbytes") - F.coalesce(before, F.lit(0))).otherwise(0))
    rows = rows.withColumn("resident", F.sum("change").over(W.partitionBy("pool", "epoch").orderBy("ord")))
    return rows.withColumn("peak", F.max("resident").over(w)).select("pool", "ord", "event", "key", "nbytes", "resident", "peak")


def next_step(runs: DataFrame) -> DataFrame:
    """Mode, primary action and flags for each run.

    Columns of ``runs``: run, exact, swap, teacher, collapsing (a count), dirty, shared, ood_n, ood_copies, step, max_steps, long_fail, short_exact.
    """
    exact, swap, n = F.col("exact"), F.coalesce("swap", F.lit(0.0)), lambda c: F.coalesce(c, F.lit(0))
    understands = F.coalesce((exact >= 0.85) & (swap <= 0.05) & (n("ood_n") >= 2) & (n("ood_copies") == 0), F.lit(False))
    data, mix = (n("dirty") > 0) | (n("shared") > 0), (swap >= 0.15) | (n("collapsing") > 0)
    config = F.coalesce((exact < 0.15) & (F.col("step") >= F.greatest(n("max_steps"), F.lit(1500))), F.lit(False)) | ((n("long_fail") >= 2) & (F.coalesce("short_exact", F.lit(0.0)) >= 0.6) & (F.col("step") >= 1200))
    policy = F.coalesce((F.col("teacher") < 0.15) & (exact >= 0.35), F.lit(False))
    mode = F.when(understands, "generalizing").when(exact.isNull(), "unknown").when(exact < 0.25, "not_reciting").when((n("collapsing") > 0) & (exact >= 0.4), "mixed_recitation").otherwise("memorizing")
    swamped = (mode == "not_reciting") & mix & (swap > F.coalesce(exact, F.lit(0.0)))
    steps = (exact.isNull() | (exact < 0.80)) & ~understands & ~swamped
    primary = F.when(understands, "hold").when(mix, "change_mix").when(data, "change_data").when(config, "new_config").when(steps, "more_steps").when(policy, "new_policy").otherwise("hold")
    return runs.select("run", mode.alias("mode"), primary.alias("primary"), understands.alias("understands"), data.alias("change_data"), mix.alias("change_mix"), steps.alias("more_steps"), config.alias("new_config"), policy.alias("new_policy"))


def dense_windows(n_tokens: int | Column, max_len: int, stride: int) -> Column:
    """The starts of dense windows over a stream; null where it is too short for one."""
    n = F.lit(n_tokens) if isinstance(n_tokens, int) else n_tokens
    return F.when(n > max_len, F.sequence(F.lit(0).cast("long"), (n - max_len - 1).cast("long"), F.lit(stride).cast("long")))


def expectation_mismatches(found: DataFrame, expected: dict[str, object]) -> DataFrame:
    """(field, expected, got) of a one-row manifest's fields that differ."""
    rows = found.select(F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.lit(str(v)).alias("expected"), F.col(k).cast("string").alias("got")) for k, v in expected.items()])).alias("x")).select("x.*")
    return rows.filter(~F.col("expected").eqNullSafe(F.col("got")))


def tensor_role(key: Column) -> dict[str, Column]:
    """U16: layer number, leaf and family of a tensor by its name."""
    layer = F.regexp_extract(key, r"(?:layers?|blocks?|h)[._]([0-9]+)[._]", 1).try_cast("int")
    leaf = F.regexp_extract(key, r"([^./]+)$", 1)
    families = (("attention", "attn|attention|q_proj|k_proj|v_proj|qkv"), ("mlp", "mlp|ffn|fc[0-9]|w[123]$"), ("norm", "norm|ln_|gamma|beta"), ("embedding", "emb|wte|wpe"), ("head", "head|logits"))
    family = reduce(lambda w, f: w.when(F.rlike(key, F.lit(f"(?i){f[1]}")), f[0]), families[1:], F.when(F.rlike(key, F.lit(f"(?i){families[0][1]}")), families[0][0])).otherwise("other")
    return {"layer": layer, "leaf": leaf, "family": family}


def architecture(shapes: DataFrame) -> DataFrame:
    """One row from tensor names and shapes (key, shape): layers, vocabulary, width, inner width and tensors."""
    role = tensor_role(F.col("key"))
    rows = shapes.select(role["layer"].alias("layer"), role["family"].alias("family"), "shape")
    two = F.size("shape") == 2
    return rows.agg((F.max("layer") + 1).alias("layers"), F.max(F.when((F.col("family") == "embedding") & two, F.get("shape", F.lit(0)))).alias("vocabulary"), F.max(F.when((F.col("family") == "embedding") & two, F.get("shape", F.lit(1)))).alias("width"), F.max(F.when((F.col("family") == "mlp") & two, F.array_max("shape"))).alias("inner"), F.count(F.lit(1)).alias("tensors"))


def sidecar_mismatches(inferred: DataFrame, configured: DataFrame) -> DataFrame:
    """(name, inferred, configured) of attributes (name, value) that both sides have and that differ."""
    a, b = inferred.select("name", F.col("value").alias("inferred")), configured.select("name", F.col("value").alias("configured"))
    return a.join(b, "name").filter("inferred <> configured")


def weight_scale(values: DataFrame, expected: Column, tolerance: float = 0.2) -> DataFrame:
    """(key, std, ratio, good) of values (key, value) against the standard deviation that is expected."""
    per = values.groupBy("key").agg(F.stddev_pop("value").alias("std"))
    ratio = F.col("std") / expected
    return per.select("key", "std", ratio.alias("ratio"), (F.abs(ratio - 1) <= tolerance).alias("good"))
