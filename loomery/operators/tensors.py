"""Profiles of arrays: statistics, histograms, partners, logits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def stats(cells: DataFrame, *by: str, near_zero: float = 1e-2) -> DataFrame:
    """Of (.., x): count, finite min, max, mean, population deviation, rms, l2, abs max, nan and inf counts, near-zero share."""
    x = F.col("x").cast("double")
    nan, inf = F.isnan(x), F.abs(x) == float("inf")
    v = F.when(~nan & ~inf, x)
    return cells.groupBy(*by).agg(
        F.count("x").alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.sqrt(F.avg(v * v)).alias("rms"), F.sqrt(F.sum(v * v)).alias("l2"), F.max(F.abs(v)).alias("abs_max"),
        F.count_if(nan).alias("nans"), F.count_if(inf).alias("infs"), (F.count_if(F.abs(v) < near_zero) / F.count(v)).alias("near_zero"),
    )


def health(stat: DataFrame) -> DataFrame:
    """Flags of each tensor's statistics."""
    flag = lambda c, n: F.when(c, F.lit(n))
    flags = F.array_compact(F.array(flag(F.col("nans") > 0, "nan"), flag(F.col("infs") > 0, "inf"), flag(F.col("abs_max") == 0, "dead"), flag(F.col("near_zero") > 0.1, "sparse"), flag(F.col("std") == 0, "constant"), flag(F.col("abs_max") > 10, "exploding")))
    return stat.withColumn("flags", F.array_join(flags, ","))


def histogram(cells: DataFrame, bins: int = 48) -> DataFrame:
    """Equal bins between the extremes of the finite values, the last one closed. One pass for the extremes, one to count."""
    cells = cells.select(_finite("x").alias("x")).filter("x is not null")
    lo, hi = cells.agg(F.min("x"), F.max("x")).first()
    if lo is None:
        return cells.select(F.lit(0).alias("bin"), F.lit(0).cast("long").alias("n")).limit(0)
    b = F.least(F.lit(bins - 1), F.floor((F.col("x") - lo) / ((hi - lo) or 1.0) * bins)).cast("int")
    return cells.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def partners(rows: DataFrame, k: int) -> DataFrame:
    """L4: for each row (vec_id, embedding) the k columns of largest absolute weight. Sorted within the row, no shuffle."""
    cells = F.transform("embedding", lambda x, i: F.struct((-F.abs(x)).alias("a"), i.alias("col"), x.alias("x")))
    top = F.slice(F.array_sort(F.filter(cells, lambda c: ~F.isnan(c["x"]))), 1, k)
    return rows.select("vec_id", F.posexplode(top).alias("r", "c")).select("vec_id", (F.col("r") + 1).alias("rank"), "c.col", F.col("c.x").cast("double").alias("weight"))


def token_ranks(rows: DataFrame, k: int = 0) -> DataFrame:
    """(id, logits, target): rank of the target (of equals the lower id first), its probability and cross-entropy; targets below 0 are masked.

    With ``k`` also ``top``, the k best ids with their probabilities, in the same order. All within the row.
    """
    top = F.array_max("logits")
    total = F.aggregate("logits", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    own = F.get("logits", F.col("target"))
    lse = F.log(total) + top
    ahead = F.filter("logits", lambda x, i: (x > own) | ((x == own) & (i < F.col("target"))))
    best = F.slice(F.array_sort(F.transform("logits", lambda x, i: F.struct((-x).alias("minus"), i.alias("id")))), 1, max(1, k))
    more = [F.transform(best, lambda b: F.struct(b["id"].alias("id"), F.exp(-b["minus"] - lse).alias("p"))).alias("top")] if k else []
    return rows.filter(F.col("target") >= 0).select("id", (F.size(ahead) + 1).alias("rank"), F.exp(own - lse).alias("p"), (lse - own).alias("loss"), *more)


def token_scores(rows: DataFrame, by: str) -> DataFrame:
    """For each ``by`` of rows (by, id, logits, target) the tokens, the mean cross-entropy of unmasked ones (0 without any), whether all have rank 1, and their mean rank."""
    marked = rows.select(by, "id", "logits", "target")
    ranked = token_ranks(marked.withColumn("id", F.struct(by, "id"))).select(F.col("id")[by].alias(by), "rank", "loss")
    per = ranked.groupBy(by).agg(F.count(F.lit(1)).alias("tokens"), F.avg("loss").alias("loss"), F.bool_and(F.col("rank") == 1).alias("exact"), F.avg("rank").alias("mean_rank"))
    return rows.select(by).distinct().join(per, by, "left").select(by, F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("loss", F.lit(0.0)).alias("loss"), F.coalesce("exact", F.lit(False)).alias("exact"), "mean_rank")


def _finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def layer_norms(cells: DataFrame) -> DataFrame:
    """The l2 norm of each (layer, part), the ratio of largest to smallest positive norm of the part, and dead layers."""
    n = cells.groupBy("layer", "part").agg(F.sqrt(F.sum(F.col("x").cast("double") ** 2)).alias("norm"), F.count(F.lit(1)).alias("params"))
    w = W.partitionBy("part")
    return n.select("layer", "part", "norm", "params", (F.max("norm").over(w) / F.min(F.when(F.col("norm") > 0, F.col("norm"))).over(w)).alias("ratio"), (F.col("norm") == 0).alias("dead"))


def layer_summary(cells: DataFrame, families: tuple[str, ...] = ("attention", "mlp", "norm")) -> DataFrame:
    """Of cells (layer, family, x) per layer the rms of finite values and the number of parameters of each family (others are ``other``), and of all together."""
    name = F.when(F.col("family").isin(*families), F.col("family")).otherwise("other")
    v = _finite("x")
    per = cells.filter("layer is not null").groupBy("layer", name.alias("family")).agg(F.sum(v * v).alias("squares"), F.count(v).alias("finite"), F.count(F.lit(1)).alias("params"))
    rms = lambda s, n: F.when(n > 0, F.sqrt(s / n))
    of = lambda f: F.col("family") == f
    only = lambda c, f: F.sum(F.when(of(f), F.col(c)))
    columns = [x for f in (*families, "other") for x in (rms(only("squares", f), only("finite", f)).alias(f"{f}_rms"), F.coalesce(only("params", f), F.lit(0)).alias(f"{f}_params"))]
    return per.groupBy("layer").agg(*columns, rms(F.sum("squares"), F.sum("finite")).alias("total_rms"), F.sum("params").alias("params"))


def gradient_health(cells: DataFrame, most: float = 20.0) -> DataFrame:
    """One row from cells (layer, x): norms of first and last layer, the ratio of the largest to the smallest positive one (1 below two of them), dead layers, and whether all is well."""
    per = cells.filter("layer is not null").groupBy("layer").agg(F.sqrt(F.sum(F.col("x").cast("double") ** 2)).alias("norm"))  # a row for each layer
    positive = F.when(F.col("norm") > 1e-12, F.col("norm"))
    r = per.agg(F.coalesce(F.min_by("norm", "layer"), F.lit(0.0)).alias("early"), F.coalesce(F.max_by("norm", "layer"), F.lit(0.0)).alias("late"), F.count(positive).alias("n"), (F.max(positive) / F.min(positive)).alias("ratio"), F.sort_array(F.collect_list(F.when(F.col("norm") <= 1e-10, F.col("layer")))).alias("dead"))
    ratio = F.when(F.col("n") >= 2, F.col("ratio")).otherwise(1.0)
    return r.select("early", "late", ratio.alias("ratio"), "dead", ((F.col("n") > 0) & (ratio <= most) & (F.size("dead") == 0)).alias("healthy"))


def archive_health(tensors: DataFrame) -> DataFrame:
    """One row from tensors (key, layer, flags as an array): all flags that occur, the layers whose tensors are all dead, and whether nothing bad occurs."""
    dead = F.array_contains("flags", "dead")
    layers = tensors.filter("layer is not null").groupBy("layer").agg(F.bool_and(dead).alias("dead")).agg(F.sort_array(F.collect_list(F.when(F.col("dead"), F.col("layer")))).alias("dead_layers"))
    flags = tensors.select(F.explode("flags").alias("flag")).distinct().agg(F.sort_array(F.collect_list("flag")).alias("flags"))  # a handful of flags
    bad = F.array(*map(F.lit, ("nan", "inf", "dead", "exploding")))
    return flags.crossJoin(F.broadcast(layers)).select("flags", "dead_layers", (~F.arrays_overlap("flags", bad)).alias("ok"))  # one row each


def plane_axes(leaf: Column) -> tuple[Column, Column]:
    """What the rows and columns of a tensor's plane stand for."""
    pairs = {"token_embedding": ("token", "residual"), "position_embedding": ("position", "residual"), "mlp_expand": ("residual", "mlp hidden"), "mlp_contract": ("mlp hidden", "residual"), "qkv_proj": ("residual", "qkv"), "attn_out_proj": ("residual", "residual"), "attn_out_bias": ("residual", "residual"), "lm_head": ("residual", "token")}
    ending = F.rlike(leaf, F.lit("_(?:gamma|beta)$"))
    rows, columns = F.when(ending, F.regexp_extract(leaf, "_(gamma|beta)$", 1)), F.when(ending, F.lit("scale"))
    for name, (row, column) in pairs.items():
        rows, columns = rows.when(leaf == name, row), columns.when(leaf == name, column)
    return rows.otherwise("row"), columns.otherwise("col")


def unit_label(kind: Column, index: Column, width: Column) -> Column:
    """A unit's name; of a joined projection Q, K or V and the place in it."""
    third = F.floor(width / 3)
    part = F.when(index < third, "Q").when(index < 2 * third, "K").otherwise("V")
    joined = (kind == "qkv") & (width >= 3) & (index >= 0) & (index < 3 * third)
    return F.when(joined, F.concat(part, F.lit("["), (index % third).cast("string"), F.lit("]"))).otherwise(F.concat(kind, F.lit(" "), index.cast("string")))


def heatmap(cells: DataFrame, step_i: int, step_j: int) -> DataFrame:
    """Means of the finite values of blocks of (i, j, x)."""
    return cells.groupBy(F.floor(F.col("i") / step_i).alias("bi"), F.floor(F.col("j") / step_j).alias("bj")).agg(F.avg(_finite("x")).alias("mean"))


def heatmap_steps(height: int, width: int, most: int = 72) -> tuple[int, int]:
    """The block sizes that give at most ``most`` blocks a side."""
    return max(1, -(-height // most)), max(1, -(-width // most))
