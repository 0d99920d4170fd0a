"""Running values of ordered rows by key, without a window over a whole key.

Rows are dealt into ranges of the order column at its approximate quantiles. What a range has to tell the ones after it (counts, a last value, a least one)
is a row of summary; summaries are combined by a window of at most a row for each range, and joined back. Frames of a few rows before and after
work on chunks of numbered rows with the neighbours' border rows copied in. So a key may hold any share of all rows.

Rows without a key or an order belong to no series and are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Most ranges, rows that are worth a range of their own, and rows of a chunk.
RANGES, LEAST, CHUNK = 4096, 2000, 4096


def in_ranges(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` with ``_range``, the number of the range of ``by`` (a number). One aggregate finds the bounds, which are compared in two steps."""
    shares = F.split(F.lit(",".join(str(i / RANGES) for i in range(1, max(2, RANGES)))), ",").cast("array<double>")
    r = rows.agg(F.percentile_approx(by, shares, 10 * RANGES).alias("m"), F.count(by).alias("n")).first()
    step = math.ceil(RANGES / max(1, min(RANGES, r["n"] // LEAST)))
    marks = sorted(set((r["m"] or [])[step - 1 :: step]))
    if not marks:
        return rows.withColumn("_range", F.lit(0))
    width, kind = math.ceil(math.sqrt(len(marks))), "long" if isinstance(marks[0], int) else "double"
    held = lambda a: F.split(F.lit(",".join(map(repr, a))), ",").cast(f"array<{kind}>")
    coarse = F.size(F.filter(held(marks[width - 1 :: width]), lambda m: m <= F.col(by)))
    fine = F.size(F.filter(F.slice(held(marks), coarse * width + 1, F.lit(width)), lambda m: m <= F.col(by)))
    return rows.withColumn("_range", (coarse * width + fine).cast("int"))


def ranged(rows: DataFrame, by: str = "ord") -> DataFrame:
    """``rows`` with ``_range``, found anew unless they have it already."""
    return rows if "_range" in rows.columns else in_ranges(rows, by)


def once(rows: DataFrame) -> DataFrame:
    """``rows`` whose columns are computed once: a filter on a generated column is not written out again, with all that it is made of, below it."""
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def local(keys: Sequence[str], by: str = "ord", part: str = "_range"):
    """The window of a key's rows within one range."""
    return W.partitionBy(*keys, part).orderBy(by)


def earlier(keys: Sequence[str], part: str = "_range"):
    """The window of a key's summaries before this one's; a row for each range."""
    return W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1)


def carried(rows: DataFrame, keys: Sequence[str], part: str, **of: tuple[Column, Callable[[Column], Column]]) -> DataFrame:
    """A row for each key and range: for every name the aggregates of the ranges before, combined. ``of`` gives aggregate and combination."""
    per = rows.groupBy(*keys, part).agg(*[a.alias(n) for n, (a, _) in of.items()])
    return per.select(*keys, part, *[f(F.col(n)).over(earlier(keys, part)).alias(n) for n, (_, f) in of.items()])


def last_known(c: Column) -> Column:
    return F.last(c, ignorenulls=True)


def numbered(rows: DataFrame, keys: Sequence[str], by: str = "ord") -> DataFrame:
    """``rows`` with ``nth`` (from 1) and ``_of``, the number of the key's rows."""
    r = ranged(rows, by)
    per = r.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("n"))
    per = per.select(*keys, "_range", F.coalesce(F.sum("n").over(earlier(keys)), F.lit(0)).alias("_before"), F.sum("n").over(W.partitionBy(*keys)).alias("_of"))
    return r.withColumn("_local", F.row_number().over(local(keys, by))).join(per, [*keys, "_range"]).withColumn("nth", F.col("_before") + F.col("_local")).drop("_before", "_local")


def running(rows: DataFrame, keys: Sequence[str], by: str = "ord", **of: tuple[Column, Callable[[Column], Column], Callable[[Column, Column], Column]]) -> DataFrame:
    """``rows`` with running values up to and with each row: for every name the column, the aggregate, and how the value before the range and the one within it combine."""
    r = ranged(rows, by)
    w = local(keys, by).rowsBetween(W.unboundedPreceding, 0)
    base = carried(r, keys, "_range", **{f"_{n}": (f(c), f) for n, (c, f, _) in of.items()})
    within = r.withColumns({n: f(c).over(w) for n, (c, f, _) in of.items()})
    return within.join(base, [*keys, "_range"]).withColumns({n: both(F.col(f"_{n}"), F.col(n)) for n, (_, _, both) in of.items()}).drop(*[f"_{n}" for n in of])


def carry_forward(rows: DataFrame, keys: Sequence[str], *names: str, by: str = "ord") -> DataFrame:
    """Every named column takes the last known value of its key up to its row."""
    r = ranged(rows, by)
    base = carried(r, keys, "_range", **{f"_{n}": (F.max_by(n, F.when(F.col(n).isNotNull(), F.col(by))), last_known) for n in names})
    within = r.withColumns({n: last_known(F.col(n)).over(local(keys, by).rowsBetween(W.unboundedPreceding, 0)) for n in names})
    return within.join(base, [*keys, "_range"]).withColumns({n: F.coalesce(n, f"_{n}") for n in names}).drop(*[f"_{n}" for n in names])


def chunked(rows: DataFrame, keys: Sequence[str], before: int, after: int = 0) -> DataFrame:
    """Numbered rows with ``_chunk``; the ``before`` and ``after`` rows next to a chunk are copied into it with ``_own`` false."""
    size = max(CHUNK, before, after)
    at, chunk = (F.col("nth") - 1) % size, F.floor((F.col("nth") - 1) / size)
    copies = F.array_compact(F.array(chunk, F.when(at >= size - before, chunk + 1) if before else F.lit(None).cast("long"), F.when((at < after) & (chunk > 0), chunk - 1)))
    spread = rows.withColumn("_home", chunk).withColumn("_chunk", F.explode(copies))
    return spread.withColumn("_own", F.col("_home") == F.col("_chunk")).drop("_home")


def order_statistics(rows: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """Exact interpolated percentiles of a key's known values: (keys, n, p), p as an array.

    Counts of value ranges tell in which range a rank lies; only rows of those ranges are ranked.
    """
    known = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    known = in_ranges(known, "_v")
    per = known.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("c"))
    per = per.select(*keys, "_range", "c", F.coalesce(F.sum("c").over(earlier(keys)), F.lit(0)).alias("_low"), F.sum("c").over(W.partitionBy(*keys)).alias("n"))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), (F.col("n") - 1).cast("double").alias("top"), F.lit(s).alias("s")) for i, s in enumerate(shares)])
    place = per.withColumn("_w", F.explode(wanted)).select(*keys, "_range", "_low", "c", "n", "_w.i", (F.col("_w.top") * F.col("_w.s")).alias("_at"))
    near = place.filter((F.floor("_at") < F.col("_low") + F.col("c")) & (F.ceil("_at") >= F.col("_low")))
    ranks = near.select(*keys, "_range").distinct()
    # Equal values are one row with their number, so a frequent value is no large range.
    values = known.join(ranks, [*keys, "_range"], "left_semi").groupBy(*keys, "_range", "_v").agg(F.count(F.lit(1)).alias("_c"))
    values = values.withColumn("_stop", F.sum("_c").over(W.partitionBy(*keys, "_range").orderBy("_v")))
    hit = values.join(near, [*keys, "_range"])
    has = lambda rank: (rank >= F.col("_low") + F.col("_stop") - F.col("_c")) & (rank < F.col("_low") + F.col("_stop"))
    low, high, part = F.floor("_at"), F.ceil("_at"), F.col("_at") - F.floor("_at")
    share = F.when(has(low), 1 - part).otherwise(0.0) + F.when(has(high), part).otherwise(0.0)
    hit = hit.filter(has(low) | has(high)).withColumn("_w", share)
    one = hit.groupBy(*keys, "n", "i").agg(F.sum(F.col("_v") * F.col("_w")).alias("p"))
    return one.groupBy(*keys, "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "p"))), lambda x: x["p"]).alias("p"))
