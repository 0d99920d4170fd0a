"""URL filter: host and path rules, then a ratio of character language models, with DataFrame functions only.

URLs that a rule decides train two variable-order Markov models of characters, accepted and rejected,
smoothed by Witten-Bell interpolation from order ``ORDER`` down to a uniform alphabet. A URL without a rule is judged by the difference of
both log-likelihoods per character, against the threshold of best balanced accuracy on URLs with a rule whose hosts the models
have not seen: a fifth of the hosts, by hash, is held out of the training.

Counts are taken once, as runs of ``ORDER + 1`` characters; lower orders are sums over them. Digits count as one
character. The table of ratios (one row for each distinct run) is broadcast up to ``broadcast_rows``, else joined by a shuffle, in which
runs that nearly every URL has (as ``://ww``) are broadcast, so that none is one task.

Edge cases: null URLs and URLs without ``://`` have an empty host and path, fit no rule and are blocked. Where training or held-out hosts
lack one of the verdicts, both use all hosts; where all lack one the threshold is 0. Repeated URLs count as often as they occur
and get the same verdict. URLs of any length are read whole. Empty tables give an empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, join_hot, materialize

ORDER, ALPHABET, HELD = 4, 128.0, 5
#: Fixed values: (verdict, host, path) of the rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.coalesce(ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def with_rule(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, url, host, path, and rule and by_rule of the longest rule that fits."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    by_length = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = lambda r: ((F.col("host") == r[1]) | F.endswith(F.col("host"), F.lit("." + r[1]))) & F.startswith(F.col("path"), F.lit(r[2]))
    first = lambda value: reduce(lambda w, r: w.when(fits(r), F.lit(value(r))), by_length[1:], F.when(fits(by_length[0]), F.lit(value(by_length[0]))))
    return rows.withColumn("rule", first(lambda r: r[1] + r[2])).withColumn("by_rule", first(lambda r: r[0]))


def _with_runs(urls: DataFrame, keep: list) -> DataFrame:
    """``keep`` and a row ``run`` for each character of ``url``: it and the ORDER characters before it."""
    padded = F.concat(F.lit("\x02" * ORDER), F.regexp_replace(F.lower("url"), "[0-9]", "0"), F.lit("\x03"))
    at = F.explode_outer(F.sequence(F.lit(1), F.length("padded") - ORDER))
    return urls.withColumn("padded", padded).select(*keep, "padded", at.alias("i")).select(*keep, F.substr(F.col("padded"), F.col("i"), F.lit(ORDER + 1)).alias("run"))


def ratios(urls: DataFrame) -> DataFrame:
    """(run, ratio, n): log P(last | rest) accepted minus rejected for each distinct run of ``urls`` (url, teaches, n), and how many rows have it.

    ``teaches`` is allow, block or null.
    """
    marked = urls.select("url", *[F.when(F.col("teaches") == v, F.col("n")).otherwise(0).alias(c) for c, v in (("a", "allow"), ("r", "block"))])
    runs = _with_runs(marked, ["a", "r"])
    runs = materialize(runs.groupBy("run").agg(F.sum("a").alias("a"), F.sum("r").alias("r"), F.count(F.lit(1)).alias("n")))
    model = None
    for n in range(ORDER + 1):
        key = F.substring("run", ORDER + 1 - n, n + 1)
        counts = runs.groupBy(key.alias("key")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"), F.sum("n").alias("n"))
        counts = counts.withColumn("context", F.substring("key", 1, n)).withColumn("lower", F.substring("key", 2, n))
        contexts = counts.groupBy("context").agg(*[f for c in "ar" for f in (F.sum(c).alias(f"n_{c}"), F.count_if(F.col(c) > 0).alias(f"t_{c}"))])
        if n:
            both = counts.join(contexts, "context").join(model, "lower")
        else:
            total = contexts.first()  # one row: all characters
            total = total.asDict() if total else dict.fromkeys(("n_a", "t_a", "n_r", "t_r"), 0)
            both = counts.select("*", *[F.lit(total[c] or 0).alias(c) for c in ("n_a", "t_a", "n_r", "t_r")], *[F.lit(1 / ALPHABET).alias(f"p_{c}") for c in "ar"])
        p = {c: F.when(F.col(f"n_{c}") > 0, (F.col(c) + F.col(f"t_{c}") * F.col(f"p_{c}")) / (F.col(f"n_{c}") + F.col(f"t_{c}"))).otherwise(F.col(f"p_{c}")) for c in "ar"}
        model = both.select(F.col("key").alias("lower"), p["a"].alias("p_a"), p["r"].alias("p_r"), *([F.col("n")] if n == ORDER else []))
    return model.select(F.col("lower").alias("run"), (F.log("p_a") - F.log("p_r")).alias("ratio"), "n")


def threshold(scored: DataFrame) -> tuple[float, float]:
    """The score of best balanced accuracy on (score, by_rule, n), in steps of 0.01 within [-10, 10], and that accuracy; 0 unless both verdicts occur."""
    step = F.round(F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.col("score"))) * 100).cast("int")
    bins = scored.filter("by_rule is not null").groupBy(step.alias("bin")).agg(*[F.sum(F.when(F.col("by_rule") == v, F.col("n")).otherwise(0)).alias(v) for v in ("allow", "block")]).collect()  # 2001 at most
    allow, block = sum(b["allow"] for b in bins), sum(b["block"] for b in bins)
    if not allow or not block:
        return 0.0, 0.0
    best, at, below_a, below_b = -1.0, 0.0, 0, 0
    for b in sorted(bins, key=lambda b: b["bin"]):
        good = (1 - below_a / allow + below_b / block) / 2  # scores from this bin on are accepted
        if good > best + 1e-12:
            best, at = good, b["bin"] / 100 - 0.005
        below_a, below_b = below_a + b["allow"], below_b + b["block"]
    return at, best


def scores(rows: DataFrame, broadcast_rows: int = 300_000) -> tuple[DataFrame, float, float]:
    """(url, by_rule, n, held, score) of the distinct URLs of ``rows`` (``with_rule``), the threshold and its balanced accuracy on held-out hosts."""
    held = F.pmod(F.xxhash64(F.lit("held out"), "host"), F.lit(HELD)) == 0
    urls = rows.filter("host <> '' or path <> ''").groupBy("url", "by_rule", "host").agg(F.count(F.lit(1)).alias("n"))
    urls = materialize(urls.select("url", "by_rule", "n", held.alias("held")))
    parts = urls.filter("by_rule is not null").groupBy("held", "by_rule").agg(F.count(F.lit(1)).alias("n")).collect()  # four rows
    apart = len(parts) == 4
    urls = urls.withColumn("teaches", F.when(~F.col("held"), F.col("by_rule")) if apart else F.col("by_rule"))
    model = materialize(ratios(urls))
    size = model.agg(F.count(F.lit(1)).alias("runs"), F.sum("n").alias("n")).first()
    each = _with_runs(urls, ["url", "by_rule", "n", "held"])
    met = each.join(F.broadcast(model.drop("n")), "run") if size["runs"] <= broadcast_rows else join_hot(each, model.withColumnRenamed("n", "times"), "run", "times", size["n"])
    scored = materialize(met.groupBy("url", "by_rule", "n", "held").agg(F.round(F.avg("ratio"), 9).alias("score")))
    return scored, *threshold(scored.filter("held") if apart else scored)


def judge(pages: DataFrame, rules: tuple = RULES, broadcast_rows: int = 300_000) -> DataFrame:
    """page_id, host, path, rule, verdict and score (null where a rule decides or there is no host)."""
    rows = with_rule(pages, rules)
    scored, at, _ = scores(rows, broadcast_rows)
    free = scored.filter("by_rule is null").select(F.col("url").alias("free_url"), "score")
    judged = rows.join(free, rows["url"] == free["free_url"], "left")
    verdict = F.coalesce("by_rule", F.when(F.col("score") >= at, "allow").otherwise("block"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
