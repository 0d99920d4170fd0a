"""Soft-membership mixing of documents to target token weights, with DataFrame functions only.

Domains come from a labelled table: ``toxic``, ``low`` (quality 0) and ``clean``. A naive Bayes classifier over binned text
features (length, symbols, capitals, distinct words, and hits of a learned word list for each domain) gives
every document posteriors. Nonnegative rates of documents are then fitted by projected gradient to the squared gaps between the expected tokens of each
domain, sum of rate * tokens * posterior, and its target, which keeps the clean tokens whole. The projection is lazy: steps are added up before it, and a rate is max(0, 1 + the steps so far). (Projected
after each step, the fit stalls far from the targets where many rates fall to 0.) So of all rates that reach the targets these are the nearest to 1. A step adds to every document its posteriors' share of the gaps, scaled
by the inverse curvature of the rates that are positive; several lengths are tried together, and the one of least objective is taken, which falls with each step.
Documents of equal bins have equal rates throughout, so a step is one distributed aggregate (the tokens reached and their curvature) over cells of such documents, at most ``CELLS`` however many documents.
A document's copies are its rate, rounded up or down by a seeded uniform of its id and text.

Word lists are fitted on at most about ``sample`` labelled documents; the counts of the classifier, the cells and totals cover all.

Edge cases: null and empty texts have no tokens and the first bins. Null and repeated ids are rounded by their own texts; an empty table gives an empty result. Labels that are null, or of
unknown documents, are ignored; a document labelled twice is toxic, else low, if one label says so. Without labelled documents the
posteriors are the uniform prior and all rates 1. Targets that no rates reach are approached to the least squares, and ``Fit.met`` says so. Repeated rows are decided alike. Extra
columns are passed through by ``mix``, but for those named like its own, which replace them; ``chosen`` keeps every column as it is.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import add, mul

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, words_of

DOMAINS = ("clean", "low", "toxic")
#: Bins of each feature; their product bounds the cells.
BINS = {"b_size": 6, "b_symbol": 4, "b_capital": 4, "b_distinct": 4, "b_low": 4, "b_toxic": 4}
CELLS = math.prod(BINS.values())


#: Letters of a word's stem. Stems, not words, are counted by the word lists and the share of distinct ones: on few labels they part the domains better.
STEM = 5


def _terms(words: Column) -> Column:
    """The distinct stems of the words."""
    return F.array_distinct(F.transform(words, lambda w: F.left(w, F.lit(STEM))))


def _step(x: Column, *cuts: float) -> Column:
    return reduce(add, [(x >= c).cast("int") for c in cuts])


def _labelled(labels: DataFrame) -> DataFrame:
    toxic, quality = F.max(F.col("toxic").cast("int")), F.min(F.col("quality").cast("int"))
    known = labels.filter("doc_id is not null and toxic is not null and quality is not null").groupBy("doc_id").agg(toxic.alias("t"), quality.alias("q"))
    return known.select("doc_id", F.when(F.col("t") > 0, "toxic").when(F.col("q") < 1, "low").otherwise("clean").alias("domain"))


def word_lists(documents: DataFrame, labelled: DataFrame, sample: int = 6000, keep: int = 40) -> dict[str, list[str]]:
    """For ``low`` and ``toxic`` the stems that are most more frequent there, by documents that hold them."""
    n = labelled.count()
    uniform = F.pmod(F.xxhash64(F.lit("word lists"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    picked = materialize(labelled.filter(uniform < min(1.0, sample / max(1, n))))
    size = {r["domain"]: r["n"] for r in picked.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    text = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # about ``sample`` ids
    counts = text.select("domain", F.explode(_terms(words_of(F.col("text")))).alias("term")).groupBy("term").agg(*[F.count_if(F.col("domain") == d).alias(d) for d in DOMAINS])
    counts, lists = materialize(counts.filter(reduce(add, map(F.col, DOMAINS)) >= 5)), {}
    for d in DOMAINS[1:]:
        own, rest = size.get(d, 0), sum(size.values()) - size.get(d, 0)
        others = reduce(add, [F.col(x) for x in DOMAINS if x != d])
        share, other = F.col(d) / max(1, own), others / max(1, rest)
        strong = counts.filter((share > 0.02) & (share > 4 * other)).orderBy(F.desc(share - other), "term").limit(keep)
        lists[d] = [r["term"] for r in strong.select("term").collect()]
    return lists


def featured(documents: DataFrame, lists: dict[str, list[str]], keep: list[str]) -> DataFrame:
    """``_keep`` (a struct of the columns ``keep``, so that no name clashes), th (the text's hash), tokens and the binned features of every row, from one pass over the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(F.struct(*keep).alias("_keep"), F.xxhash64("text").alias("th"), F.length(text).alias("n"), F.regexp_count(text, F.lit(r"[#$%&|!*@^~<>{}]")).alias("symbols"), F.regexp_count(text, F.lit("[A-Z]")).alias("capitals"), words_of(F.col("text")).alias("words"))
    rows = rows.withColumn("tokens", F.size("words").cast("long")).withColumn("terms", _terms(F.col("words")))
    of = lambda c: F.col(c) / F.greatest(F.col("n"), F.lit(1))
    hits = lambda d: F.size(F.array_intersect("terms", F.lit(lists[d]).cast("array<string>"))) if lists.get(d) else F.lit(0)
    bins = {
        "b_size": _step(F.col("tokens"), 16, 64, 256, 1024, 4096),
        "b_symbol": _step(of("symbols"), 0.002, 0.01, 0.04),
        "b_capital": _step(of("capitals"), 0.01, 0.05, 0.2),
        "b_distinct": _step(F.size("terms") / F.greatest(F.col("tokens"), F.lit(1)), 0.15, 0.4, 0.7),
        "b_low": _step(hits("low"), 1, 2, 4),
        "b_toxic": _step(hits("toxic"), 1, 2, 4),
    }
    return rows.select("_keep", "th", "tokens", *[b.cast("int").alias(c) for c, b in bins.items()])


def classifier(features: DataFrame, labelled: DataFrame) -> tuple[dict[str, Column], int]:
    """Posterior of each domain as an expression over the bins, from counts over all labelled rows; and their number."""
    joined = features.join(labelled, "doc_id")
    counts = joined.select("domain", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("bin")) for c in BINS])).alias("x")).groupBy("domain", "x.feature", "x.bin").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 78 rows
    n = {(r["domain"], r["feature"], r["bin"]): r["n"] for r in counts}
    size = {d: sum(n.get((d, "b_size", b), 0) for b in range(BINS["b_size"])) for d in DOMAINS}
    log_p = {}
    for d in DOMAINS:
        log_p[d] = F.lit(math.log((size[d] + 1) / (sum(size.values()) + len(DOMAINS))))
        for c, bins in BINS.items():
            log_p[d] = log_p[d] + F.element_at(F.lit([math.log((n.get((d, c, b), 0) + 0.5) / (size[d] + 0.5 * bins)) for b in range(bins)]), F.col(c) + 1)
    top = F.greatest(*log_p.values())
    parts = {d: F.exp(x - top) for d, x in log_p.items()}
    return {d: p / reduce(add, parts.values()) for d, p in parts.items()}, sum(size.values())


@dataclass(frozen=True)
class Fit:
    """The steps' sum for each domain, the targets, the expected tokens that the rates reach, whether these are within the tolerance of every target, and the objective before each step."""

    pull: dict[str, float]
    target: dict[str, float]
    reached: dict[str, float]
    met: bool
    objective: list[float]

    def rate(self, posterior: dict[str, Column]) -> Column:
        return F.greatest(F.lit(0.0), reduce(add, [posterior[d] * x for d, x in self.pull.items()], F.lit(1.0)))


def targets(there: dict[str, float], weights: dict[str, float]) -> dict[str, float]:
    """Tokens wanted of each domain: so many that the clean target is all expected clean tokens.

    A scarce domain takes rates above 1 and does not shrink the others. Without clean tokens it is the largest budget of which no target exceeds what is there.
    """
    share, clean = {d: weights.get(d, 0.0) / sum(weights.values()) for d in DOMAINS}, DOMAINS[0]
    if share[clean] > 0 and there[clean] > 0:
        budget = there[clean] / share[clean]
    else:
        budget = min([there[d] / share[d] for d in DOMAINS if share[d] > 0 and there[d] > 0], default=0.0)
    return {d: share[d] * budget for d in DOMAINS}


#: The lengths of a step that are tried together.
LENGTHS = (1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 0.001)


def fit_rates(cells: DataFrame, weights: dict[str, float], tolerance: float = 1e-4, steps: int = 60, ridge: float = 1e-9) -> Fit:
    """Rates for ``cells`` (tokens, p_<domain>), at most ``CELLS`` rows, whose expected tokens come within ``tolerance`` of each target.

    ``ridge`` weighs the distance of the rates from 1 against the squared gaps, so that targets out of reach still have one nearest solution.
    """
    names, k = [f"p_{d}" for d in DOMAINS], len(DOMAINS)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    mass = lambda *cs: F.sum(reduce(mul, cs, F.col("tokens").cast("double")))

    def at(pulls: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """For each sum of steps the tokens * rate^2, the tokens reached, and their curvature where rates are positive. The sums are data, so all steps share their generated code."""
        tried = cells.select("tokens", *names, F.posexplode(F.lit([x.tolist() for x in pulls])).alias("i", "pull"))
        rate, free = F.col("rate"), (F.col("rate") > 0).cast("double")
        tried = tried.withColumn("rate", F.greatest(F.lit(0.0), reduce(add, [F.col(c) * F.get("pull", F.lit(j)) for j, c in enumerate(names)], F.lit(1.0))))
        rows = tried.groupBy("i").agg(mass(rate, rate).alias("energy"), *[mass(rate, F.col(a)).alias(a) for a in names], *[mass(free, F.col(a), F.col(b)).alias(f"{a}_{b}") for a, b in pairs]).collect()  # a row for each
        got = {r["i"]: {c: x or 0.0 for c, x in r.asDict().items()} for r in rows}
        none = dict.fromkeys(["energy", *names, *[f"{a}_{b}" for a, b in pairs]], 0.0)
        each = [got.get(i, none) for i in range(len(pulls))]
        return [(r["energy"], np.array([r[a] for a in names]), np.array([[r.get(f"{a}_{b}", r.get(f"{b}_{a}")) for b in names] for a in names])) for r in each]

    pull = np.zeros(k)
    energy, reached, curve = at([pull])[0]
    want = targets(dict(zip(DOMAINS, reached, strict=True)), weights)
    goal, soft = np.array([want[d] for d in DOMAINS]), ridge * np.maximum(1.0, reached)
    worth = lambda energy, pull: float(energy / 2 - goal @ pull + (soft * pull * pull).sum() / 2)  # noqa: E731  convex; its gradient is the gaps
    close = lambda reached: bool((np.abs(reached - goal) <= tolerance * np.maximum(1.0, goal)).all())
    falling = [worth(energy, pull)]
    while len(falling) <= steps and not close(reached):
        move = np.linalg.solve(curve + np.diag(soft), goal - reached - soft * pull)
        pulls = [pull + size * move for size in LENGTHS]
        found = at(pulls)
        best = min(range(len(pulls)), key=lambda i: worth(found[i][0], pulls[i]))
        if worth(found[best][0], pulls[best]) >= falling[-1]:
            break  # as near as rates can come
        pull, (energy, reached, curve) = pulls[best], found[best]
        falling.append(worth(energy, pull))
    return Fit(dict(zip(DOMAINS, pull.tolist(), strict=True)), want, dict(zip(DOMAINS, reached.tolist(), strict=True)), close(reached), falling)


def _rated(documents: DataFrame, labels: DataFrame, weights: dict[str, float], seed: int, keep: list[str]) -> tuple[DataFrame, Fit]:
    """``_keep`` (a struct of ``keep``), tokens, p_<domain>, rate and copies of every row; and the fit."""
    labelled = materialize(_labelled(labels))
    lists = word_lists(documents, labelled)
    narrow = materialize(featured(documents, lists, ["doc_id"]).select("_keep.doc_id", "th", "tokens", *BINS))
    posterior, known = classifier(narrow, labelled)
    named = [p.alias(f"p_{d}") for d, p in posterior.items()]
    cells = narrow.groupBy(*BINS).agg(F.sum("tokens").alias("tokens")).select("tokens", *named)
    fit = fit_rates(materialize(cells), weights) if known else Fit(dict.fromkeys(DOMAINS, 0.0), {}, {}, False, [])
    rows = narrow.withColumn("_keep", F.struct("doc_id")) if keep == ["doc_id"] else featured(documents, lists, keep)
    rows = rows.select("_keep", "th", "tokens", *named).withColumn("rate", fit.rate({d: F.col(f"p_{d}") for d in DOMAINS}))
    uniform = F.pmod(F.xxhash64(F.lit(seed), "_keep.doc_id", "th"), F.lit(1 << 30)) / float(1 << 30)
    return rows.withColumn("copies", F.greatest(F.lit(0), F.ceil(F.col("rate") - uniform)).cast("int")), fit


def mix(documents: DataFrame, labels: DataFrame, weights: dict[str, float], seed: int = 17, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) with tokens, p_<domain>, rate, copies and met for every row of ``documents``.

    ``met`` says whether the expected tokens are within the tolerance of every target.
    """
    keep = documents.columns if keep is None else keep
    rows, fit = _rated(documents, labels, weights, seed, keep)
    made = ["tokens", *[f"p_{d}" for d in DOMAINS], "rate", "copies"]
    return rows.select(*[F.col("_keep")[c].alias(c) for c in keep if c not in (*made, "met")], *made, F.lit(fit.met).alias("met"))


def chosen(documents: DataFrame, labels: DataFrame, weights: dict[str, float], seed: int = 17) -> DataFrame:
    """The rows of ``documents``, columns as they are, of which the rates ask for a copy; each once."""
    rows, _ = _rated(documents, labels, weights, seed, documents.columns)
    return rows.filter("copies > 0").select(*[F.col("_keep")[c].alias(c) for c in documents.columns])
