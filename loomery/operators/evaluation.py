"""Evaluation of answers and routes: classes, family summaries, router labels, gates and acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import pairs as P

#: The classes that count as a swapped answer, and the intents that ask for the index or for none.
SWAPS = ("BINDING_ENTITY_SWAP", "TEMPLATE_NEIGHBOUR_SWAP")
WANTS_INDEX, WANTS_NONE = ("cabinet", "generate", "trained"), ("miss", "search", "search_or_miss", "calc")


def classify(probes: DataFrame, facts: DataFrame) -> DataFrame:
    """Probes (ord, user, expected, generated) with key, family and class.

    An answer is a swap if another question of the same family has it. Facts are reduced to the smallest and largest key of each
    family and answer before the join, which is enough to tell whether a key other than the probe's own is there.
    """
    rows = probes.select("ord", T.question_key(F.col("user")).alias("key"), T.family(F.col("user")).alias("family"), T.relation(F.col("user")).alias("relation"), T.answers_match(F.col("expected"), F.col("generated")).alias("match"), T.answer_key(F.col("generated")).alias("answer"))
    answers = facts.select(T.family(F.col("user")).alias("family"), T.relation(F.col("user")).alias("relation"), T.answer_key(F.col("assistant")).alias("answer"), T.question_key(F.col("user")).alias("k")).filter("answer <> ''")

    def others(name: str) -> DataFrame:
        known = answers.groupBy(name, "answer").agg(F.min("k").alias(f"{name}_low"), F.max("k").alias(f"{name}_high"))
        return known.filter(F.col(name) != "")

    found = rows.join(others("relation"), ["relation", "answer"], "left").join(others("family"), ["family", "answer"], "left")
    other = lambda n: F.coalesce((F.col(f"{n}_low") != F.col("key")) | (F.col(f"{n}_high") != F.col("key")), F.lit(False))
    match = F.coalesce("match", F.lit(False))
    kind = F.when(match, "MATCH").when(other("relation"), SWAPS[0]).when(other("family"), SWAPS[1]).otherwise("TARGET_MISMATCH")
    return found.select("ord", "key", "family", match.alias("match"), kind.alias("classification"))


def family_summary(classified: DataFrame, least: int = 3, share: float = 0.4) -> DataFrame:
    """Rows, matches, swaps and their rates by family, and whether the family collapses."""
    swap = F.col("classification").isin(*SWAPS).cast("int")
    n = classified.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("match").cast("int")).alias("ok"), F.sum(swap).alias("swap"))
    return n.select("family", "n", "ok", "swap", F.round(F.col("ok") / F.col("n"), 6).alias("exact_rate"), F.round(F.col("swap") / F.col("n"), 6).alias("swap_rate"), ((F.col("n") >= least) & (F.col("swap") / F.col("n") >= share)).alias("collapsing"))


def route(queries: DataFrame, index: DataFrame, aliases: DataFrame, quarantine: DataFrame) -> DataFrame:
    """(qid, kind, match_type, key) of typed queries: the index first, then arithmetic, then search, then a miss."""
    hit = P.resolve(queries, index, aliases, quarantine).select("qid", "match_type", "key")
    typed = F.col("typed")
    kind = F.when(F.col("key").isNotNull(), "cabinet").when(T.calc_candidate(typed), "calc").when(T.fact_question(typed), "search").otherwise("miss")
    return queries.join(hit, "qid", "left").select("qid", kind.alias("kind"), "match_type", "key")


def label_routes(routed: DataFrame) -> DataFrame:
    """The label of each route (kind, key) against its intent and canonical question."""
    want = F.lower(F.trim(F.coalesce("intent", F.lit(""))))
    index = F.col("kind") == "cabinet"
    label = F.when(want.isin(*WANTS_INDEX), F.when(index, "ROUTE_OK").otherwise("ROUTER_FALSE_MISS"))
    label = label.when(want.isin(*WANTS_NONE), F.when(index, "ROUTER_FALSE_HIT").when(want.isin("miss") | (want == F.col("kind")) | ((want == "search_or_miss") & F.col("kind").isin("search", "miss")), "ROUTE_OK").otherwise("ROUTER_FALSE_MISS")).otherwise("UNLABELED")
    canonical = T.question_key(F.coalesce("canonical", F.lit("")))
    wrong = index & (canonical != "") & ~canonical.eqNullSafe(F.col("key"))
    return routed.withColumn("label", F.when(wrong, "ROUTER_FALSE_MISS").otherwise(label))


def router_summary(labelled: DataFrame) -> DataFrame:
    """Counts, precision and recall; 1 where there is nothing to divide by."""
    ok, index, asked = F.col("label") == "ROUTE_OK", F.col("kind") == "cabinet", F.col("intent").isin(*WANTS_INDEX)
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    rate = lambda among: F.round(F.coalesce(F.avg(F.when(among, ok.cast("double"))), F.lit(1.0)), 6)
    return labelled.agg(F.count(F.lit(1)).alias("n"), count(ok).alias("route_ok"), count(F.col("label") == "ROUTER_FALSE_MISS").alias("false_miss"), count(F.col("label") == "ROUTER_FALSE_HIT").alias("false_hit"), rate(index).alias("router_precision"), rate(asked).alias("router_recall"))


def gate(summaries: DataFrame) -> DataFrame:
    """Verdicts on (run, missed, swaps, exact); a null ``missed`` is a missing summary and fails."""
    reason = F.when(F.col("missed").isNull(), "missing_anchor_hits").when(F.col("missed") > 0, "anchor_miss").when(F.col("swaps") > 0, F.concat(F.lit("harvested_entity_swaps="), F.col("swaps").cast("string"))).when(F.col("exact") < 1, "harvested_exact").otherwise("ok")
    return summaries.select("run", (reason == "ok").alias("passed"), reason.alias("reason"))


#: Families of long unique answers and of short templates, as probes are summed up.
LONG_UNIQUE = ("layer_stream", "wiki_extra", "project", "theorem")
SHORT_TEMPLATES = ("capital_of", "organ_system", "who_invented", "what_did_invent", "gas", "project")


def probe_summary(classified: DataFrame) -> DataFrame:
    """A10: one row: probes, matches, swaps and their rates, the number of each class, failures of long unique answers, and the exact rate of short templates."""
    swap, match = F.col("classification").isin(*SWAPS), F.col("match")
    cells = classified.groupBy("family", "classification").agg(F.count(F.lit(1)).alias("n"), F.sum(match.cast("long")).alias("ok"), F.sum(swap.cast("long")).alias("swap"), F.sum(((F.col("classification") == "TARGET_MISMATCH") & ~match & F.col("family").isin(*LONG_UNIQUE)).cast("long")).alias("long_fail"))
    short = F.col("family").isin(*SHORT_TEMPLATES)
    classes = cells.groupBy("classification").agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("classification", "n")))).alias("classes"))  # four classes
    total = cells.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "ok", "swap", "long_fail")], F.try_divide(F.sum(F.when(short, F.col("ok"))), F.sum(F.when(short, F.col("n")))).alias("short_exact"))
    rate = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(0.0)
    return total.select("n", "ok", "swap", rate("ok").alias("exact_rate"), rate("swap").alias("swap_rate"), "long_fail", "short_exact").crossJoin(F.broadcast(classes))  # one row each


def ood_summary(replies: DataFrame, neighbours: DataFrame | None = None) -> DataFrame:
    """Per probe mode of replies (mode, prompt, text) their number, the dumps, and the answers that name a fact's neighbour (P11) where ``neighbours`` (prompt, bleed) says so."""
    rows = replies if neighbours is None else replies.join(neighbours, "prompt", "left")
    bleed = F.coalesce(F.contains(F.lower("text"), F.lower("bleed")), F.lit(False)) if neighbours is not None else F.lit(False)
    return rows.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.sum(T.looks_like_dump(F.col("text")).cast("long")).alias("dumps"), F.sum(bleed.cast("long")).alias("bleeds"))


def reply_flags(replies: DataFrame) -> DataFrame:
    """Replies (prompt, text) with the name that the prompt's last "named X" gives, whether the reply holds it, whether it restarts a story, and whether it is a dump."""
    names = F.regexp_extract_all("prompt", F.lit(r"\bnamed\s+([A-Z][a-z]+)"), F.lit(1))
    name = F.coalesce(F.try_element_at(names, F.lit(-1)), F.lit(""))
    low = F.lower("text")
    return replies.withColumns({"name": name, "name_held": (name != "") & F.contains(low, F.lower(name)), "restart": F.contains(low, F.lit("once upon a time")), "dump": T.looks_like_dump(F.col("text"))})


def acceptance(replies: DataFrame, expected: DataFrame | None = None, most_restarts: float = 0.25, least_named: float = 0.5) -> DataFrame:
    """Per run of replies (run, prompt, text) the checks and PASS or REVIEW.

    Fewer than ``most_restarts`` of all replies restart, more than ``least_named`` of those with a name hold it (none with a name fails), no reply is a dump, and
    each ``expected`` (prompt, substring) is in a reply to its prompt, without regard to case.
    """
    flags = reply_flags(replies)
    named = F.col("name") != ""
    r = flags.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("restart").cast("double")).alias("restarts"), F.sum(named.cast("long")).alias("named"), F.sum(F.col("name_held").cast("long")).alias("held"), F.sum(F.col("dump").cast("long")).alias("dumps"))
    met = F.lit(True)
    if expected is not None:
        wanted = F.broadcast(expected.select("prompt", F.lower("substring").alias("_s")))  # a few prompts that are asked for
        runs = replies.select("run").distinct().crossJoin(wanted)
        hits = replies.join(wanted, "prompt").groupBy("run", "prompt", "_s").agg(F.bool_or(F.contains(F.lower("text"), F.col("_s"))).alias("hit"))
        missing = runs.join(hits, ["run", "prompt", "_s"], "left").groupBy("run").agg(F.count_if(~F.coalesce("hit", F.lit(False))).alias("missing"))
        r, met = r.join(missing, "run", "left"), F.coalesce("missing", F.lit(0)) == 0
    share = F.when(F.col("named") > 0, F.col("held") / F.col("named"))
    good = (F.col("restarts") < most_restarts) & F.coalesce(share > least_named, F.lit(False)) & (F.col("dumps") == 0) & met
    return r.select("run", "n", F.round("restarts", 6).alias("restarts"), "named", F.round(share, 6).alias("held_rate"), "dumps", *(["missing"] if expected is not None else []), F.when(good, "PASS").otherwise("REVIEW").alias("verdict"))
