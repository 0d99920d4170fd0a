"""Question and answer pairs: derivation, duplicates, conflicts, the fact index and mixes.

Every ordered input has ``ord BIGINT``. Three conflict rules exist and keep their own names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T


def adjacent_turns(turns: DataFrame) -> DataFrame:
    """User turns with the assistant turn right after, as (ord, user, assistant)."""
    w = W.partitionBy("conv_id").orderBy("turn")
    nxt = turns.select("*", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("assistant"))
    return nxt.filter("role = 'user' and next_role = 'assistant'").select((F.col("conv_id") * (1 << 20) + F.col("turn")).alias("ord"), F.col("text").alias("user"), "assistant")


def capitals(nation: DataFrame, region: DataFrame) -> DataFrame:
    """H15, kind capitals: (ord, user, assistant)."""
    rows = nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"])  # five regions
    return rows.select(F.col("n_nationkey").cast("long").alias("ord"), F.concat(F.lit("What is the capital of "), "n_name", F.lit("?")).alias("user"), F.col("r_name").alias("assistant"))


def inventors(part: DataFrame) -> DataFrame:
    """H15, kind inventors."""
    return part.select(F.col("p_partkey").alias("ord"), F.concat(F.lit("Who invented "), "p_name", F.lit(" "), "p_type", F.lit(" "), F.col("p_size").cast("string"), F.lit("?")).alias("user"), F.col("p_brand").alias("assistant"))


def elements(part: DataFrame) -> DataFrame:
    """H15, kind elements."""
    return part.select(F.col("p_partkey").alias("ord"), F.concat(F.lit("What is the atomic number of "), "p_name", F.lit(" "), "p_brand", F.lit("?")).alias("user"), F.col("p_size").cast("string").alias("assistant"))


def birth_years(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """H15 and H16, kind birth years: the year of a customer's first order. Aggregated before the join."""
    first = orders.groupBy("o_custkey").agg(F.year(F.min("o_orderdate")).alias("y"))
    rows = customer.join(first, customer["c_custkey"] == first["o_custkey"]).filter(F.col("y").between(1, 2100))
    return rows.select(F.col("c_custkey").alias("ord"), F.concat(F.lit("When was "), "c_name", F.lit(" born?")).alias("user"), F.col("y").cast("string").alias("assistant"))


#: Pairs that are worth a task of their own where pairs are multiplied or gathered by text.
PAIRS_A_TASK = 50_000


def tasks_for(pairs: DataFrame) -> int:
    """The number of tasks that keeps a task's pairs, and the memory of its sorts, the same whatever the number of pairs."""
    return max(pairs.sparkSession.sparkContext.defaultParallelism, -(-pairs.count() // PAIRS_A_TASK))


def first_per(rows: DataFrame, *keys: Column | str, tasks: int | None = None) -> DataFrame:
    """The first row by ``ord`` for each key. One partial aggregate, no sort; with ``tasks`` the rows are dealt to so many by key first."""
    rest = F.struct("ord", *[c for c in rows.columns if c != "ord"])
    named = [k.alias(f"_k{i}") if isinstance(k, Column) else F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    by = [f"_k{i}" for i in range(len(keys))]
    keyed = rows.select(*named, rest.alias("_row"))
    first = (keyed.repartition(tasks, *by) if tasks else keyed).groupBy(*by).agg(F.min("_row").alias("_row"))
    return first.select(*[F.col("_row")[c].alias(c) for c in rows.columns])


def dedupe(pairs: DataFrame, tasks: int | None = None) -> DataFrame:
    """A3: distinct pairs without regard to case, first wins."""
    return first_per(pairs, F.lower("user"), F.lower("assistant"), tasks=tasks)


def drop_conflicts(pairs: DataFrame, tasks: int | None = None) -> DataFrame:
    """A4: questions with two or more different answers (but for blanks and case) vanish, of the others the first pair stays."""
    row = F.struct("ord", "user", "assistant")
    key, answer = T.pair_key(F.col("user")), T.pair_key(F.col("assistant"))
    keyed = pairs.select(key.alias("k"), answer.alias("a"), row.alias("r"))
    kept = (keyed.repartition(tasks, "k") if tasks else keyed).groupBy("k").agg(F.min("a").alias("low"), F.max("a").alias("high"), F.min("r").alias("r")).filter("low = high")
    return kept.select("r.ord", "r.user", "r.assistant")


def last_answer(pairs: DataFrame) -> DataFrame:
    """A5: the last answer for each user text."""
    return pairs.groupBy("user").agg(F.max_by("assistant", "ord").alias("assistant"))


def build_index(facts: DataFrame, quarantine: DataFrame | None = None) -> DataFrame:
    """The first answer for each key, with the number of pairs that gave another; quarantined and empty keys are left out."""
    keyed = facts.withColumn("key", T.question_key(F.col("user"))).filter("key <> ''")
    if quarantine is not None:
        keyed = keyed.join(quarantine.select("key").distinct(), "key", "left_anti")
    # Counted by key and answer first, so that a hot key is never gathered as a list.
    per = keyed.groupBy("key", T.answer_key(F.col("assistant")).alias("answer")).agg(F.min(F.struct("ord", "user", "assistant")).alias("f"), F.count(F.lit(1)).alias("n"))
    first = per.groupBy("key").agg(F.min(F.struct("f", "answer", "n")).alias("a"), F.sum(F.when(F.col("answer").isNotNull(), F.col("n"))).alias("total"))
    rejected = F.when(F.col("a.answer").isNull(), 0).otherwise(F.col("total") - F.col("a.n")).cast("int")
    return first.select("key", "a.f.ord", "a.f.user", "a.f.assistant", rejected.alias("rejected"))


def lookup(queries: DataFrame, index: DataFrame, source: str | None = None) -> DataFrame:
    """Queries (qid, typed) with the fact of the same key, if any; with ``source`` only facts of that ``source``."""
    facts = index if source is None else index.filter(F.col("source") == source)
    keyed = queries.withColumn("key", T.question_key(F.col("typed")))
    return keyed.join(facts.select("key", "assistant"), "key", "left").select("qid", "key", "assistant")


def resolve(queries: DataFrame, index: DataFrame, aliases: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Exact key, then file alias, then topic, then a unique article variant; nothing for quarantined queries.

    Candidate keys of all arms go through one join with the index.
    """
    q = queries.withColumn("typed_key", T.question_key(F.col("typed"))).join(quarantine.select(F.col("key").alias("typed_key")), "typed_key", "left_anti")
    topic = T.fold(T.search_topic(F.col("typed")))
    arms = q.join(aliases.select(F.col("alias").alias("typed_key"), F.col("key").alias("alias_key")), "typed_key", "left")
    cand = lambda k, p, m: F.struct(k.alias("key"), F.lit(p).alias("prio"), F.lit(m).alias("match_type"))
    variants = F.transform(T.article_variants(topic), lambda v: cand(F.concat(F.lit("what is "), v), 4, "article"))
    all_arms = F.concat(F.array(cand(F.col("typed_key"), 1, "exact"), cand(F.col("alias_key"), 2, "alias"), cand(F.concat(F.lit("tell me about "), topic), 3, "topic")), variants)
    found = arms.select("qid", F.explode(all_arms).alias("c")).select("qid", "c.key", "c.prio", "c.match_type").join(index.select("key", "assistant"), "key")
    found = found.join(quarantine.select("key"), "key", "left_anti")
    per = found.groupBy("qid", "prio").agg(F.min("match_type").alias("match_type"), F.min("key").alias("key"), F.min_by("assistant", "key").alias("assistant"), F.count_distinct("key").alias("n")).filter("prio < 4 or n = 1")
    best = per.groupBy("qid").agg(F.min(F.struct("prio", "match_type", "key", "assistant")).alias("b"))
    return best.select("qid", "b.match_type", "b.key", "b.assistant")


def neighbours(facts: DataFrame) -> DataFrame:
    """For each fact the first other one of its family with the same answer."""
    keyed = facts.select("ord", T.family(F.col("user")).alias("family"), T.answer_key(F.col("assistant")).alias("answer"))
    # The two smallest of a group are enough: everyone's neighbour is the smallest but themselves.
    low = keyed.groupBy("family", "answer").agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("n"))
    second = keyed.join(low.filter("n > 1"), ["family", "answer"]).filter("ord <> first").groupBy("family", "answer").agg(F.min("ord").alias("second"))
    out = keyed.join(low.join(second, ["family", "answer"]), ["family", "answer"])
    return out.select("ord", F.when(F.col("ord") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("neighbour"))


def entities_in(texts: DataFrame, entities: DataFrame, longest: int | None = None) -> DataFrame:
    """Known entities (entity, folded) in texts (id, text) as whole words, by word n-grams and an equal join.

    The n-grams are as long as the longest entity.
    """
    longest = longest or entities.agg(F.max(F.size(F.split("entity", " ")))).first()[0] or 1
    words = F.split(T.answer_key(F.col("text")), " ")
    rows = texts.select("id", words.alias("w"))

    def grams_of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - n + 1)), lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))

    grams = [grams_of(n) for n in range(1, longest + 1)]
    flat = rows.select("id", F.explode_outer(F.array_distinct(F.concat(*grams))).alias("entity"))
    return flat.join(entities.select("entity").distinct(), "entity").select("id", "entity").distinct()


def shared_answers(pairs: DataFrame) -> DataFrame:
    """Answers used by two or more questions."""
    return pairs.groupBy(T.answer_key(F.col("assistant")).alias("answer")).agg(F.count_distinct(T.question_key(F.col("user"))).alias("questions")).filter("questions >= 2")


def sharing_questions(pairs: DataFrame) -> DataFrame:
    """(answer, question): a row for each question of a shared answer, so an answer of any number of questions is in no one row."""
    each = pairs.select(T.answer_key(F.col("assistant")).alias("answer"), T.question_key(F.col("user")).alias("question")).distinct()
    shared = each.groupBy("answer").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").drop("n")
    return each.join(shared, "answer")


def repeat(pairs: DataFrame, times: int | Column) -> DataFrame:
    """Each pair ``times`` times, with its number; after any shuffle, so it never inflates one."""
    n = F.lit(times) if isinstance(times, int) else times
    return pairs.select("*", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), n))).alias("rep"))


def round_robin(pairs: DataFrame, n: int, seed: str = "7") -> DataFrame:
    """One pair of each family after the other, in hash order, until n."""
    f = pairs.withColumn("family", T.family(F.col("user"))).withColumn("h", F.md5(F.concat(F.lit(seed + ":"), F.col("ord").cast("string"))))
    ranked = f.withColumn("round", F.row_number().over(W.partitionBy("family").orderBy("h", "ord"))).filter(F.col("round") <= n)
    return ranked.orderBy("round", F.md5(F.concat(F.lit(seed + ":"), "family")), "family").limit(n).select("ord", "family", "round")
