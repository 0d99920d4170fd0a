"""Entities of facts, related prompts and template hits, as joins on entities and keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T

#: Templates of questions and answers whose groups are entities, on the folded text.
QUESTION_ENTITIES = (
    r"^what is the capital of (.+)$",
    r"^who invented (.+)$",
    r"^what is the atomic number of (.+)$",
    r"^when was (.+) born$",
    r"^tell me about (.+)$",
    r"^what is (.+)'s capital$",
    r"^what country is (.+) in$",
    r"^where is (.+)$",
)
ANSWER_ENTITIES = (
    r"^the capital of (.+) is (.+)$",
    r"^(.+) is the capital of (.+)$",
    r"^(.+) is credited with inventing (.+)$",
    r"^the atomic number of (.+) is ([0-9]+)$",
)
#: What stands before and after the entity in a question that follows one up.
FOLLOW_UPS = (
    ("where is ", ""),
    ("what country is ", " in"),
    ("what is the capital of ", ""),
    ("what is ", "'s capital"),
    ("who invented ", ""),
    ("who is credited with inventing ", ""),
    ("what did ", " invent"),
    ("what is the atomic number of ", ""),
    ("which element has atomic number ", ""),
    ("tell me about ", ""),
    ("when was ", " born"),
    ("what is ", ""),
)


def fact_entities(user: Column, assistant: Column) -> Column:
    """The distinct entities that the closed templates find in a question and its answer; empty if none fits."""
    asked, answered = T.question_key(user), T.bare_entity(assistant)
    found = [F.regexp_extract(asked, p, 1) for p in QUESTION_ENTITIES]
    found += [F.regexp_extract(answered, p, g) for p in ANSWER_ENTITIES for g in (1, 2)]
    return F.array_remove(F.array_compact(F.array_distinct(F.array(*map(T.bare_entity, found)))), "")


def entity_index(facts: DataFrame) -> DataFrame:
    """(entity, ord, key, user) of facts (ord, key, user, assistant), a row for each entity of a fact."""
    return facts.select(F.explode(fact_entities(F.col("user"), F.col("assistant"))).alias("entity"), "ord", "key", "user")


#: So many facts (a key and a question each) are broadcast; else askers of an entity are dealt over so many salts.
FEW_FACTS, SALTS = 1 << 16, 64


def related_prompts(asked: DataFrame, index: DataFrame, limit: int = 5) -> DataFrame:
    """For asked (qid, entity, key) the first ``limit`` facts by ``ord`` that share an entity and have another key; ``rank`` from 1.

    Only one key is excluded, so the first ``limit + 1`` facts of an entity are enough: a hot entity is cut to them
    before the shuffle (a row number below a bound is taken in each partition first) and never meets its askers whole.
    Keys of the index are unique. A null or unknown entity has no related facts; a null key excludes none.
    """
    first = index.withColumn("_n", F.row_number().over(W.partitionBy("entity").orderBy("ord", "key"))).filter(F.col("_n") <= limit + 1)
    other = first.select("entity", "ord", F.col("key").alias("related_key"), F.col("user").alias("related"))
    # An entity may be asked for by any share of all; its few facts are broadcast, or beyond that copied for each of a number of salts.
    if first.limit(FEW_FACTS + 1).count() <= FEW_FACTS:
        pairs = asked.join(F.broadcast(other), "entity")
    else:
        salted = other.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = asked.withColumn("_s", F.pmod(F.xxhash64("qid"), F.lit(SALTS)).cast("int")).join(salted, ["entity", "_s"]).drop("_s")
    met = pairs.filter(F.col("key").isNull() | (F.col("key") != F.col("related_key")))
    met = met.select("qid", "ord", "related_key", "related").distinct()
    return met.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("ord", "related_key"))).filter(F.col("rank") <= limit).select("qid", "rank", "ord", "related")


def _slots(key: Column) -> Column:
    """(slot, before, after) of each follow-up template that the key has."""
    cut = lambda a, b: F.substring(key, F.lit(len(a) + 1), F.length(key) - len(a) - len(b))
    fits = lambda a, b: F.startswith(key, F.lit(a)) & F.endswith(key, F.lit(b)) & (F.length(key) > len(a) + len(b))
    return F.array_compact(F.array(*[F.when(fits(a, b), F.struct(cut(a, b).alias("slot"), F.lit(a).alias("before"), F.lit(b).alias("after"))) for a, b in FOLLOW_UPS]))


def template_hits(typed: DataFrame, index: DataFrame, entities: DataFrame, session: DataFrame | None = None) -> DataFrame:
    """For typed (qid, typed) the fact of the same key, else those of a follow-up template about a known entity.

    A template is a hit with its slot as typed or with another article, if the slot is an entity of ``entities`` that the
    question mentions, or one of the ``session`` (qid, entity). The slot is read from the question, so the joins are equal
    ones on keys and entities, and no question meets all entities. Empty and null questions have no hits.
    """
    asked = typed.select("qid", T.question_key(F.col("typed")).alias("key")).filter("key <> ''")
    slots = asked.select("qid", "key", F.explode(_slots(F.col("key"))).alias("s"))
    forms = slots.select("qid", F.col("key").alias("typed_key"), "s.before", "s.after", F.explode(T.article_variants(F.col("s.slot"))).alias("entity"))
    # As typed, or without the article before it: then it ends the question but for what follows a slot.
    mentioned = F.endswith("typed_key", F.concat(F.lit(" "), "entity", "after"))
    kept = [forms.filter(mentioned).join(entities.select("entity").distinct(), "entity", "left_semi")]
    if session is not None:
        kept.append(forms.join(session.select("qid", T.bare_entity(F.col("entity")).alias("entity")).distinct(), ["qid", "entity"], "left_semi").select(kept[0].columns))
    hits = reduce(DataFrame.unionByName, kept).select("qid", F.concat("before", "entity", "after").alias("key"), F.lit(1).alias("prio"))
    found = asked.select("qid", "key", F.lit(0).alias("prio")).unionByName(hits).distinct().join(index.select("key", "assistant"), "key")
    best = found.groupBy("qid").agg(F.min("prio").alias("prio"))
    return found.join(best, ["qid", "prio"]).select("qid", "key", "assistant", F.when(F.col("prio") == 0, "exact").otherwise("template").alias("match_type")).distinct()
