"""Registered queries over entities, related prompts, template hits and folded labels, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import topics
from ..operators import pairs as P
from ..operators import related as R
from ..sources.tables import table
from .fact_queries import INVENTORS, collapse_sql, fold_sql, question_sql

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def place_facts(spark: SparkSession, d: str) -> DataFrame:
    """A fact for each customer, whose answer names the nation: an entity that many facts share."""
    rows = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    facts = rows.select(F.col("c_custkey").alias("ord"), F.concat(F.lit("Tell me about "), "c_name", F.lit(".")).alias("user"), F.concat("c_name", F.lit(" is the capital of "), "n_name", F.lit(".")).alias("assistant"))
    return facts.withColumn("key", T.question_key(F.col("user")))


PLACES = "select c_custkey as ord, c_name, n_name, 'Tell me about ' || c_name || '.' as \"user\" from customer join nation on c_nationkey = n_nationkey"


@query(f"select ord, unnest([{fold_sql('c_name')}, {fold_sql('n_name')}]) as entity from ({PLACES})")
def entities_of_facts(spark: SparkSession, d: str) -> DataFrame:
    """U5."""
    return R.entity_index(place_facts(spark, d)).select("ord", "entity")


@query(f"""with f as (select *, row_number() over (partition by n_name order by ord) as n from ({PLACES}))
select a.ord as qid, cast(row_number() over (partition by a.ord order by b.ord) as int) as rank, b.ord as ord, b."user" as related
from f a join f b on a.n_name = b.n_name and a.ord <> b.ord where b.n <= 6 qualify rank <= 5""")
def related_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Every fact asks for those it shares an entity with."""
    index = R.entity_index(place_facts(spark, d))
    return R.related_prompts(index.select(F.col("ord").alias("qid"), "entity", "key"), index)


TYPED = "select ord as qid, case when ord % 3 = 0 then replace(\"user\", 'invented ', 'invented the ') else \"user\" end as typed from (" + INVENTORS + ")"


@query(f"""with i as (select {question_sql('"user"')} as key, arg_min(assistant, ord) as assistant from ({INVENTORS}) group by 1)
select qid, i.key, assistant, case when k = i.key then 'exact' else 'template' end as match_type
from (select qid, {question_sql('typed')} as k from ({TYPED})) join i on i.key = replace(k, 'invented the ', 'invented ')""")
def template_hits(spark: SparkSession, d: str) -> DataFrame:
    """Questions with and without an article before the slot."""
    facts = P.inventors(table(spark, d, "part"))
    typed = F.when(F.col("ord") % 3 == 0, F.replace("user", F.lit("invented "), F.lit("invented the "))).otherwise(F.col("user"))
    index = P.build_index(facts)
    return R.template_hits(facts.select(F.col("ord").alias("qid"), typed.alias("typed")), index, R.entity_index(index))


@query()
def folded_texts(spark: SparkSession, d: str) -> DataFrame:
    """H8 on whole texts; no SQL, as DuckDB has no compatibility decomposition."""
    folded = T.fold_label(F.col("text"))
    return table(spark, d, "documents").select("doc_id", folded.alias("folded")).select("doc_id", F.length("folded").cast("long").alias("n_chars"), F.sha2(F.col("folded").cast("binary"), 256).alias("sha256"))


@query(f"select doc_id, {topics.topic_sql('line')} as topic from (select doc_id, {collapse_sql('text')} as line from documents)")
def document_topics(spark: SparkSession, d: str) -> DataFrame:
    """U4 on whole texts."""
    return table(spark, d, "documents").select("doc_id", topics.topic(F.col("text")).alias("topic"))
