"""Registered queries over times, manifests, bands, summaries and configured values, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import packs as K
from ..operators import pairs as P
from ..operators import reports as R
from ..sources import sinks
from ..sources.tables import table
from . import fact_queries as FQ

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query("select event_id, strftime(ts, '%Y%m%dT%H%M%S%f') as id, cast(epoch(date_trunc('second', ts)) as bigint) as at from events")
def event_times(spark: SparkSession, d: str) -> DataFrame:
    """An id from each event's time, and the time at the start of its line."""
    e = table(spark, d, "events")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" | INFO | "), "event_type")
    return e.select("event_id", R.event_id(F.col("ts")).alias("id"), F.unix_timestamp(R.line_time(line)).alias("at"))


@query("with m as (select count(*) as n_docs, sum(length(text)) as n_chars, sum(strlen(text)) as n_bytes from documents) select field, '-1' as expected, cast(got as varchar) as got from (select 'n_docs' as field, n_docs as got from m union all select 'n_chars', n_chars from m union all select 'n_bytes', n_bytes from m)")
def manifest_check(spark: SparkSession, d: str) -> DataFrame:
    """The manifest of the documents against one that expects otherwise in every count."""
    found = sinks.manifest(table(spark, d, "documents"))
    return R.expectation_mismatches(found, {"n_docs": -1, "n_chars": -1, "n_bytes": -1})


@query("""with m as (select role = 'assistant' as is_fact, text as line, case when conv_id % 50 = 0 and turn = 1 then text else text || ' User:' end as text from conversations), p as (select is_fact, line, count(*) as n, min(cast(ends_with(text, ' User:') as int)) as stops from m group by 1, 2)
select cast(sum(n) as bigint) as n, cast(sum(n) filter (where is_fact) as bigint) as facts, round(sum(n) filter (where is_fact) / sum(n), 6) as share, max(n) filter (where is_fact) as repeats, sum(n) filter (where is_fact) / sum(n) between 0.4 and 0.5 and max(n) filter (where is_fact) < 300 and min(stops) filter (where is_fact) = 1 as good from p""")
def fact_band(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns as a mix's facts, some without the stop marker."""
    c = table(spark, d, "conversations")
    bare = (F.col("conv_id") % 50 == 0) & (F.col("turn") == 1)
    return K.fact_share(c.select((F.col("role") == "assistant").alias("is_fact"), F.col("text").alias("line"), F.when(bare, F.col("text")).otherwise(F.concat("text", F.lit(" User:"))).alias("text")))


_SUMMARY = "select doc_id, case when doc_id % 7 = 0 then 'disambiguation' else 'standard' end as kind, case when doc_id % 3 = 0 then '' when doc_id % 11 = 0 then source || ' may refer to .' else text end as extract, source as description from documents"


@query(f"""with s as (select doc_id, kind, {FQ.collapse_sql("coalesce(nullif(extract, ''), description)")} as t from ({_SUMMARY})), u as (select doc_id, t from s where kind <> 'disambiguation' and t <> '' and not ends_with(regexp_replace(lower(t), '[ .]+$', ''), 'may refer to'))
select doc_id, md5(t) as summary_md5, md5(array_to_string(list_slice(string_split_regex(regexp_replace(t, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), 1, 2), ' ')) as clip_md5 from u""")
def usable_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Documents as page extracts, some of disambiguation pages, some stubs, some with a description only; clipped to two sentences."""
    i = F.col("doc_id")
    kind = F.when(i % 7 == 0, "disambiguation").otherwise("standard")
    extract = F.when(i % 3 == 0, "").when(i % 11 == 0, F.concat("source", F.lit(" may refer to ."))).otherwise(F.col("text"))
    s = table(spark, d, "documents").select("doc_id", K.usable_summary(kind, extract, F.col("source")).alias("t")).filter("t is not null")
    return s.select("doc_id", F.md5("t").alias("summary_md5"), F.md5(T.first_sentences(F.col("t"))).alias("clip_md5"))


@query("select user_id as name, cast(n as varchar) as inferred, cast(n + 1 as varchar) as configured from (select user_id, count(*) as n from events group by 1) where user_id % 4 = 0 and user_id % 5 <> 0")
def sidecar_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """Counts of users against configured ones, of which every fourth is wrong and every fifth is missing."""
    n = table(spark, d, "events").groupBy(F.col("user_id").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    configured = n.filter("name % 5 <> 0").select("name", (F.col("n") + (F.col("name") % 4 == 0).cast("int")).cast("string").alias("value"))
    return R.sidecar_mismatches(n.select("name", F.col("n").cast("string").alias("value")), configured)


@query(f"""with e as (select distinct {FQ.answer_sql('assistant')} as answer, {FQ.question_sql('"user"')} as question from ({FQ.FACTS})) select answer, question from e where answer in (select answer from e group by 1 having count(*) >= 2)""")
def sharing_questions(spark: SparkSession, d: str) -> DataFrame:
    """The questions of every shared answer."""
    return P.sharing_questions(FQ.all_facts(spark, d))
