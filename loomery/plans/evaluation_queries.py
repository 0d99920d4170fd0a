"""Registered queries over tokens, evaluations and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from ..operators import evaluation as E
from ..operators import pairs as P
from ..operators import tokens as K
from ..sources.tables import table
from ..streaming import streams as S
from . import corpus_queries as CQ
from . import fact_queries as FQ
from . import run_queries as RQ

QUERIES, SQL = {}, {}
#: A public tokenizer's file; read where the query runs, never copied here.
MERGES = "/opt/tokenizers/byte_bpe_50k.json"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


VOCAB = CQ.SQL["char_vocabulary"]
IDS = f"select doc_id, pos, id from (select doc_id, unnest(string_split(text, '')) as ch, generate_subscripts(string_split(text, ''), 1) as pos from documents where text <> '') join ({VOCAB}) using (ch)"


@query(f"select doc_id, count(id) as n_tokens, md5(coalesce(string_agg(cast(id as varchar), ',' order by pos), '')) as ids_md5 from documents left join ({IDS}) using (doc_id) group by doc_id")
def char_encode(spark: SparkSession, d: str) -> DataFrame:
    """A2, T4."""
    docs = table(spark, d, "documents")
    ids = K.encoder(C.char_vocabulary(docs))(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", ids.alias("ids")).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.md5(F.array_join("ids", ",")).alias("ids_md5"))


@query("select doc_id, md5(text) as text_md5 from documents where text is not null")
def char_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """T4, T5: what is encoded is decoded again."""
    docs = table(spark, d, "documents").filter("text is not null")
    vocab = C.char_vocabulary(docs)
    return docs.select("doc_id", F.md5(K.decoder(vocab)(K.encoder(vocab)(F.col("text")))).alias("text_md5"))


@query("select doc_id, cast(sum(n) over (order by doc_id) - n as bigint) as start, n as n_tokens, eos from (select doc_id, length(coalesce(text, '')) + 2 as n from documents), (select count(*) as eos from (" + VOCAB + "))")
def story_spans(spark: SparkSession, d: str) -> DataFrame:
    """Stories of characters with a start and an end token, and their place in the stream."""
    docs = table(spark, d, "documents")
    vocab = C.char_vocabulary(docs)
    special = K.add_special(K.add_special(vocab, "<eos>"), "<sos>").filter("char_length(ch) > 1").collect()  # two rows
    eos, sos = (next(r["id"] for r in special if r["ch"] == c) for c in ("<eos>", "<sos>"))
    ids = docs.select("doc_id", K.story_ids(K.encoder(vocab)(F.coalesce("text", F.lit(""))), eos, sos).alias("ids"))
    rows = ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.element_at("ids", -1).cast("long").alias("eos"))
    return rows.join(C.offsets(rows, F.col("n_tokens") - 1).select("doc_id", "start"), "doc_id").select("doc_id", "start", "n_tokens", "eos")


@query()
def bpe_pieces(spark: SparkSession, d: str, path: str = MERGES) -> DataFrame:
    """T3, A34, by a public vocabulary; tested against its own encoder on whole texts."""
    e, n = K.encode(table(spark, d, "documents"), K.read_merges(path)), F.size("ids").cast("long")
    return e.select("doc_id", "n_words", "n_chars", n.alias("n_pieces"), F.round(F.try_divide(F.col("n_chars"), n), 6).alias("chars_per_piece"), F.md5(F.array_join("ids", ",")).alias("ids_md5"))


PROBES = f"select ord, \"user\", assistant as expected, case when ord % 5 < 3 then upper(assistant) || '.' when ord % 5 = 3 then lead(assistant, 1, 'nobody') over (order by ord) else 'nothing' end as generated from ({FQ.INVENTORS})"
KEY = FQ.question_sql('"user"')
RELATION = f"list_transform([{KEY}], lambda k: case when (k like 'what did %' and k like '% invent') or (k not like 'what did %' and (k like 'who invented %' or k like 'who is credited with inventing %' or k in ('who invented', 'who is credited with inventing'))) then 'inventor' when k like '%what is the capital of %' or k like '%where is %' or k like '%what country is %' or k like '%''s capital%' then 'capital' else '' end)[1]"
CLASSES = f"""with p as (select ord, {FQ.question_sql('"user"')} as key, {FQ.family_sql('"user"')} as family, {RELATION} as relation, {FQ.answer_sql('expected')} as e, {FQ.answer_sql('generated')} as g from ({PROBES})),
f as (select {FQ.question_sql('"user"')} as key, {FQ.family_sql('"user"')} as family, {RELATION} as relation, {FQ.answer_sql('assistant')} as a from ({FQ.INVENTORS})),
r as (select relation, a, min(key) as low, max(key) as high from f where relation <> '' and a <> '' group by 1, 2), m as (select family, a, min(key) as low, max(key) as high from f where a <> '' group by 1, 2),
c as (select ord, key, p.family, e = g and e <> '' as match, case when e = g and e <> '' then 'MATCH' when coalesce(r.low <> key or r.high <> key, false) then 'BINDING_ENTITY_SWAP' when coalesce(m.low <> key or m.high <> key, false) then 'TEMPLATE_NEIGHBOUR_SWAP' else 'TARGET_MISMATCH' end as classification
  from p left join r on p.relation = r.relation and p.g = r.a left join m on p.family = m.family and p.g = m.a) """


def classified(spark: SparkSession, d: str) -> DataFrame:
    """Answers derived from facts: right ones in another case, the next part's, and none."""
    facts = P.inventors(table(spark, d, "part"))
    after = facts.select((F.col("ord") - 1).alias("ord"), F.col("assistant").alias("after"))  # part keys have no gaps
    answer = F.when(F.col("ord") % 5 < 3, F.concat(F.upper("assistant"), F.lit("."))).when(F.col("ord") % 5 == 3, F.coalesce("after", F.lit("nobody"))).otherwise("nothing")
    return E.classify(facts.join(after, "ord", "left").select("ord", "user", F.col("assistant").alias("expected"), answer.alias("generated")), facts)


@query(CLASSES + "select * from c")
def answer_classes(spark: SparkSession, d: str) -> DataFrame:
    """U2, U6, J12."""
    return classified(spark, d)


@query(CLASSES + "select *, round(ok / n, 6) as exact_rate, round(swap / n, 6) as swap_rate, n >= 3 and swap / n >= 0.4 as collapsing from (select family, count(*) as n, count(*) filter (where match) as ok, count(*) filter (where classification like '%SWAP') as swap from c group by 1)")
def family_summary(spark: SparkSession, d: str) -> DataFrame:
    """A10, A11."""
    return E.family_summary(classified(spark, d))


@query(f"""select count(*) as n, count(*) filter (where label = 'ROUTE_OK') as route_ok, count(*) filter (where label = 'ROUTER_FALSE_MISS') as false_miss, count(*) filter (where label = 'ROUTER_FALSE_HIT') as false_hit,
  round(coalesce(avg(case when hit then cast(label = 'ROUTE_OK' as int) end), 1), 6) as router_precision, round(coalesce(avg(case when asked then cast(label = 'ROUTE_OK' as int) end), 1), 6) as router_recall
  from (select hit, asked, case when asked and hit then 'ROUTE_OK' when asked then 'ROUTER_FALSE_MISS' when hit then 'ROUTER_FALSE_HIT' else 'ROUTE_OK' end as label
  from (select r.qid is not null as hit, c_custkey % 3 < 2 as asked from customer left join ({FQ.RESOLVE}) r on c_custkey = r.qid))""")
def router_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """A question for each customer."""
    routed, known = E.route(*FQ.asked(spark, d)), F.col("c_custkey") % 3 < 2
    key = F.concat(F.lit("what is the capital of "), F.lower("c_name"))
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("qid"), F.when(known, "trained").otherwise("search_or_miss").alias("intent"), F.when(known, key).alias("canonical"))
    return E.router_summary(E.label_routes(routed.join(asked, "qid")))


@query("select run, reason = 'ok' as passed, reason from (select run, case when missed is null then 'missing_anchor_hits' when missed > 0 then 'anchor_miss' when swaps > 0 then 'harvested_entity_swaps=' || swaps when exact < 1 then 'harvested_exact' else 'ok' end as reason from (select user_id as run, case when count(*) > 5 then count(*) filter (where event_type = 'error' and value > 150) end as missed, count(*) filter (where event_type = 'purchase' and value > 120) as swaps, avg(case when value > 1 then 1.0 else 0.0 end) as exact from events group by 1))")
def gate_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """A user's events stand for the answers of a run."""
    e, v = F.col("event_type"), F.col("value")
    n = lambda c: F.count(F.when(c, 1))
    runs = table(spark, d, "events").groupBy(F.col("user_id").alias("run")).agg(F.when(F.count(F.lit(1)) > 5, n((e == "error") & (v > 150))).alias("missed"), n((e == "purchase") & (v > 120)).alias("swaps"), F.avg(F.when(v > 1, 1.0).otherwise(0.0)).alias("exact"))
    return E.gate(runs)


_DUMPS = "trim(text) = '' or contains(lower(text), 'the capital of') or contains(lower(text), ' belongs to the ') or contains(lower(text), 'is the pathogen that causes') or contains(lower(text), 'user:') or contains(lower(text), 'assistant:') or contains(lower(text), 'rotavirus')"
#: Every document stands for a reply; prompts name a word that many of them hold, or none.
REPLIES = "select source as run, case when doc_id % 3 = 0 then 'a mouse named The and a cat named Of' when doc_id % 3 = 1 then 'What is here? ' || doc_id % 2 else 'nobody is named here' end as prompt, case when doc_id % 11 = 0 then 'Well. ONCE upon a Time ' || text else text end as text from documents"


def replies(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    prompt = F.when(i % 3 == 0, "a mouse named The and a cat named Of").when(i % 3 == 1, F.concat(F.lit("What is here? "), (i % 2).cast("string"))).otherwise("nobody is named here")
    return table(spark, d, "documents").select(F.col("source").alias("run"), prompt.alias("prompt"), F.when(i % 11 == 0, F.concat(F.lit("Well. ONCE upon a Time "), "text")).otherwise(F.col("text")).alias("text"))


@query(f"""with r as (select *, case when prompt like '%named Of%' then 'of' end as name from ({REPLIES})), g as (select run, count(*) as n, avg(cast(contains(lower(text), 'once upon a time') as int)) as restarts, count(name) as named, count(*) filter (where contains(lower(text), name)) as held, count(*) filter (where {_DUMPS}) as dumps from r group by 1),
w as (select run, p, s from (select distinct run from r), (values ('What is here? 0', 'THE'), ('What is here? 1', 'que'), ('never asked', 'x')) e(p, s)), h as (select distinct run, p from r join w using (run) where prompt = p and contains(lower(text), lower(s))), m as (select run, count(*) filter (where h.p is null) as missing from w left join h using (run, p) group by 1)
select run, n, round(restarts, 6) as restarts, named, round(held / named, 6) as held_rate, dumps, missing, case when restarts < 0.25 and held / named > 0.5 and dumps = 0 and missing = 0 then 'PASS' else 'REVIEW' end as verdict from g join m using (run)""")
def acceptance(spark: SparkSession, d: str) -> DataFrame:
    """The documents of a source stand for the replies of a run."""
    expected = spark.createDataFrame([("What is here? 0", "THE"), ("What is here? 1", "que"), ("never asked", "x")], "prompt string, substring string")
    return E.acceptance(replies(spark, d), expected)


@query(CLASSES + """, o as (select count(*) as n, count(*) filter (where match) as ok, count(*) filter (where classification like '%SWAP') as swap, count(*) filter (where family in ('layer_stream', 'wiki_extra', 'project', 'theorem') and classification = 'TARGET_MISMATCH') as long_fail,
  count(*) filter (where match and family in ('capital_of', 'organ_system', 'who_invented', 'what_did_invent', 'gas', 'project')) / nullif(count(*) filter (where family in ('capital_of', 'organ_system', 'who_invented', 'what_did_invent', 'gas', 'project')), 0) as short_exact from c)
select n, ok, swap, round(ok / n, 6) as exact_rate, round(swap / n, 6) as swap_rate, long_fail, round(short_exact, 6) as short_exact, (select string_agg(classification || '=' || k, ',' order by classification) from (select classification, count(*) as k from c group by 1)) as classes from o""")
def probe_summary(spark: SparkSession, d: str) -> DataFrame:
    """A10."""
    s = E.probe_summary(classified(spark, d))
    text = F.array_join(F.transform(F.map_entries("classes"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return s.select("n", "ok", "swap", *[F.round(c, 6).alias(c) for c in ("exact_rate", "swap_rate")], "long_fail", F.round("short_exact", 6).alias("short_exact"), text.alias("classes"))


@query(RQ.decisions_sql())
def live_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream, with the decisions of the batch operator."""
    loss = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    rows = S.table_stream(spark, d, "events").select(F.col("event_type").alias("file"), F.col("event_id").alias("ord"), (F.col("event_id") % 700).alias("step"), loss.alias("loss"))
    return S.drain(S.live_runs(rows), "live").select("file", "run", "ord", "step", "action")


KEYED = """with o as (select user_id as key, event_id as ord, case when value < 10 then 'promoted' when value < 20 then 'crash' else 'gate_fail' end as o, event_type as why from events),
g as (select *, sum(case when o = 'gate_fail' then 0 else 1 end) over (partition by key order by ord rows unbounded preceding) as g from o),
k as (select *, case when o = 'gate_fail' then (count(*) filter (where o = 'gate_fail') over (partition by key, g order by ord rows unbounded preceding)) % 2 end as k from g)
select key, ord, bool_or(o = 'promoted') over w as consumed, coalesce(last_value(case when o = 'promoted' then false when o = 'crash' or k = 0 then true end ignore nulls) over w, false) as poison, cast(coalesce(k, 0) as int) as retries,
  nullif(last_value(case when o = 'promoted' then '' when o = 'crash' then why when k = 0 then 'gate:' || why end ignore nulls) over w, '') as reason
from k window w as (partition by key order by ord rows unbounded preceding)"""


@query(KEYED)
def key_state_history(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream of outcomes."""
    outcome = F.when(F.col("value") < 10, "promoted").when(F.col("value") < 20, "crash").otherwise("gate_fail")
    rows = S.table_stream(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("ord"), outcome.alias("outcome"), F.col("event_type").alias("reason"))
    return S.drain(S.key_states(rows), "keys")


@query(f"select distinct key from (select {FQ.question_sql('text')} as key from conversations where role = 'user') where key <> '' and key not in (select {FQ.question_sql('text')} from conversations where role = 'assistant')")
def learned_keys(spark: SparkSession, d: str) -> DataFrame:
    """User turns as a stream, against the static keys of assistant turns."""
    known = table(spark, d, "conversations").filter("role = 'assistant'").select(T.question_key(F.col("text")).alias("key"))
    turns = S.table_stream(spark, d, "conversations").filter("role = 'user'").select(F.col("text").alias("user"))
    base = S.folder(spark, "learned")
    S.learned(turns, known, f"{base}/rows", f"{base}/state").awaitTermination()
    return spark.read.schema("key string").parquet(f"{base}/rows").select("key")
