"""Registered queries over fact packs, mixes, chats and run reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quality as Q
from ..functions import text as T
from ..operators import packs as K
from ..operators import pairs as P
from ..operators import reports as R
from ..operators import scan as S
from ..sources.tables import table
from . import fact_queries as FQ
from .fact_queries import answer_sql, collapse_sql, family_sql, question_sql, told, turns

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def bindings(spark: SparkSession, d: str) -> DataFrame:
    """A binding row of each kind in turn for every part."""
    part, names = table(spark, d, "part"), list(K.KINDS)
    kind = F.element_at(F.lit(names), (F.col("p_partkey") % len(names) + 1).cast("int"))
    label = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("Q"), F.col("p_partkey").cast("string"))).otherwise(F.concat("p_name", F.lit("  "), F.col("p_partkey").cast("string")))
    number = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_retailprice").cast("string"))
    numeric = ("year", "number", "value")
    cells = lambda k: F.create_map(*[x for c in dict.fromkeys(K.KINDS[k][1:3]) for x in (F.lit(c), (F.when(F.col("p_size") % 2 == 0, (F.col("p_size") * 47).cast("string")).otherwise(F.lit("unknown")) if c == "year" else number) if c in numeric else (label if c == K.KINDS[k][1] else F.col("p_type")))])
    return part.select(F.col("p_partkey").alias("ord"), kind.alias("kind"), F.coalesce(*[F.when(kind == k, cells(k)) for k in names]).alias("cells"))


_A = "case when p_partkey % 7 = 0 then 'Q' || p_partkey else p_name || '  ' || p_partkey end"
_FOLD = f"case when k < 4 then a else {collapse_sql('a')} end"
_NUM = "case when p_partkey % 3 = 0 then cast(p_size as double) else p_retailprice end"
_SIG = "case when abs(x - round(x)) < 1e-9 then cast(cast(round(x) as bigint) as varchar) else regexp_replace(regexp_replace(printf('%.12f', round(x * pow(10, 5 - floor(log10(abs(x))))) / pow(10, 5 - floor(log10(abs(x))))), '0+$', ''), '[.]$', '') end"
_NAMED = ", ".join(f"({i}, '{k}', '{v[0]}', '{v[3]}', '{v[4]}', {str('Label' in v[1]).lower()}, {str('Label' in v[2] or v[2] == 'formula').lower()})" for i, (k, v) in enumerate(K.KINDS.items()))


@query(f"""with b as (select p_partkey as ord, p_partkey % 16 as k, {_A} as a, p_type as t, {_NUM} as x, p_size from part),
n as (select ord, k, kinds.name as kind, domain, q, f, {_FOLD} as a, t, {_SIG} as num, x, case when p_size % 2 = 0 and p_size * 47 between 1 and 2100 then cast(p_size * 47 as varchar) end as y, p_size,
  regexp_full_match(a, 'Q[0-9]+') as item from b join (values {_NAMED}) kinds(i, name, domain, q, f, la, lb) on i = k),
v as (select *, case when kind in ('lang_years', 'protocols') then y when kind = 'birth_years' then case when p_size % 2 = 0 then cast(p_size * 47 as varchar) end when kind = 'elements' then cast(cast(trunc(x) as bigint) as varchar)
  when kind = 'math_constants' then case when num not in ('0', '1', '-1') then num end when kind = 'prime_numbers' then case when regexp_full_match(num, '[0-9]+') and x >= 2 then num end
  when kind = 'composite_numbers' then case when regexp_full_match(num, '[0-9]+') and x >= 4 then num end else t end as val from n)
select ord, kind, domain, replace(replace(q, '{{0}}', one), '{{1}}', val) as "user", replace(replace(f, '{{0}}', one), '{{1}}', val) as assistant
from (select *, case when kind in ('prime_numbers', 'composite_numbers') then val when not item then a end as one from v) where val is not null and one is not null""")
def verbalized_facts(spark: SparkSession, d: str) -> DataFrame:
    """S15, H15 to H17, P1, P17."""
    return K.verbalized(bindings(spark, d))


@query(FQ.linked_sql(FQ.ELEMENTS_TOLD))
def linked_elements(spark: SparkSession, d: str) -> DataFrame:
    """H18 for elements, O2."""
    return FQ.linked(told(spark, d, "element"))


_EXISTING = f"select {question_sql('\"user\"')} as key from ({FQ.ELEMENTS}) where ord % 3 = 0"


@query(f"""with l as (select ord, \"user\", assistant, {question_sql('"user"')} as key from ({FQ.ELEMENTS_TOLD}) where length(assistant) <= 512 and not (rtrim(lower(assistant), ' .:') like '%may refer to')),
f as (select min(ord) as ord, key from l where key <> '' and key not in ({_EXISTING}) group by key)
select l.ord, l.\"user\", l.assistant from l join f using (ord)""")
def learned_extras(spark: SparkSession, d: str) -> DataFrame:
    """Told elements that the trained third doesn't have."""
    return K.learned_extras(told(spark, d, "element"), P.elements(table(spark, d, "part")).filter("ord % 3 = 0"))


@query(f"""with t as (select distinct {answer_sql('assistant')} as a from ({FQ.INVENTORS})), g as (select doc_id as id, text, {answer_sql('text')} as a from documents)
select id, a <> '' and (a in (select a from t where a <> '') or regexp_matches(text, '(?i)the capital of .+ is .+|.+ is the capital of .+|.+ belongs to the .+|.+ is the pathogen that causes .+|.+ is credited with inventing .+|.+ was born in [0-9]+|.+ was first released in [0-9]+|(yes|no), [0-9]+ is a (prime|composite) number')) as copied from g""")
def ood_copies(spark: SparkSession, d: str) -> DataFrame:
    """J18."""
    return K.ood_copies(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("generated")), P.inventors(table(spark, d, "part")))


_HARVEST = f"select ord, \"user\" as typed, case when ord % 4 = 0 then assistant when ord % 4 = 1 then ' ' end as expected from ({FQ.INVENTORS_TOLD})"


@query(f"""with k as (select {question_sql('"user"')} as key, arg_max("user", ord) as u, arg_max(assistant, ord) as a from ({FQ.INVENTORS_TOLD}) where ord % 2 = 1 group by 1)
select * from (select h.ord, case when trim(expected) <> '' then typed else u end as "user", case when trim(expected) <> '' then trim(expected) else a end as assistant from ({_HARVEST}) h left join k on {question_sql('typed')} = k.key) where assistant is not null""")
def harvest_pairs(spark: SparkSession, d: str) -> DataFrame:
    """J16."""
    facts = told(spark, d, "inventor")
    harvest = facts.select("ord", F.col("user").alias("typed"), F.when(F.col("ord") % 4 == 0, F.col("assistant")).when(F.col("ord") % 4 == 1, " ").alias("expected"))
    return K.harvest_pairs(harvest, facts.filter("ord % 2 = 1"))


_FACTS = f"select ord, \"user\", assistant from ({FQ.INVENTORS_TOLD}) union all select ord + 1000000000000, \"user\", assistant from ({FQ.CAPITALS_TOLD})"


def told_facts(spark: SparkSession, d: str) -> DataFrame:
    return told(spark, d, "inventor").unionByName(told(spark, d, "capital").withColumn("ord", F.col("ord") + 10**12))


@query(f"""with p as (select "user", arg_max(assistant, ord) as assistant from ({_FACTS}) group by 1), m as (select n_nationkey as pos, {question_sql("'What is the capital of ' || n_name")} as key from nation),
f as (select "user", assistant, min(pos) as pos from p join m on {question_sql('"user"')} = key group by 1, 2),
c as (select {family_sql('"user"')} as fam, count(*) as spent from f group by 1),
r as (select p.*, {family_sql('"user"')} as fam, row_number() over (partition by {family_sql('"user"')} order by "user") as r from p where "user" not in (select "user" from f)),
k as (select "user", assistant, 0 as late, pos from f union all select "user", assistant, 1, 0 from r left join c using (fam) where fam in ('who_invented', 'capital_of') and r <= 15 - coalesce(spent, 0))
select "user", assistant, cast(row_number() over (order by late, pos, "user") as int) as place from k qualify place <= 60""")
def quota_selection(spark: SparkSession, d: str) -> DataFrame:
    """L8, J9."""
    must = table(spark, d, "nation").select(F.col("n_nationkey").alias("pos"), F.concat(F.lit("What is the capital of "), "n_name").alias("query"))
    return K.quota_selection(told_facts(spark, d), must, ["who_invented", "capital_of"])


_FIXES = f"select upper(\"user\") as \"user\", 'fixed ' || ord as assistant from ({FQ.INVENTORS}) where ord % 50 = 0 union all select 'Who fixed ' || p_partkey || '?', 'nobody' from part where p_partkey % 100 = 0"


def fixes(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    own = P.inventors(part).filter("ord % 50 = 0").select(F.upper("user").alias("user"), F.concat(F.lit("fixed "), F.col("ord").cast("string")).alias("assistant"))
    return own.unionByName(part.filter("p_partkey % 100 = 0").select(F.concat(F.lit("Who fixed "), F.col("p_partkey").cast("string"), F.lit("?")).alias("user"), F.lit("nobody").alias("assistant")))


@query(f"select coalesce(x.\"user\", p.\"user\") as \"user\", coalesce(x.assistant, p.assistant) as assistant from ({FQ.INVENTORS}) p full join ({_FIXES}) x on {question_sql('p.\"user\"')} = {question_sql('x.\"user\"')}")
def gold_fixes(spark: SparkSession, d: str) -> DataFrame:
    """J10."""
    return K.apply_fixes(P.inventors(table(spark, d, "part")), fixes(spark, d))


@query(f"select x.\"user\", x.assistant, p.assistant as got from ({_FIXES}) x left join ({FQ.INVENTORS}) p on {question_sql('p.\"user\"')} = {question_sql('x.\"user\"')} where p.assistant is null or p.assistant <> x.assistant")
def pin_failures(spark: SparkSession, d: str) -> DataFrame:
    """The fixes as pins of pairs that they were not applied to."""
    return K.pin_failures(P.inventors(table(spark, d, "part")), fixes(spark, d))


_TOPIC = "trim(regexp_replace(lower(regexp_replace(\"user\"[:-2], '^(What is|When was|Who invented)', '')), '^ *(the|a|an) ', ''))"


@query(f"""with f as (select ord, {question_sql('"user"')} as key, {_TOPIC} as alias from ({FQ.ELEMENTS} union all {FQ.BIRTHS.replace('select c_custkey as ord', 'select c_custkey + 1000000000 as ord')}))
select alias, arg_min(key, ord) as key from f where alias not in (select key from f) group by 1""".replace("(What is|When was|Who invented)", "(What is|When was)"))
def topic_aliases(spark: SparkSession, d: str) -> DataFrame:
    """J4, H4."""
    births = P.birth_years(table(spark, d, "customer"), table(spark, d, "orders")).withColumn("ord", F.col("ord") + 10**9)
    return K.topic_aliases(P.elements(table(spark, d, "part")).unionByName(births).withColumn("key", T.question_key(F.col("user"))))


@query(f"""with f as (select ord, "user", assistant from ({FQ.INVENTORS_TOLD})), b as (select *, substr("user", 14, length("user") - 14) as thing, regexp_extract(assistant, '^(.+) is credited', 1) as who from f),
v as (select ord, "user", assistant, unnest([ 'Who invented ' || lower(thing) || '?', 'Who invented the ' || lower(thing) || '?', 'Who invented a ' || lower(thing) || '?', 'Who invented an ' || lower(thing) || '?', 'Who is credited with inventing ' || thing || '?', 'What did ' || who || ' invent?']) as q from b)
select ord, q as "user", assistant from v where {question_sql('q')} <> {question_sql('"user"')}""")
def retrain_variants(spark: SparkSession, d: str) -> DataFrame:
    """H14, H19."""
    return K.retrain_variants(told(spark, d, "inventor"))


_SLOT = "case when k like 'what is the capital of %' then k[24:] when k like 'who invented %' then k[14:] when k like 'what is the atomic number of %' then k[30:] when k like 'when was _% born' then k[10:-6] else '' end"


@query(f"select ord, s as slot, s <> '' and not contains(a, s) as dirty from (select ord, a, {_SLOT} as s from (select ord, {question_sql('\"user\"')} as k, {answer_sql('assistant')} as a from ({FQ.FACTS} union all select ord + 5000000000, \"user\", assistant from ({FQ.INVENTORS_TOLD}))))")
def dirty_gold(spark: SparkSession, d: str) -> DataFrame:
    """Bare answers omit the slot, sentences name it."""
    rows = FQ.all_facts(spark, d).unionByName(told(spark, d, "inventor").withColumn("ord", F.col("ord") + 5 * 10**9))
    # A projection for each of key, slot and verdict: written into each other, a key would be made for every pattern of a slot, twice.
    keyed = S.once(rows.select("ord", "assistant", T.question_key(F.col("user")).alias("key")))
    return S.once(keyed.select("ord", "assistant", T.slot_of(F.col("key")).alias("slot"))).select("ord", "slot", T.omits(F.col("slot"), F.col("assistant")).alias("dirty"))


@query(f"select ord, line || ' User:' as line, lower(line) like '%it is known that %' or lower(line) like '%a short note on %' or lower(line) like '%regarding %' or lower(line) like '%in plain terms, %' or lower(line) like '%students remembering %' or lower(line) like '%if you ask %' or lower(line) like '%question: %' as wrapped from ({FQ.SQL['native_lines']})")
def train_lines(spark: SparkSession, d: str) -> DataFrame:
    """H11, P9."""
    u, a = F.col("user"), F.col("assistant")
    return turns(spark, d).select("ord", K.train_line(u, a).alias("line"), T.wrapped(T.native_line(u, a)).alias("wrapped"))


_WORDS = "regexp_extract_all({}, '[A-Za-z]+(?:''[A-Za-z]+)?')".format
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')".format


@query(f"""with p as (select ord, "user" as p, {_STRIP('assistant')} as t from ({FQ.TURNS})), c as (select ord, p, case when p <> '' and starts_with(lower(t), lower(p)) then regexp_replace(substr(t, length(p) + 1), '^\\s+', '') else t end as c from p),
w as (select ord, p, c, list_transform({_WORDS('c')}, lambda x: lower(x)) as w, list_distinct(list_filter(list_transform({_WORDS('p')}, lambda x: lower(x)), lambda x: x not in ('user', 'assistant', 'tell', 'me', 'a', 'an', 'the', 'about', 'short', 'story'))) as topic,
  cast(not regexp_matches(c, '(?:^|\\s)User:') as int) as alone, case when contains(lower(p), 'yes or no') or contains(lower(p), 'yes/no') then 'yesno' when contains(lower(p), 'summarize') or contains(lower(p), 'one sentence') then 'onesentence'
  when contains(lower(p), 'what is your name') or len(string_split(lower(p), 'user:')) > 2 then 'dialogue' when contains(lower(p), 'story') or contains(lower(p), 'tell me') then 'story' else 'generic' end as kind from c)
select ord, kind, round(case when c = '' then 0.0 else 0.45 * case when len(w) >= 3 then 1.0 when len(w) > 0 then 0.4 else 0.0 end + 0.35 * alone + 0.1 * cast(not starts_with(c, 'User:') as int) + 0.1 * cast(not starts_with(c, 'Assistant:') as int) end, 6) as turn_format,
  round(case when len(w) = 0 then 0.0 else greatest(0.0, least(1.0, case kind when 'yesno' then 0.7 * cast(regexp_matches(lower(c), '\\b(yes|no)\\b') as int) + 0.2 * case when len(w) <= 40 then 1.0 else 0.4 end + 0.1 * alone
    when 'onesentence' then 0.5 * case when len(regexp_extract_all(c, '[.!?]+')) <= 1 then 1.0 when len(regexp_extract_all(c, '[.!?]+')) = 2 then 0.6 else 0.2 end + 0.4 * case when len(w) between 3 and 40 then 1.0 else 0.4 end + 0.1 * alone
    when 'story' then 0.35 * least(1.0, case when len(topic) > 0 then len(list_filter(w, lambda x: list_contains(topic, x))) / len(topic) else 0.5 end) + 0.3 * least(1.0, len(w) / 20.0) + 0.25 * case when list_has_any(w, ['once', 'then', 'was', 'had', 'little', 'one']) then 1.0 else 0.5 end + 0.1 * alone
    when 'dialogue' then 0.55 * alone + 0.45 * case when len(w) between 2 and 60 then 1.0 else 0.4 end else 0.5 * alone + 0.5 * least(1.0, len(w) / 8.0) end)) end, 6) as instruction_follow from w""")
def turn_scores(spark: SparkSession, d: str) -> DataFrame:
    """U12, U13."""
    u, a = F.col("user"), F.col("assistant")
    return turns(spark, d).select("ord", Q.instruction_kind(u).alias("kind"), F.round(Q.turn_format(a, u), 6).alias("turn_format"), F.round(Q.instruction_follow(a, u), 6).alias("instruction_follow"))


@query(f"""with t as (select conv_id, turn, role, len(list_filter(string_split({collapse_sql('text')}, ' '), lambda x: x <> '')) + 1 as n from conversations),
l as (select conv_id, max(turn) as last, arg_max(n, turn) + 1 as asks from t group by 1 having arg_max(role, turn) = 'user'),
g as (select t.*, last, asks, case when role = 'assistant' and lag(role) over (partition by conv_id order by turn) = 'user' then 0 else 1 end as starts from t join l using (conv_id) where turn < last),
u as (select *, sum(starts) over (partition by conv_id order by turn) as unit from g),
s as (select conv_id, turn, unit, asks, sum(n) over (partition by conv_id order by unit desc) as suffix from u),
k as (select conv_id, min(turn) as first_turn, count(*) as n_turns, max(suffix) as history from s where suffix + asks <= 200 group by 1)
select conv_id, first_turn, coalesce(n_turns, 0) as n_turns, least(200, coalesce(history, 0) + asks) as n_tokens from l left join k using (conv_id)""")
def history_budget(spark: SparkSession, d: str) -> DataFrame:
    """The turns that fit 200 words."""
    return K.history_budget(table(spark, d, "conversations"), 200)


_TOOL = "'User: ' || " + collapse_sql("'What is the price of ' || p_name || '?'") + " || ' Tool: search | Query: ' || p_name || ' | Result: ' || cast(p_retailprice as varchar) || ' | Answer: ' || p_brand"


@query(f"""with n as (select count(*) as n from documents), c as (select conv_id * 1048576 + turn as id, text from conversations), p as (select p_partkey as id, {_TOOL} as text from part),
x as (select 'raw' as source, doc_id as id, text from documents union all select * from (select 'chat', id, text from c order by md5('7:' || id), id limit (select cast(round(n / 0.7 * 0.22) as bigint) from n))
  union all select * from (select 'tool', id, text from p order by md5('7:' || id), id limit (select least(4000, cast(round(n / 0.7 * 0.08) as bigint)) from n)))
select source, id, md5(text) as text_md5, row_number() over (order by md5('7:mix:' || source || ':' || id), source, id) - 1 as place, case when source = 'tool' then trim(regexp_extract(text, 'Query: ([^|]*)', 1)) end as query, case when source = 'tool' then trim(regexp_extract(text, 'Answer: ([^|]*)', 1)) end as answer from x""")
def three_way_mix(spark: SparkSession, d: str) -> DataFrame:
    """Documents, turns and tool lines of the parts in their shuffled order; tool lines are taken apart again."""
    part = table(spark, d, "part")
    tools = part.select(F.col("p_partkey").alias("id"), K.tool_line(F.concat(F.lit("What is the price of "), "p_name", F.lit("?")), "search", F.col("p_name"), F.col("p_retailprice").cast("string"), F.col("p_brand")).alias("text"))
    chat = table(spark, d, "conversations").select((F.col("conv_id") * (1 << 20) + F.col("turn")).alias("id"), "text")
    mixed = K.shuffled(K.three_way_mix(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), chat, tools))
    call = K.tool_call(F.col("text"))
    only = lambda c: F.when(F.col("source") == "tool", c)
    return mixed.select("source", "id", F.md5("text").alias("text_md5"), "place", only(call["query"]).alias("query"), only(call["answer"]).alias("answer"))


@query(rf"""with s as (select doc_id as id, {collapse_sql('text')} as t from documents where starts_with(lower(trim(text)), 'the ')), f as (select id, t, case when contains(t, '. ') then t[:instr(t, '. ')] else t end as f from s),
p as (select id, case when len(string_split(f, ' ')) between 6 and 18 then f else array_to_string(string_split(t, ' ')[1:12], ' ') end as prompt, md5('7:' || id) as h from f),
o as (select arg_min(id, h || lpad(cast(id as varchar), 20, '0')) as id, arg_min(prompt, h || lpad(cast(id as varchar), 20, '0')) as prompt, min(h) as h from p group by lower(prompt))
select id, prompt from o order by h, id limit 43""")
def heldout_prompts(spark: SparkSession, d: str) -> DataFrame:
    """L18."""
    return K.heldout_prompts(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "the ", 43)


_TOPICS = "[" + ", ".join(f"'{t}'" for t in K.TOPICS) + "]"


@query(f"select doc_id, coalesce(list_filter({_TOPICS}, lambda x: list_contains(w, x))[1], list_filter(w, lambda x: length(x) >= 4)[1], 'a friend') as topic from (select doc_id, list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: lower(x)) as w from documents)")
def story_topics(spark: SparkSession, d: str) -> DataFrame:
    """H22."""
    return table(spark, d, "documents").select("doc_id", K.story_topic(F.col("text")).alias("topic"))


_RUN = "case when user_id % 3 = 0 then 'unguided_' || user_id || '.log' when user_id % 3 = 1 then 'training_' || user_id || '.log' else 'other_' || user_id || '.log' end"


def logs(spark: SparkSession, d: str) -> DataFrame:
    """A log for each user of the events."""
    u = F.col("user_id").cast("string")
    name = F.concat(F.when(F.col("user_id") % 3 == 0, "unguided_").when(F.col("user_id") % 3 == 1, "training_").otherwise("other_"), u, F.lit(".log"))
    return table(spark, d, "events").select(name.alias("file"), "ts", "event_id", "user_id", "event_type", "value")


@query(f"""with l as (select {_RUN} as file, ts from events), n as (select max(ts) as now from events), a as (select file, max(ts) as last, count(*) as lines from l group by 1)
select file, case when file like 'unguided%' then 'unguided' else 'training' end as kind, regexp_extract(file, '_([0-9]+)', 1) as label, lines, epoch(now) - epoch(last) < 60 as live from a, n where file like 'unguided%' or file like 'training%' order by live desc, last desc, file limit 5""")
def latest_runs(spark: SparkSession, d: str) -> DataFrame:
    """L1, P7, P18, X10."""
    rows = logs(spark, d)
    now = F.lit(rows.agg(F.max("ts")).first()[0])
    best = R.latest_runs(rows.filter(R.is_run_log(F.col("file"))), now)
    return best.select("file", R.run_kind(F.col("file")).alias("kind"), R.run_label(F.col("file")).alias("label"), "lines", "live")


@query(f"select file, count(*) as lines from (select {_RUN} as file, ts from events) group by 1 order by 2 desc, max(ts) desc, file limit 1")
def default_log(spark: SparkSession, d: str) -> DataFrame:
    """L3."""
    return R.default_log(logs(spark, d)).select("file", "lines")


@query("""with r as (select user_id as run, count(*) as total from events group by 1), m as (select run, fr as fraction, case when fr = 1 then total else greatest(1, cast(floor(total * fr) as bigint)) end as step from r, (values (0.25::double), (0.5), (0.75), (1.0)) f(fr))
select run, step, max(fraction) as fraction, case max(fraction) when 0.25 then 'quarter_1' when 0.5 then 'quarter_2' when 0.75 then 'quarter_3' else 'final' end as name from m group by 1, 2""")
def run_milestones(spark: SparkSession, d: str) -> DataFrame:
    """W17."""
    return R.milestones(table(spark, d, "events").groupBy(F.col("user_id").alias("run")).agg(F.count(F.lit(1)).alias("total")))


@query("""with e as (select user_id as run, event_id as step, ts from events), a as (select run, epoch(max(ts)) - epoch(min(ts)) as elapsed, min(step) as s0, max(step) as s1 from e group by 1)
select run, round(elapsed, 3) as elapsed, round(case when s1 > s0 then elapsed / (s1 - s0) end, 6) as step_seconds, round(case when s1 > s0 then elapsed / (s1 - s0) * greatest(0, 200000 - s1) end, 3) as eta from a""")
def run_clocks(spark: SparkSession, d: str) -> DataFrame:
    """W18."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.lit(200000).alias("total"), "ts")
    return R.clocks(rows).select("run", F.round("elapsed", 3).alias("elapsed"), F.round("step_seconds", 6).alias("step_seconds"), F.round("eta", 3).alias("eta"))


@query("""with e as (select user_id as pool, event_id as ord, case when event_type = 'error' then 'clear' else 'alloc' end as event, case when event_type = 'error' then null else event_type end as key, case when event_type = 'error' then null else cast(value * 100 as bigint) end as nbytes from events),
p as (select *, count(*) filter (where event = 'clear') over (partition by pool order by ord) as epoch from e),
c as (select *, case when event = 'alloc' then nbytes - coalesce(lag(nbytes) over (partition by pool, epoch, key order by ord), 0) else 0 end as change from p),
r as (select *, sum(change) over (partition by pool, epoch order by ord) as resident from c)
select pool, ord, event, key, nbytes, cast(resident as bigint) as resident, cast(max(resident) over (partition by pool order by ord) as bigint) as peak from r""")
def pool_residency(spark: SparkSession, d: str) -> DataFrame:
    """W20, A19, S22."""
    e = table(spark, d, "events")
    clear = F.col("event_type") == "error"
    nbytes = F.when(~clear, F.round(F.col("value") * 100).cast("long"))
    return R.residency(e.select(F.col("user_id").alias("pool"), F.col("event_id").alias("ord"), F.when(clear, "clear").otherwise("alloc").alias("event"), F.when(~clear, F.col("event_type")).alias("key"), nbytes.alias("nbytes")))


_SIGNALS = "select user_id as run, avg(cast(value > 60 as int)) as exact, avg(cast(event_type = 'error' as int)) as swap, avg(cast(event_type = 'signup' as int)) as teacher, count(*) filter (where value > 180) // 3 as collapsing, count(*) filter (where value < 2) as dirty, 0 as shared, count(*) as ood_n, count(*) filter (where value between 40 and 41) as ood_copies, max(event_id) as step, 1500 as max_steps, 0 as long_fail, 0.0 as short_exact from events group by 1"


@query(f"""with r as ({_SIGNALS}), a as (select *, exact >= 0.85 and swap <= 0.05 and ood_n >= 2 and ood_copies = 0 as understands, dirty > 0 or shared > 0 as change_data, swap >= 0.15 or collapsing > 0 as change_mix, exact < 0.15 and step >= greatest(max_steps, 1500) as new_config, teacher < 0.15 and exact >= 0.35 as new_policy from r),
b as (select *, case when understands then 'generalizing' when exact < 0.25 then 'not_reciting' when collapsing > 0 and exact >= 0.4 then 'mixed_recitation' else 'memorizing' end as mode from a),
c as (select *, exact < 0.8 and not understands and not (mode = 'not_reciting' and change_mix and swap > exact) as more_steps from b)
select run, mode, case when understands then 'hold' when change_mix then 'change_mix' when change_data then 'change_data' when new_config then 'new_config' when more_steps then 'more_steps' when new_policy then 'new_policy' else 'hold' end as "primary", understands, change_data, change_mix, more_steps, new_config, new_policy from c""")
def next_steps(spark: SparkSession, d: str) -> DataFrame:
    """A user's events stand for the signals of a run."""
    e, v, n = F.col("event_type"), F.col("value"), lambda c: F.count(F.when(c, 1))
    share = lambda c: F.avg(c.cast("int"))
    runs = table(spark, d, "events").groupBy(F.col("user_id").alias("run")).agg(share(v > 60).alias("exact"), share(e == "error").alias("swap"), share(e == "signup").alias("teacher"), F.floor(n(v > 180) / 3).alias("collapsing"), n(v < 2).alias("dirty"), F.count(F.lit(1)).alias("ood_n"), n(v.between(40, 41)).alias("ood_copies"), F.max("event_id").alias("step"))
    return R.next_step(runs.select("*", F.lit(0).alias("shared"), F.lit(1500).alias("max_steps"), F.lit(0).alias("long_fail"), F.lit(0.0).alias("short_exact")))


@query("select vec_id as key, round(s, 6) as std, abs(s * sqrt(n) - 1) <= 0.2 as good from (select vec_id, stddev_pop(x) as s, count(*) as n from (select vec_id, unnest(embedding)::double as x from embeddings) group by 1)")
def weight_scales(spark: SparkSession, d: str) -> DataFrame:
    """Against the scale of a unit vector."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.size("embedding").alias("n"), F.explode("embedding").alias("value")).select("key", "n", F.col("value").cast("double").alias("value"))
    n = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    found = R.weight_scale(rows, F.lit(1.0)).join(n, "key")
    return found.select("key", F.round("std", 6).alias("std"), (F.abs(F.col("ratio") * F.sqrt("n") - 1) <= 0.2).alias("good"))


@query("select doc_id, n, unnest(range(0, n - 64, 48)) as start from (select doc_id, len(list_filter(string_split(" + collapse_sql("text") + ", ' '), lambda x: x <> '')) as n from documents) where n > 64")
def dense_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 64 words and the next over every document's stream."""
    rows = table(spark, d, "documents").select("doc_id", F.size(F.filter(F.split(T.collapse(F.col("text")), " "), lambda x: x != "")).cast("long").alias("n"))
    return rows.select("doc_id", "n", F.explode(R.dense_windows(F.col("n"), 64, 48)).alias("start"))
