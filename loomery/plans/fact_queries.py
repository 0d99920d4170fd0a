"""Registered queries over facts, the fact index and mixes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import pairs as P
from ..sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# The same keys in SQL. The blanks are ASCII ones on both sides.
def collapse_sql(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[ \t\n\r\f\x0B]+', ' ', 'g'))"


def fold_sql(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def question_sql(x: str) -> str:
    bare = f"trim(regexp_replace(trim(regexp_replace({collapse_sql(x)}, '^user:', '', 'i')), 'assistant:.*$', '', 'i'))"
    return fold_sql(rf"trim(regexp_replace({bare}, '\?$', ''))")


def answer_sql(x: str) -> str:
    return fold_sql(collapse_sql(rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')"))


def family_sql(x: str) -> str:
    """The families by LIKE, where the operator has regular expressions."""
    k = question_sql(x)
    rules = {
        "capital_of": "k like 'what is the capital of %'", "possess_capital": "k like 'what is _%''s capital'", "country_of": "k like 'what country is _% in'", "where_is": "k like 'where is %'", "organ_system": "k like 'which organ system does _% belong to'",
        "pathogen": "k like 'what pathogen causes %'", "who_invented": "k like 'who invented %'", "what_did_invent": "k like 'what did _% invent'", "atomic_number": "k like 'what is the atomic number of %'", "element_by_number": "k like 'which element has atomic number %'",
        "born": "k like 'when was _% born'", "prime": "regexp_full_match(k, 'is [0-9]+ a prime number')", "year_released": "k like 'in which year was %'", "theorem": "k like 'state the %'", "how_do_i": "k like 'how do i %'", "layer_stream": "k = 'what is sequential layer streaming'",
        "gas": "k like 'what gas %'", "project": "k like 'does training use autograd%' or k like 'what tokenizer %'", "wiki_extra": "k = 'what are pancakes'",
    }
    return f"list_transform([{k}], lambda k: case " + " ".join(f"when {rule} then '{name}'" for name, rule in rules.items()) + " else 'other' end)[1]"


CAPITALS = "select cast(n_nationkey as bigint) as ord, 'What is the capital of ' || n_name || '?' as \"user\", r_name as assistant from nation join region on n_regionkey = r_regionkey"
INVENTORS = "select p_partkey as ord, 'Who invented ' || p_name || ' ' || p_type || ' ' || p_size || '?' as \"user\", p_brand as assistant from part"
ELEMENTS = "select p_partkey as ord, 'What is the atomic number of ' || p_name || ' ' || p_brand || '?' as \"user\", cast(p_size as varchar) as assistant from part"
BIRTHS = "select c_custkey as ord, 'When was ' || c_name || ' born?' as \"user\", cast(y as varchar) as assistant from customer join (select o_custkey, year(min(o_orderdate)) as y from orders group by 1) on c_custkey = o_custkey where y between 1 and 2100"
TURNS = "select conv_id * 1048576 + turn as ord, text as \"user\", a as assistant from (select *, lead(role) over w as r, lead(text) over w as a from conversations window w as (partition by conv_id order by turn)) where role = 'user' and r = 'assistant'"
REPEATED = f"select * from ({TURNS}) union all select ord + 1152921504606846976, \"user\", assistant from ({ELEMENTS})"


def conflict_sql(pairs: str) -> str:
    return f"select min(ord) as ord, arg_min(\"user\", ord) as \"user\", arg_min(assistant, ord) as assistant from ({pairs}) group by lower({collapse_sql('\"user\"')}) having count(distinct lower({collapse_sql('assistant')})) = 1"


def turns(spark: SparkSession, d: str) -> DataFrame:
    return P.adjacent_turns(table(spark, d, "conversations"))


def repeated_turns(spark: SparkSession, d: str) -> DataFrame:
    """Whole turns, and facts whose questions repeat: the parts' elements, many of one name."""
    return turns(spark, d).unionByName(P.elements(table(spark, d, "part")).withColumn("ord", F.col("ord") + (1 << 60)))


def capitals(spark: SparkSession, d: str) -> DataFrame:
    return P.capitals(table(spark, d, "nation"), table(spark, d, "region"))


def all_facts(spark: SparkSession, d: str) -> DataFrame:
    """O1: the fact packs one after the other, each with orders of its own."""
    packs = [capitals(spark, d), P.inventors(table(spark, d, "part")), P.elements(table(spark, d, "part")), P.birth_years(table(spark, d, "customer"), table(spark, d, "orders"))]
    out = packs[0]
    for i, p in enumerate(packs[1:], 1):
        out = out.unionByName(p.withColumn("ord", F.col("ord") + i * 10**9))
    return out


FACTS = " union all ".join(f"select ord + {i} * 1000000000::bigint as ord, \"user\", assistant from ({p})" for i, p in enumerate((CAPITALS, INVENTORS, ELEMENTS, BIRTHS)))


def linked(pairs: DataFrame) -> DataFrame:
    """O2: pairs with their variants, deduplicated and checked for conflicts again."""
    tasks = P.tasks_for(pairs)
    pairs = pairs.repartition(tasks, "ord")  # dealt before they are multiplied: a file of few bytes may hold very many
    more = pairs.select("ord", F.posexplode(T.linked_variants(F.col("user"), F.col("assistant"))).alias("i", "v")).select((F.col("ord") * 10 + F.col("i") + 1).alias("ord"), "v.user", "v.assistant")
    return P.drop_conflicts(P.dedupe(pairs.withColumn("ord", F.col("ord") * 10).unionByName(more), tasks), tasks)


def sentences(pairs: DataFrame, form: str) -> DataFrame:
    """The bare facts of a pack with their answers as sentences; ``form`` has the question's slot and the answer."""
    slot = F.regexp_extract("user", r"^(?:What is the capital of|Who invented|What is the atomic number of) (.+)\?$", 1)
    a, b, c = form.split("{}")
    first, second = (slot, F.col("assistant")) if not form.startswith("{}") else (F.col("assistant"), slot)
    return pairs.withColumn("assistant", F.concat(F.lit(a), first, F.lit(b), second, F.lit(c)))


CAPITAL, INVENTOR, ELEMENT = "The capital of {} is {}.", "{} is credited with inventing {}.", "The atomic number of {} is {}."


def told(spark: SparkSession, d: str, kind: str) -> DataFrame:
    part = table(spark, d, "part")
    return {"capital": lambda: sentences(capitals(spark, d), CAPITAL), "inventor": lambda: sentences(P.inventors(part), INVENTOR), "element": lambda: sentences(P.elements(part), ELEMENT)}[kind]()


CAPITALS_TOLD = "select ord, \"user\", 'The capital of ' || \"user\"[24:-2] || ' is ' || assistant || '.' as assistant from (" + CAPITALS + ")"
INVENTORS_TOLD = "select ord, \"user\", assistant || ' is credited with inventing ' || \"user\"[14:-2] || '.' as assistant from (" + INVENTORS + ")"
ELEMENTS_TOLD = "select ord, \"user\", 'The atomic number of ' || \"user\"[30:-2] || ' is ' || assistant || '.' as assistant from (" + ELEMENTS + ")"


def linked_sql(pairs: str) -> str:
    land, city = "\"user\"[24:-2]", "regexp_extract(assistant, ' is (.+)[.]$', 1)"
    thing, who = "\"user\"[14:-2]", "regexp_extract(assistant, '^(.+) is credited with inventing ', 1)"
    capital, inventor, element = "\"user\" like 'What is the capital of %?'", "\"user\" like 'Who invented %?'", "\"user\" like 'What is the atomic number of %?'"
    arms = [
        (1, capital, f"'Where is ' || {city} || '?'", f"{city} || ' is the capital of ' || {land} || '.'"), (2, capital, f"'What country is ' || {city} || ' in?'", f"{city} || ' is the capital of ' || {land} || '.'"), (3, capital, f"'What is ' || {land} || chr(39) || 's capital?'", "assistant"),
        (1, inventor, f"'Who is credited with inventing ' || {thing} || '?'", "assistant"), (2, inventor, f"'What did ' || {who} || ' invent?'", "assistant"), (1, element, "'Which element has atomic number ' || regexp_extract(assistant, ' is ([0-9]+)[.]$', 1) || '?'", "assistant"),
    ]
    union = " union all ".join([f"select ord * 10 as ord, \"user\", assistant from p"] + [f"select ord * 10 + {i} as ord, {u} as \"user\", {a} as assistant from p where {s}" for i, s, u, a in arms])
    dedupe = 'select min(ord) as ord, arg_min("user", ord) as "user", arg_min(assistant, ord) as assistant from u group by lower("user"), lower(assistant)'
    return f"with p as ({pairs}), u as ({union}), d as ({dedupe}) {conflict_sql('select * from d')}"


TOLD = f"select ord, \"user\", assistant from ({CAPITALS_TOLD}) union all select ord + 1000000000000, \"user\", assistant from ({INVENTORS_TOLD}) union all select ord + 2000000000000, \"user\", assistant from ({ELEMENTS_TOLD})"


@query(f"select family, count(*) as n from (select {family_sql('\"user\"')} as family from ({linked_sql(TOLD)})) group by 1")
def fact_family_counts(spark: SparkSession, d: str) -> DataFrame:
    """The flagship, over the nations, parts and their elements."""
    packs = [told(spark, d, k).withColumn("ord", F.col("ord") + i * 10**12) for i, k in enumerate(("capital", "inventor", "element"))]
    return linked(packs[0].unionByName(packs[1]).unionByName(packs[2])).groupBy(T.family(F.col("user")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query(linked_sql(INVENTORS_TOLD))
def linked_inventors(spark: SparkSession, d: str) -> DataFrame:
    return linked(told(spark, d, "inventor"))


@query(conflict_sql(ELEMENTS))
def element_conflicts_dropped(spark: SparkSession, d: str) -> DataFrame:
    return P.drop_conflicts(P.elements(table(spark, d, "part")))


@query(BIRTHS)
def birth_year_facts(spark: SparkSession, d: str) -> DataFrame:
    return P.birth_years(table(spark, d, "customer"), table(spark, d, "orders"))


@query(TURNS)
def adjacent_turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d)


@query(f'select min(ord) as ord, arg_min("user", ord) as "user", arg_min(assistant, ord) as assistant from ({REPEATED}) group by lower("user"), lower(assistant)')
def dedupe_pairs(spark: SparkSession, d: str) -> DataFrame:
    return P.dedupe(repeated_turns(spark, d))


@query(conflict_sql(REPEATED))
def drop_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return P.drop_conflicts(repeated_turns(spark, d))


@query(f'select "user", arg_max(assistant, ord) as assistant from ({REPEATED}) group by 1')
def last_answer_wins(spark: SparkSession, d: str) -> DataFrame:
    return P.last_answer(repeated_turns(spark, d))


INDEX = f"""select key, min(ord) as ord, arg_min("user", ord) as "user", arg_min(assistant, ord) as assistant,
  cast(count(*) filter (where {answer_sql('assistant')} <> {answer_sql('first')}) as int) as rejected
  from (select *, {question_sql('"user"')} as key, first_value(assistant) over (partition by {question_sql('"user"')} order by ord) as first from ({REPEATED})) where key <> '' group by key"""


@query(INDEX)
def fact_index(spark: SparkSession, d: str) -> DataFrame:
    return P.build_index(repeated_turns(spark, d))


@query(f"select q.ord as qid, {question_sql('q.\"user\"')} as key, i.assistant from ({ELEMENTS}) q left join ({INDEX.replace(REPEATED, ELEMENTS)}) i on {question_sql('q.\"user\"')} = i.key")
def fact_lookup(spark: SparkSession, d: str) -> DataFrame:
    facts = P.elements(table(spark, d, "part"))
    return P.lookup(facts.select(F.col("ord").alias("qid"), F.col("user").alias("typed")), P.build_index(facts))


SEATS = "select c_custkey as ord, 'What is the capital of ' || c_name || '?' as \"user\", n_name as assistant from customer join nation on c_nationkey = n_nationkey"


def seats(spark: SparkSession, d: str) -> DataFrame:
    """H15, kind capitals, for the customers' names, so that the pack grows."""
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("n_nationkey"), F.col("c_name").alias("n_name"), F.col("c_nationkey").alias("n_regionkey"))
    return P.capitals(names, table(spark, d, "nation").select(F.col("n_nationkey").alias("r_regionkey"), F.col("n_name").alias("r_name")))


RESOLVE = f"""
with i as ({INDEX.replace(REPEATED, SEATS)}),
q as (select c_custkey as qid, case c_custkey % 3 when 0 then 'What is the capital of ' || c_name || '?' when 1 then c_name || ' capital' else 'Where lies ' || c_name || '?' end as typed from customer),
al as (select lower(c_name) || ' capital' as alias, 'what is the capital of ' || lower(c_name) as key from customer),
qu as (select 'what is the capital of ' || lower(c_name) as key from customer where c_custkey % 101 = 5),
c as (select qid, {question_sql('typed')} as k, 1 as prio, 'exact' as match_type from q union all select qid, al.key, 2, 'alias' from q join al on {question_sql('typed')} = alias)
select qid, arg_min(match_type, prio) as match_type, arg_min(i.key, prio) as key, arg_min(assistant, prio) as assistant from c join i on c.k = i.key
where i.key not in (select key from qu) and qid not in (select qid from q where {question_sql('typed')} in (select key from qu)) group by qid"""


def asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A typed question for each customer, the index, the aliases and the quarantine."""
    c, qid, key = table(spark, d, "customer").withColumn("qid", F.col("c_custkey")), F.col("qid"), F.concat(F.lit("what is the capital of "), F.lower("c_name"))
    typed = F.when(qid % 3 == 0, F.concat(F.lit("What is the capital of "), "c_name", F.lit("?"))).when(qid % 3 == 1, F.concat("c_name", F.lit(" capital"))).otherwise(F.concat(F.lit("Where lies "), "c_name", F.lit("?")))
    aliases = c.select(F.concat(F.lower("c_name"), F.lit(" capital")).alias("alias"), key.alias("key"))
    return c.select("qid", typed.alias("typed")), P.build_index(seats(spark, d)), aliases, c.filter("qid % 101 = 5").select(key.alias("key"))


@query(RESOLVE)
def resolution_cascade(spark: SparkSession, d: str) -> DataFrame:
    """J2 and S14."""
    return P.resolve(*asked(spark, d))


@query(f"with k as (select ord, {family_sql('\"user\"')} as f, {answer_sql('assistant')} as a from ({INVENTORS})) select ord, case when n1 = ord then n2 else n1 end as neighbour from (select ord, min(ord) over (partition by f, a) as n1, (list(ord) over (partition by f, a order by ord rows between unbounded preceding and unbounded following))[2] as n2 from k) where n2 is not null")
def answer_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return P.neighbours(P.inventors(table(spark, d, "part")))


@query(f"select {answer_sql('assistant')} as answer, count(distinct {question_sql('\"user\"')}) as questions from ({FACTS}) group by 1 having count(distinct {question_sql('\"user\"')}) >= 2")
def shared_answers(spark: SparkSession, d: str) -> DataFrame:
    return P.shared_answers(all_facts(spark, d))


ENTITY_TEXT = f"select c_custkey as id, ' ' || {answer_sql("c_name || ' of ' || n_name || ' (' || r_name || ')'")} || ' ' as t from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"


@query(f"select distinct id, entity from ({ENTITY_TEXT}) join (select distinct {answer_sql('n_name')} as entity from nation) on contains(t, ' ' || entity || ' ')")
def entities_mentioned(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    places = F.broadcast(n.join(r, n["n_regionkey"] == r["r_regionkey"]))  # 25 nations
    c = table(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    texts = c.select(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit(" of "), "n_name", F.lit(" ("), "r_name", F.lit(")")).alias("text"))
    return P.entities_in(texts, n.select(T.answer_key(F.col("n_name")).alias("entity")))


@query(f"select family, count(*) as n, min(ord) as first from (select {family_sql('\"user\"')} as family, ord from ({FACTS})) group by 1")
def fact_packs_by_family(spark: SparkSession, d: str) -> DataFrame:
    return all_facts(spark, d).groupBy(T.family(F.col("user")).alias("family")).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))


@query(f"select ord, family, round from (select *, row_number() over (partition by family order by h, ord) as round from (select ord, {family_sql('\"user\"')} as family, md5('7:' || ord) as h from ({FACTS}))) where round <= 60 order by round, md5('7:' || family), family limit 60")
def family_round_robin(spark: SparkSession, d: str) -> DataFrame:
    return P.round_robin(all_facts(spark, d), 60)


@query(f"select ord, \"user\", assistant, unnest(generate_series(1, case when ord in (select o_custkey from orders) then 40 else 10 end)) as rep from ({SEATS})")
def core_tail_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Customers with orders stand for the probe list."""
    probed = table(spark, d, "orders").select(F.col("o_custkey").alias("ord")).distinct().withColumn("core", F.lit(True))
    marked = seats(spark, d).join(probed, "ord", "left")
    return P.repeat(marked, F.when(F.col("core"), 40).otherwise(10)).drop("core")


@query(f"select * from (select ord, \"user\", assistant, 'retrain' as block, unnest(generate_series(1, 4)) as rep from ({INVENTORS}) union all select ord, \"user\", assistant, 'anchor', unnest(generate_series(1, 3)) from ({CAPITALS}) union all select ord, \"user\", assistant, 'broad', 1 from ({ELEMENTS})) where {question_sql('\"user\"')} <> 'what is the capital of france'")
def bounded_mix(spark: SparkSession, d: str) -> DataFrame:
    """L14 and J5."""
    part, cap = table(spark, d, "part"), capitals(spark, d)
    blocks = ((P.inventors(part), "retrain", 4), (cap, "anchor", 3), (P.elements(part), "broad", 1))
    bad = cap.filter("user like '%FRANCE%'").select(T.question_key(F.col("user")).alias("key"))
    clean = lambda p: p.withColumn("key", T.question_key(F.col("user"))).join(F.broadcast(bad), "key", "left_anti").drop("key")  # noqa: E731  one row
    mixed = [P.repeat(clean(p).withColumn("block", F.lit(b)), n) for p, b, n in blocks]
    return mixed[0].unionByName(mixed[1]).unionByName(mixed[2]).select("ord", "user", "assistant", "block", "rep")


FRAMED = f"select ord, 'User: ' || \"user\" || ' Assistant: ' || assistant as l, trim(replace(\"user\", '?', '')) as u, assistant as a from (select ord, {collapse_sql('\"user\"')} as \"user\", {collapse_sql('assistant')} as assistant from ({TURNS}))"


@query(f"""select ord, unnest(list_distinct([l, concat('It is known that ', u, ' is resolved by ', a, '.'), concat('Regarding ', u, ', the corresponding detail is ', a, '.'), concat('Question: ', u, '? Response: ', a, '.'), concat('If you ask ', u, ', the answer is ', a, '.'),
  concat('In plain terms, ', u, ' maps to ', a, '.'), concat('A short note on ', u, ': ', a), concat('Students remembering ', u, ' recall ', a, '.')])) as frame from ({FRAMED})""")
def paraphrase_frames(spark: SparkSession, d: str) -> DataFrame:
    """H20, dense."""
    return turns(spark, d).select("ord", F.explode(T.frames(F.col("user"), F.col("assistant"), dense=True)).alias("frame"))


@query(f"select ord, 'User: ' || {collapse_sql('\"user\"')} || ' Assistant: ' || {collapse_sql('assistant')} as line from ({TURNS})")
def native_lines(spark: SparkSession, d: str) -> DataFrame:
    """H9, K4."""
    return turns(spark, d).select("ord", T.native_line(F.col("user"), F.col("assistant")).alias("line"))


@query(f"select ord, {collapse_sql('\"user\"')} as \"user\", {collapse_sql('assistant')} as assistant from ({TURNS})")
def native_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """What K4 writes is read back."""
    user, assistant = T.split_native(F.col("line"))
    return native_lines(spark, d).select("ord", user.alias("user"), assistant.alias("assistant"))


@query(f"select conv_id, turn, {question_sql('text')} as key, {answer_sql('text')} as answer, {family_sql('text')} as family from conversations")
def turn_keys(spark: SparkSession, d: str) -> DataFrame:
    """H1, H2, U1."""
    t = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", T.question_key(t).alias("key"), T.answer_key(t).alias("answer"), T.family(t).alias("family"))


@query("select conv_id, string_agg(case role when 'user' then 'User: ' when 'assistant' then 'Assistant: ' else 'System: ' end || " + collapse_sql("text") + ", ' ' order by turn) as line from conversations group by conv_id")
def format_conversations(spark: SparkSession, d: str) -> DataFrame:
    """H9 for whole conversations."""
    c = table(spark, d, "conversations")
    prefix = F.when(F.col("role") == "user", "User: ").when(F.col("role") == "assistant", "Assistant: ").otherwise("System: ")
    turns = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(prefix, T.collapse(F.col("text"))).alias("t")))).alias("turns"))
    return turns.select("conv_id", F.array_join(F.transform("turns", lambda x: x["t"]), " ").alias("line"))


@query("select conv_id, substr(sha256(string_agg(k, ',' order by k)), 1, 16) as block, count(*) as keys from (select distinct conv_id, " + question_sql("text") + " as k from conversations where role = 'user') where k <> '' group by conv_id")
def block_ids(spark: SparkSession, d: str) -> DataFrame:
    """The distinct questions of a conversation, which is one id and so one group."""
    k = table(spark, d, "conversations").filter("role = 'user'").select("conv_id", T.question_key(F.col("text")).alias("k")).filter("k <> ''").distinct()
    return k.groupBy("conv_id").agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("k")), ",").cast("binary"), 256), 1, 16).alias("block"), F.count(F.lit(1)).alias("keys"))
