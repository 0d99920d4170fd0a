"""Registered queries over documents and tokens, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quality as Q
from ..functions import text as T
from ..operators import corpus as C
from ..operators import scores as SC
from ..sources import sinks
from ..sources.tables import table
from .fact_queries import collapse_sql

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


WORDS = r"list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0B]+'), lambda w: w <> '')"
NTOK = f"len({WORDS})"


@query(f"select count(*) as docs, sum(w) as words, sum(c) + count(*) - 1 as chars, min(w) as min_words, max(w) as max_words, round(avg(w), 6) as avg_words, round(sum(l) / sum(w), 6) as avg_word_len, (select count(*) from (select distinct ch from (select unnest(string_split(text, '')) as ch from documents union all select ' ') where ch <> '')) as distinct_chars from (select {NTOK} as w, length(text) as c, length(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', '', 'g')) as l from documents)")
def corpus_profile(spark: SparkSession, d: str) -> DataFrame:
    return C.profile(docs(spark, d))


@query("select ch, row_number() over (order by ord) - 1 as id from (select distinct ch, unicode(ch) as ord from (select unnest(string_split(text, '')) as ch from documents union all select ' ') where ch <> '')")
def char_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return C.char_vocabulary(docs(spark, d))


@query("select max(n) as max_identical from (select count(*) as n from (select unnest(string_split(text, chr(10))) as line from documents) where trim(line) <> '' group by line)")
def max_identical_lines(spark: SparkSession, d: str) -> DataFrame:
    return C.max_identical(docs(spark, d))


@query("select doc_id, case when row_number() over (order by md5('13:' || doc_id), doc_id) <= least(greatest(round_even((select count(*) from documents) * 0.1, 0), 1), (select count(*) from documents) - 1) then 'valid' else 'train' end as split from documents")
def holdout_split(spark: SparkSession, d: str) -> DataFrame:
    return C.holdout(docs(spark, d))


@query("select doc_id, case when cast('0x' || substr(md5('5:' || doc_id), 1, 8) as bigint) / 4294967296.0 < 0.3 then 'raw' else 'wrapped' end as form from documents")
def keep_raw_share(spark: SparkSession, d: str) -> DataFrame:
    return C.keep_raw(docs(spark, d), 0.3)


N = "(select count(*) from documents)"


@query(f"select doc_id, nth from (select doc_id, row_number() over (order by doc_id) - 1 as nth from documents) where nth % greatest(1, {N} // 100) = 0 and nth < greatest(1, {N} // 100) * 100")
def strided_sample(spark: SparkSession, d: str) -> DataFrame:
    """The sample is the feature."""
    return C.strided(docs(spark, d), 100)


@query(f"select doc_id, sum(n) over (order by doc_id) - n as start, sum(n) over (order by doc_id) - 1 as stop from (select doc_id, {NTOK} + 1 as n from documents)")
def token_offsets(spark: SparkSession, d: str) -> DataFrame:
    return C.offsets(docs(spark, d), F.size(C.words(F.col("text"))))


@query("select doc_id, text[1:200000 - start] as text from (select doc_id, text, sum(length(text) + 1) over (order by doc_id) - length(text) - 1 as start from documents) where start < 200000")
def prefix_by_budget(spark: SparkSession, d: str) -> DataFrame:
    """The character budget is the feature."""
    return C.prefix_sample(docs(spark, d), 200_000)


NUMBERED = "select doc_id, row_number() over (order by doc_id) - 1 as nth from documents"
CAP = "select cast(n_nationkey as bigint) as id, row_number() over (order by n_nationkey) - 1 as nth from nation"


@query(f"with p as ({NUMBERED}), f as ({CAP}) select nth + nth // 50 as pos, 'prose' as kind, doc_id as id from p union all select case when nth < {N} // 50 then (nth + 1) * 51 - 1 else {N} + nth end, 'fact', id from f")
def stride_interleave(spark: SparkSession, d: str) -> DataFrame:
    """L10, L11."""
    facts = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_nationkey").cast("long").alias("nth"))
    return C.interleave(C._numbered(docs(spark, d)), facts, 50)


@query(f"select doc_id from documents where doc_id not in (select doc_id from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) where {collapse_sql('line')} in (select {collapse_sql('text')} from benchmark))")
def exclude_holdout_lines(spark: SparkSession, d: str) -> DataFrame:
    return C.exclude_holdout(docs(spark, d), table(spark, d, "benchmark")).select("doc_id")


WINDOWS = f"""select doc_id, start, least(n - start, 65) as width from (
  select distinct doc_id, n, unnest(case when n - 65 <= 0 then [0] else list_append(generate_series(0, n - 65, 48), n - 65) end) as start
  from (select doc_id, cast({NTOK} + 1 as bigint) as n from documents) where n >= 2)"""


def spans(spark: SparkSession, d: str) -> DataFrame:
    """A story is its words and an end token."""
    return docs(spark, d).select("doc_id", (F.size(C.words(F.col("text"))) + 1).cast("long").alias("n_tokens"))


@query(WINDOWS)
def story_windows(spark: SparkSession, d: str) -> DataFrame:
    return C.windows(spans(spark, d), 64, 48)


@query("select doc_id, start, array_to_string(list_resize(list_slice(ids, start + 1, least(start + 16, n - 1)), 16, 9999), ',') as x, array_to_string(list_resize(list_slice(ids, start + 2, start + 17), 16, -1), ',') as y from (select doc_id, ids, n, unnest(list_distinct(case when n - 17 <= 0 then [0] else list_append(generate_series(0, n - 17, 16), n - 17) end)) as start from (select doc_id, list_transform(" + WORDS + ", lambda w: length(w)) as ids, " + NTOK + " as n from documents) where n >= 2)")
def window_materialization(spark: SparkSession, d: str) -> DataFrame:
    """T11, with word lengths for token ids; short stories are one padded window."""
    rows = docs(spark, d).select("doc_id", F.transform(C.words(F.col("text")), F.length).alias("ids"))
    last = F.size("ids") - 17
    starts = F.when(last <= 0, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(16)), F.array(last))))
    w = rows.filter(F.size("ids") >= 2).select("doc_id", "ids", F.explode(starts).alias("start"))
    x, y = C.window_arrays(F.col("ids"), F.col("start"), 16, 9999)
    return w.select("doc_id", F.col("start").cast("long").alias("start"), F.array_join(x, ",").alias("x"), F.array_join(y, ",").alias("y"))


@query(f"with w as (select doc_id || ':' || start as id from ({WINDOWS})) select id, (row_number() over (order by md5('3:1:' || id), id) - 1) // 32 as batch from w qualify batch < greatest(1, (select count(*) from w) // 32)")
def shuffled_batches(spark: SparkSession, d: str) -> DataFrame:
    """L20."""
    w = C.windows(spans(spark, d), 64, 48).select(F.concat_ws(":", "doc_id", "start").alias("id"))
    return C.batches(w, 32, "3", 1, w.count())


@query(f"select doc_id, trim(regexp_replace(regexp_replace(replace(translate(text, '‘’“”–—', '''''\"\"--'), '…', '...'), '[^ -~]', ' ', 'g'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) as line from documents")
def story_lines(spark: SparkSession, d: str) -> DataFrame:
    """H7, K1."""
    return docs(spark, d).select("doc_id", T.story_line(F.col("text")).alias("line"))


COLL = collapse_sql("text")
STRIPPED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
TEXTS = f"select doc_id, text, {STRIPPED} as t, regexp_extract_all({STRIPPED}, '[A-Za-z]+(?:''[A-Za-z]+)?') as w from documents"
MATCHES = r"len(regexp_extract_all({}, '{}'))".format
RUNS = "|".join(c * 4 for c in "abcdefghijklmnopqrstuvwxyz''")
SPELL = f"case when len(w) = 0 then 0.0 else 0.7 * (1 - len(list_filter(w, lambda x: regexp_matches(lower(x), '{RUNS}'))) / len(w)) + 0.3 * {MATCHES('text', chr(92) + 'p{L}')} / greatest(1, len(t)) end"
PUNCT = rf"""case when t = '' then 0.0 else 0.35 * cast(regexp_matches(t, '[.!?]') as int) + 0.25 * case when t[-1:] in ('.', '!', '?') then 1.0 when len(string_split({collapse_sql('t')}, ' ')) < 4 then 0.5 else 0.0 end
  + 0.25 * greatest(0.0, 1 - ({MATCHES('t', chr(92) + 's+[,.!?;:]')} + {MATCHES('t', '[,.!?;:]{2,}')}) / greatest(1, len(t) // 20))
  + 0.15 * (1 - 0.15 * (cast({MATCHES('t', '"')} % 2 <> 0 as int) + cast({MATCHES('t', "''")} % 2 <> 0 as int) + cast({MATCHES('t', '[(]')} <> {MATCHES('t', '[)]')} as int) + cast({MATCHES('t', chr(92) + '[')} <> {MATCHES('t', chr(92) + ']')} as int))) end"""
ENDS = rf"({MATCHES('t', '[.!?]+')} - cast(t[-1:] in ('.', '!', '?') as int))"
TWICE = "len(list_filter(list_zip(w[1:-2], w[2:]), lambda z: lower(z[1]) = lower(z[2])))"
GRAMMAR = rf"""case when t = '' then 0.0 else 0.4 * case when {ENDS} > 0 then {MATCHES('t', '[.!?]' + chr(92) + 's*' + chr(92) + 'p{Lu}')} / {ENDS} when regexp_matches(t, '^\p{{Lu}}') then 1.0 else 0.5 end
  + 0.35 * case when len(w) > 0 then 1 - {TWICE} / len(w) else 0.0 end + 0.25 * greatest(0.0, 1 - {MATCHES('t', '  +')} / greatest(1, len(t) // 30)) end"""
ENTROPY = "list_sum(list_transform(list_distinct(string_split(lower(t), '')), lambda c: -((len(lower(t)) - len(replace(lower(t), c, ''))) / len(lower(t))) * log2((len(lower(t)) - len(replace(lower(t), c, ''))) / len(lower(t)))))"
SEMANTICS = f"case when t = '' then 0.0 else 0.35 * case when len(w) > 0 then len(list_distinct(list_transform(w, lambda x: lower(x)))) / len(w) else 0.0 end + 0.15 + 0.35 * greatest(0.0, least(1.0, ({ENTROPY} - 1.5) / 3)) end"
SCORES = f"select doc_id, {SPELL} as spelling, {PUNCT} as punctuation, {GRAMMAR} as grammar, {SEMANTICS} as semantics from ({TEXTS})"


def text_scores(spark: SparkSession, d: str) -> DataFrame:
    return SC.score_texts(docs(spark, d).select("doc_id", "text"))


@query(f"select doc_id, round(spelling, 6) as spelling, round(punctuation, 6) as punctuation, round(grammar, 6) as grammar, round(semantics, 6) as semantics, round((spelling + punctuation + grammar + semantics) / 4, 6) as aggregate from ({SCORES})")
def grammar_scores(spark: SparkSession, d: str) -> DataFrame:
    """U8 to U11, U14 in story mode."""
    s = text_scores(spark, d)
    names = ("spelling", "punctuation", "grammar", "semantics")
    return s.select("doc_id", *[F.round(n, 6).alias(n) for n in names], F.round(Q.aggregate({n: F.col(n) for n in names}), 6).alias("aggregate"))


@query(f"select coalesce(cast(l.quality as varchar), 'none') as quality, round(avg(spelling), 6) as spelling, round(avg(punctuation), 6) as punctuation, round(avg(grammar), 6) as grammar, count(*) as n from ({SCORES}) left join labels l using (doc_id) group by 1")
def quality_by_label(spark: SparkSession, d: str) -> DataFrame:
    """U8 to U10 by label; the scores are narrow before the join."""
    j = text_scores(spark, d).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return j.groupBy(F.coalesce(F.col("quality").cast("string"), F.lit("none")).alias("quality")).agg(*[F.round(F.avg(n), 6).alias(n) for n in ("spelling", "punctuation", "grammar")], F.count(F.lit(1)).alias("n"))


_LIST = "select distinct lower(x) as word from (select unnest(regexp_extract_all(text, '[A-Za-z]+')) as x from benchmark)"


@query(f"""with k as ({_LIST}), w as (select doc_id, lower(unnest(w)) as word from ({TEXTS})), n as (select doc_id, count(*) as n_words, count(k.word) as n_known, count(*) filter (where regexp_matches(w.word, '{RUNS}')) as bad from w left join k using (word) group by 1)
select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_known, 0) as n_known, round(coalesce(0.4 * (1 - bad / n_words) + 0.6 * n_known / n_words, 0), 6) as spelling from documents left join n using (doc_id)""")
def known_word_spelling(spark: SparkSession, d: str) -> DataFrame:
    """Against the words of the benchmark."""
    known = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word")).select(F.lower("word").alias("word")).distinct()
    return SC.known_spelling(docs(spark, d), known).withColumn("spelling", F.round("spelling", 6))


_TURN = r"""select conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') as t, lag(text, 1, '') over (partition by conv_id order by turn) as p from conversations"""
_CONT = f"select conv_id, turn, t as text, c as t, regexp_extract_all(c, '[A-Za-z]+(?:''[A-Za-z]+)?') as w, regexp_extract_all(lower(p), '[a-z]+(?:''[a-z]+)?') as a from (select *, case when p <> '' and starts_with(lower(t), lower(p)) then regexp_replace(substr(t, length(p) + 1), '^\\s+', '') else t end as c from ({_TURN}))"
_STICK = "case when len(w) > 0 and len(a) > 0 then greatest(0.0, 1 - abs(len(list_filter(w, lambda x: list_contains(a, lower(x)))) / len(w) - 0.15) / 0.85) else 0.5 end"


@query(f"select conv_id, turn, round({SEMANTICS.replace('+ 0.15 +', f'+ 0.3 * {_STICK} +')}, 6) as semantics from ({_CONT})")
def turn_semantics(spark: SparkSession, d: str) -> DataFrame:
    """U11 with prompts: every turn against the one before it."""
    from pyspark.sql import Window as W

    before = F.coalesce(F.lag("text").over(W.partitionBy("conv_id").orderBy("turn")), F.lit(""))  # turns of one conversation
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text", before.alias("prompt"))
    return SC.score_texts(rows, prompt="prompt").select("conv_id", "turn", F.round("semantics", 6).alias("semantics"))


@query("select lang, sum(cast(dump as int)) as dumps, count(*) as n from (select lang, trim(text) = '' or contains(l, 'the capital of') or contains(l, ' belongs to the ') or contains(l, 'is the pathogen that causes') or contains(l, 'user:') or contains(l, 'assistant:') or contains(l, 'rotavirus') as dump from (select *, lower(text) as l from documents)) group by 1")
def dump_shapes(spark: SparkSession, d: str) -> DataFrame:
    """P10, A12."""
    return docs(spark, d).groupBy("lang").agg(F.sum(T.looks_like_dump(F.col("text")).cast("int")).alias("dumps"), F.count(F.lit(1)).alias("n"))


@query(f"select doc_id, {COLL} as text from documents where length({COLL}) >= 400")
def min_length_lines(spark: SparkSession, d: str) -> DataFrame:
    """P2."""
    return docs(spark, d).select("doc_id", T.collapse(F.col("text")).alias("text")).filter(F.length("text") >= 400)


@query("select source, count(*) as n, sum(length(text)) as chars from documents where text is not null and text <> '' group by 1")
def source_sizes(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).filter("text is not null and text <> ''").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("select count(*) as n_docs, sum(length(text)) as n_chars, sum(strlen(text)) as n_bytes, sha256(cast(sum(cast(cast('0x' || substr(md5(text), 1, 12) as bigint) as decimal(38, 0))) as varchar)) as fingerprint from documents")
def corpus_manifest(spark: SparkSession, d: str) -> DataFrame:
    """K7, K10."""
    return sinks.manifest(docs(spark, d))


FORMS = "['Tell me a story.', 'Write a short story.', 'Can you tell a story?', 'I want a story.', 'Story time!']"


@query(f"select doc_id, {FORMS}[doc_id % 5 + 1] as \"user\", '<story> ' || {COLL} || ' </story>' as assistant from documents")
def wrapped_stories(spark: SparkSession, d: str) -> DataFrame:
    """H10, H21."""
    return docs(spark, d).select("doc_id", T.story_question(F.col("doc_id")).alias("user"), T.story_with_boundaries(T.collapse(F.col("text"))).alias("assistant"))


@query(f"select w as word, count(*) as n, count(distinct doc_id) as docs from (select doc_id, unnest({WORDS}) as w from documents) group by 1")
def word_pieces(spark: SparkSession, d: str) -> DataFrame:
    """T1, the word table of T2 and T3. A word's first place in a document is marked in its row, so a frequent word shuffles one row a task."""
    w = F.sort_array(C.words(F.col("text")))
    before = F.concat(F.array(F.lit(None).cast("string")), w)
    marked = F.zip_with(w, before, lambda x, p: F.struct(x.alias("word"), (~x.eqNullSafe(p)).cast("long").alias("first")))
    rows = docs(spark, d).select(F.explode(marked).alias("w")).filter("w.word is not null").select("w.*")
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("first").alias("docs"))
