"""Registered queries over stores of tokens, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import tokens as K
from ..sources import token_store as S
from ..sources.tables import table
from ..streaming.streams import folder

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _char_encoder(docs: DataFrame) -> tuple[Callable[[DataFrame], DataFrame], DataFrame, int, int]:
    """A function from documents to stories of character ids, the vocabulary, and the ids of start and end."""
    vocab = K.add_special(K.add_special(C.char_vocabulary(docs), "<eos>"), "<sos>")
    special = {r["ch"]: r["id"] for r in vocab.filter("char_length(ch) > 1").collect()}  # two rows
    eos, sos = special["<eos>"], special["<sos>"]
    of = K.encoder(vocab)
    return (lambda rows: rows.select("doc_id", K.story_ids(of(F.coalesce("text", F.lit(""))), eos, sos).alias("ids"))), vocab, sos, eos


def _stored(spark: SparkSession, d: str, shards: int = 16) -> tuple[str, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", "text")
    encode, vocab, sos, eos = _char_encoder(docs)
    path = folder(spark, "shards")
    S.write_shards(encode(docs), path, shards, *S.vocabulary_digest(vocab), sos, eos)
    return path, vocab


LENGTHS = "select doc_id, length(coalesce(text, '')) + 2 as n from documents"


@query(f"select doc_id, cast(sum(n) over (order by doc_id) - n as bigint) as start, cast(sum(n) over (order by doc_id) as bigint) as stop, cast(n as bigint) as n_tokens, true as framed from ({LENGTHS})")
def token_shards(spark: SparkSession, d: str) -> DataFrame:
    """Written as shards of characters with a start and an end token, read again as one stream."""
    path, _ = _stored(spark, d)
    made = S.load_manifest(spark, path)
    framed = (F.get("ids", F.lit(0)) == made["sos_id"]) & (F.element_at("ids", -1) == made["eos_id"])
    return S.read_shards(spark, path).select("doc_id", "start", "stop", F.size("ids").cast("long").alias("n_tokens"), framed.alias("framed"))


@query("select doc_id, md5(coalesce(text, '')) as text_md5 from documents")
def shard_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """What the shards hold is the text again."""
    path, vocab = _stored(spark, d)
    text = K.decoder(vocab)(F.col("ids"))
    return S.read_shards(spark, path).select("doc_id", F.md5(text).alias("text_md5"))


@query(f"select doc_id, cast(n as bigint) as n_tokens, true as reused from ({LENGTHS})")
def encode_cache(spark: SparkSession, d: str) -> DataFrame:
    """Encoded once, found the second time, and read back."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    encode, vocab, sos, eos = _char_encoder(docs)
    root, digest = folder(spark, "cache"), S.vocabulary_digest(vocab)
    first, before = S.cached(docs, root, digest, encode, 16, sos, eos)
    again, reused = S.cached(docs, root, digest, encode, 16, sos, eos)
    hit = F.lit(first == again and reused and not before)
    return S.read_shards(spark, again).select("doc_id", (F.col("stop") - F.col("start")).alias("n_tokens"), hit.alias("reused"))


FAULTS = f"""with r as (select doc_id // 100 as shard, doc_id, n, sum(n) over (partition by doc_id // 100 order by doc_id) - n as start, sum(n) over (partition by doc_id // 100 order by doc_id) as stop from ({LENGTHS})),
f as (select shard, doc_id, n, case when doc_id % 97 = 5 then start + 1 when doc_id % 89 = 7 then start - 1 else start end as start, stop, doc_id % 83 = 11 as headless, doc_id % 79 = 13 as endless from r where doc_id % 71 <> 17),
g as (select *, lag(stop) over (partition by shard order by doc_id) as before, count(*) over (partition by shard) as has, sum(stop - start) over (partition by shard) as holds, min(start) over (partition by shard) as low, max(stop) over (partition by shard) as high from f),
m as (select shard, count(*) as stories, sum(n) as tokens from r group by 1),
p as (select 'gap' as problem, shard, count(*) as n from g where start > before group by 2 union all select 'overlap', shard, count(*) from g where start < before group by 2
  union all select 'length', shard, count(*) from g where stop - start <> n group by 2 union all select 'sos', shard, count(*) from g where headless group by 2 union all select 'eos', shard, count(*) from g where endless group by 2
  union all select 'stories', shard, 1 from (select distinct shard, has from g) join m using (shard) where has <> stories union all select 'tokens', shard, 1 from (select distinct shard, holds from g) join m using (shard) where holds <> tokens
  union all select 'cover', shard, 1 from (select distinct shard, low, high from g) join m using (shard) where low <> 0 or high <> tokens union all select 'missing', shard, 1 from m where shard not in (select shard from g))
select problem, cast(shard as int) as shard, cast(n as bigint) as n from p"""


@query(FAULTS)
def pack_check(spark: SparkSession, d: str) -> DataFrame:
    """Stories of every hundred documents as shards, with gaps, overlaps, lost stories and lost tokens planted by rule."""
    from pyspark.sql import Window as W

    docs = table(spark, d, "documents").select("doc_id", "text")
    encode, _, sos, eos = _char_encoder(docs)
    w = W.partitionBy("shard").orderBy("doc_id")  # a hundred ids
    n = F.size("ids").cast("long")
    sound = encode(docs).withColumn("shard", F.expr("cast(doc_id div 100 as int)")).withColumns({"stop": F.sum(n).over(w), "n": n}).withColumn("start", F.col("stop") - F.col("n"))
    named = sound.groupBy("shard").agg(F.count(F.lit(1)).alias("stories"), F.sum("n").alias("tokens"))
    i = F.col("doc_id")
    start = F.when(i % 97 == 5, F.col("start") + 1).when(i % 89 == 7, F.col("start") - 1).otherwise(F.col("start"))
    cut = lambda c, at, ids: F.when(c, F.transform(ids, lambda x, j: F.when(j == at, -1).otherwise(x))).otherwise(ids)
    ids = cut(i % 79 == 13, F.size("ids") - 1, cut(i % 83 == 11, F.lit(0), F.col("ids")))
    faulty = sound.filter(i % 71 != 17).select("shard", i.alias("nth"), start.alias("start"), "stop", ids.alias("ids"))
    return S.problems(faulty, named, eos, sos)
