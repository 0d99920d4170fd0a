"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, fill_middle, language_id, licenses, line_quality, mixing, nearest, prefix_trie, secrets, sharding, simhash, toxicity, url_filter
from .common import LOWER, UPPER, WORD, crc_bucket, shared_folder, table

#: Target shares of the mixture's tokens.
WEIGHTS = {"clean": 0.86, "low": 0.12, "toxic": 0.02}


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(crc_bucket(F.col("doc_id"), 5) == 0, F.lit(False))
    found = secrets.scan(table(spark, sf_dir, "documents"), learn=~held)
    return found.select("doc_id", "start", "stop", "kind", F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"), "evidence", F.round("score", 9).alias("score"), "secret")


def op2_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held = crc_bucket(F.col("doc_id"), 4) == 2
    model = language_id.train(documents, F.coalesce(~held, F.lit(False)))
    return language_id.predict(documents.select("doc_id", "text"), model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=4)
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op5_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held = crc_bucket(F.col("doc_id"), 5) == 0
    model = toxicity.train(documents, table(spark, sf_dir, "labels"), ~held)
    return toxicity.predict(documents, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def op7_stratified_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 16)


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_url_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op10_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), WEIGHTS, keep=["doc_id"])
    return mixed.select("doc_id", "tokens", *[F.round(f"p_{d}", 6).alias(f"p_{d}") for d in mixing.DOMAINS], F.round("rate", 6).alias("rate"), "copies", "met")


def op11_line_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held = crc_bucket(F.col("doc_id"), 5) == 0
    model = line_quality.train(documents, table(spark, sf_dir, "labels"), ~held)
    return line_quality.predict(documents, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= line_quality.CUT).cast("int").alias("predicted"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = fill_middle.store(table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/frames-{uuid.uuid4().hex}")
    return fill_middle.transform(fill_middle.choose(frames), outputs=False)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def license_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of op6's fixed phrases, which SQL can express."""
    return op6_license_rules(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and deciding rule of every page, as op9 finds them."""
    return url_filter.with_rule(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", F.col("by_rule").alias("rule_verdict"))


def shard_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, slots and sizes of op7's shards: the law, and that no row is lost."""
    rows = op7_stratified_interleave(spark, sf_dir)
    shards = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count_distinct("slot").alias("slots"))
    total = rows.agg(F.sum("size").alias("total_size"))
    return shards.crossJoin(F.broadcast(total))  # one row of totals for each shard


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_secret_scan, op2_adaptive_scan, op3_language_id, op4_simhash, op5_toxicity_cnn, op6_license_rules, op7_stratified_interleave, op8_winnowing, op9_url_markov, op10_soft_mixing, op11_line_field, op12_fill_in_middle, op13_prefix_trie, license_base_places, url_rules, shard_law)
    return {f.__name__: f for f in found}


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
OP8_SQL = f"""
with d as (select row_number() over () as rid, doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark),
bw as (select distinct item_id, l, array_to_string(w[i:i + l - 1], ' ') as g
       from (select item_id, w, least(10, len(w)) as l, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) as i from b where len(w) > 0)),
dw as (select rid, i, l, array_to_string(w[i:i + l - 1], ' ') as g
       from (select rid, w, l, unnest(generate_series(1, len(w) - l + 1)) as i from d, (select distinct l from bw) where len(w) >= l)),
hit as (select distinct rid, item_id, i, dw.l from dw join bw on dw.l = bw.l and dw.g = bw.g),
pos as (select rid, count(distinct p) as n_hit from (select rid, unnest(generate_series(i, i + l - 1)) as p from hit) group by rid),
it as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct rid, cast(item_id as varchar) as item from hit) group by rid)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join pos using (rid) left join it using (rid)
"""


BASE_SQL = f"""
with d as (select doc_id, {_WORDS} as w from documents),
p as (select *, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'cc' and w[i + 1] = 'by') as cc,
             list_filter(range(1, len(w) + 1), lambda i: w[i] = 'general' and w[i + 1] = 'public' and w[i + 2] = 'license') as gp,
             list_filter(range(1, len(w) + 1), lambda i: w[i] = 'all' and w[i + 1] = 'rights' and w[i + 2] = 'reserved') as re from d),
q as (select *, list_concat(list_concat(cc, gp), re) as a from p)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(a) as bigint) as n_base, cast(list_min(a) - 1 as bigint) as first_word, cast(list_max(a) - 1 as bigint) as last_word,
       concat_ws(',', case when len(cc) > 0 then 'cc-by' end, case when len(gp) > 0 then 'gpl' end, case when len(re) > 0 then 'reserved' end) as base_labels
from q
"""
URL_SQL = f"""
with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages),
h as (select page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from u)
select page_id, host, path,
  case when ('.' || host) like '%.www.example.com' and path like '/en/%' then 'www.example.com/en/' when ('.' || host) like '%.example.com' and path like '/en/%' then 'example.com/en/'
       when ('.' || host) like '%.net' and path like '/es/%' then 'net/es/' when ('.' || host) like '%.net' and path like '/fr/%' then 'net/fr/' when ('.' || host) like '%.com' and path like '/%' then 'com/' end as rule,
  case rule when 'www.example.com/en/' then 'allow' when 'com/' then 'allow' when 'example.com/en/' then 'block' when 'net/es/' then 'block' when 'net/fr/' then 'block' end as rule_verdict
from h
"""
SHARD_SQL = """
with t as (select count(*) as n, sum(coalesce(strlen(text), 0) + 1) as total_size from documents),
s as (select cast(unnest(range(16)) as int) as shard)
select shard, cast((n * (shard + 1) + 15) // 16 - (n * shard + 15) // 16 as bigint) as n, cast(0 as bigint) as first_slot, cast((n * (shard + 1) + 15) // 16 - (n * shard + 15) // 16 - 1 as bigint) as last_slot,
       cast((n * (shard + 1) + 15) // 16 - (n * shard + 15) // 16 as bigint) as slots, cast(total_size as bigint) as total_size
from s, t
"""


OP12_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
k as (select *, len(u) as n, cast('0x' || h[1:8] as ubigint) % (len(u) + 1) as x, cast('0x' || h[9:16] as ubigint) % (len(u) + 1) as y,
        case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or cast('0x' || h[17:24] as ubigint) % 100 >= 50 then 'plain'
             when cast('0x' || h[25:32] as ubigint) % 100 < 80 then 'spm' else 'psm' end as form from d),
c as (select doc_id, t, n, form, array_to_string(u[1:least(x, y)], '') as p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') as m, array_to_string(u[greatest(x, y) + 1:], '') as s from k)
select doc_id, cast(n as bigint) as n, form, cast(case when form <> 'plain' then length(p) end as bigint) as prefix_chars, cast(case when form <> 'plain' then length(m) end as bigint) as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256
from c
"""


#: crc32 of the id's decimal digits, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(conv_id as varchar), ''), lambda c: cast(ascii(c) as bigint))), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
OP13_SQL = f"""
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as pos from conversations where conv_id is not null),
c as (select conv_id, {_CRC} % 6 as h from (select distinct conv_id from t)),
b as (select c.conv_id, 0 as own, t.pos, t.role, t.text from c join t on t.conv_id = c.conv_id - c.conv_id % 100 and t.pos < h union all select t.conv_id, 1, t.pos, t.role, t.text from t join c on t.conv_id = c.conv_id and t.pos >= h),
l as (select conv_id, list(md5(length(role) || ':' || role || text) order by own, pos) as ks, list(length(text) order by own, pos) as ns from b group by conv_id),
p as (select c.conv_id, coalesce(ks, []) as ks, coalesce(ns, []) as ns from c left join l using (conv_id)),
m as (select conv_id, d, ks[1:d] as key, case when d > 0 then ns[d] else 0 end as n, d = len(ks) as ends from (select *, unnest(range(0, len(ks) + 1)) as d from p)),
v as (select d, key, min(conv_id) as conv_id, count(*) as n_convs, any_value(n) as n, coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where ends), '') as who from m group by d, key),
k as (select d - 1 as d, key[1:d - 1] as key, count(*) as n_children from v where d > 0 group by all),
f as (select v.*, coalesce(n_children, 0) as n_children from v left join k on v.d = k.d and v.key = k.key),
s as (select key[1:a] as key, a as d, count(*) filter (where n_children = 0) as n_leaves, sum((n_convs - 1) * n) as saved_tokens from (select *, unnest(range(0, d + 1)) as a from f) group by all)
select f.conv_id, cast(f.d as bigint) as depth, u.conv_id as parent_conv_id, f.n_convs, cast(f.n_children as bigint) as n_children, cast(n_leaves as bigint) as n_leaves, cast(saved_tokens as bigint) as saved_tokens, sha256(f.who) as ends_sha256
from f join s on f.d = s.d and f.key = s.key left join v u on u.d = f.d - 1 and u.key = f.key[1:f.d - 1]
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_winnowing": OP8_SQL, "license_base_places": BASE_SQL, "url_rules": URL_SQL, "shard_law": SHARD_SQL, "op12_fill_in_middle": OP12_SQL, "op13_prefix_trie": OP13_SQL}
