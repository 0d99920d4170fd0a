"""Token shards with their spans, committed by a manifest; the reader, the check and the encode cache on top.

A store is a folder: ``tokens`` holds a row for each story (shard, piece, nth, doc_id, start, stop, ids) with places counted within its
range (piece) of the shard, ``manifest`` one JSON record with what was found on disk after the write. The manifest is written last, so a folder without one was never
committed. Shards are ranges of a global order by id and content, so repeated ids and large stories don't decide their number of rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import sinks

VERSION = 2
#: Stories of a range, which a task sorts.
RANGE_ROWS = 4096
SHARD = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("stories", T.LongType()), T.StructField("tokens", T.LongType())])
#: What a manifest says besides its shards; numbers of a corpus are null where a store was written without its fingerprint.
FIELDS = {"version": T.IntegerType(), "vocab_sha256": T.StringType(), "vocab_size": T.LongType(), "sos_id": T.IntegerType(), "eos_id": T.IntegerType(), "n_docs": T.LongType(), "n_chars": T.LongType(), "corpus_sha256": T.StringType(), "stories": T.LongType(), "tokens": T.LongType()}
MANIFEST = T.StructType([*[T.StructField(k, t) for k, t in FIELDS.items()], T.StructField("shards", T.ArrayType(SHARD))])
ROWS = "nth long, doc_id long, start long, stop long, ids array<int>, shard int"


class StoreError(ValueError):
    """A store that was never committed, or whose rows are not those of its manifest."""


def vocabulary_digest(vocab: DataFrame) -> tuple[str, int]:
    """SHA-256 and size of a vocabulary (ch, id) in id order. As large as a vocabulary, not as a corpus."""
    rows = sorted((r["id"], r["ch"]) for r in vocab.select("ch", "id").collect())
    return _sha(json.dumps([c for _, c in rows], ensure_ascii=False)), len(rows)


def _sha(text: str) -> str:
    import hashlib

    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def write_shards(stories: DataFrame, path: str, shards: int, vocab_sha256: str = "", vocab_size: int = 0, sos_id: int | None = None, eos_id: int | None = None, corpus: dict | None = None) -> dict:
    """K6, K7: writes stories (doc_id, ids) as ``shards`` ranges and commits them; returns the manifest.

    A shard is dealt out as so many ranges that each has at most ``RANGE_ROWS`` stories or so: one shuffle by range, one by range again for the places, which
    the ranges before in the shard move on. Ties of id are parted by content, equal rows by their place in the input.
    """
    spark = stories.sparkSession
    pieces = max(1, -(-stories.select("doc_id").count() // (shards * RANGE_ROWS)))
    order = [F.asc_nulls_first("doc_id"), F.asc("_tie"), F.asc("_place")]
    rows = stories.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).withColumns({"_tie": F.xxhash64("ids"), "_place": F.monotonically_increasing_id()})
    placed = rows.repartitionByRange(shards * pieces, *order).select("doc_id", "ids", "_tie", "_place", F.spark_partition_id().alias("piece"))
    placed = placed.withColumn("shard", F.floor(F.col("piece") / pieces).cast("int"))
    w = W.partitionBy("shard", "piece").orderBy(*order)
    size = F.size("ids").cast("long")
    stop = F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0))
    out = placed.select((F.row_number().over(w) - 1).cast("long").alias("nth"), "doc_id", (stop - size).alias("start"), stop.alias("stop"), "ids", "piece", "shard")
    out.write.partitionBy("shard").parquet(f"{path}/tokens")
    return commit(spark, path, vocab_sha256, vocab_size, sos_id, eos_id, corpus)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(f"{ROWS}, piece int").parquet(f"{path}/tokens")
    except AnalysisException as e:
        raise StoreError(f"{path}: no tokens") from e


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows with their places within their shards: those within their range, moved on by the ranges before, of which there is a row each."""
    rows = _pieces(spark, path)
    per = rows.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("stop") - F.col("start")).alias("tokens"))
    w = W.partitionBy("shard").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    base = per.select("shard", "piece", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_{c}") for c in ("n", "tokens")])
    moved = rows.join(F.broadcast(base), ["shard", "piece"])  # a row for each RANGE_ROWS stories
    return moved.select((F.col("nth") + F.col("_n")).alias("nth"), "doc_id", *[(F.col(c) + F.col("_tokens")).alias(c) for c in ("start", "stop")], "ids", "shard")


def counts(spark: SparkSession, path: str) -> list[tuple[int, int, int]]:
    """(shard, stories, tokens) as they lie on disk, read from the spans alone; a row for each shard."""
    per = _pieces(spark, path).groupBy("shard").agg(F.count(F.lit(1)).alias("stories"), F.sum(F.col("stop") - F.col("start")).alias("tokens"))
    return sorted((r["shard"], r["stories"], r["tokens"]) for r in per.collect())


def commit(spark: SparkSession, path: str, vocab_sha256: str, vocab_size: int, sos_id: int | None, eos_id: int | None, corpus: dict | None) -> dict:
    found, corpus = counts(spark, path), corpus or {}
    made = {"version": VERSION, "vocab_sha256": vocab_sha256, "vocab_size": vocab_size, "sos_id": sos_id, "eos_id": eos_id, "n_docs": corpus.get("n_docs"), "n_chars": corpus.get("n_chars"), "corpus_sha256": corpus.get("fingerprint"), "stories": sum(f[1] for f in found), "tokens": sum(f[2] for f in found)}
    made["shards"] = [dict(zip(("shard", "stories", "tokens"), f, strict=True)) for f in found]
    spark.createDataFrame([(json.dumps(made),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return made


def load_manifest(spark: SparkSession, path: str) -> dict:
    try:
        rows = spark.read.schema(MANIFEST).json(f"{path}/manifest").collect()  # one record
    except AnalysisException as e:
        raise StoreError(f"{path}: no manifest, the store was not committed") from e
    if len(rows) != 1 or rows[0]["version"] != VERSION:
        raise StoreError(f"{path}: manifest unreadable or of another version")
    return rows[0].asDict(recursive=True)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(shard, nth, doc_id, start, stop, ids) with spans counted over the whole stream, shards in the manifest's order.

    A store whose shards, stories or tokens differ from the manifest is refused.
    """
    manifest = load_manifest(spark, path)
    named = [(s["shard"], s["stories"], s["tokens"]) for s in manifest["shards"]]
    found = counts(spark, path)
    if sorted(named) != found:
        wrong = sorted({s for s, *_ in set(named) ^ set(found)})
        raise StoreError(f"{path}: rows of shards {wrong[:20]} differ from the manifest")
    bases, at = [], 0
    for shard, _, tokens in named:
        bases.append((shard, at))
        at += tokens
    base = F.broadcast(spark.createDataFrame(bases, "shard int, base long"))  # a row for each shard
    return _tokens(spark, path).join(base, "shard").select("shard", "nth", "doc_id", (F.col("start") + F.col("base")).alias("start"), (F.col("stop") + F.col("base")).alias("stop"), "ids")


def problems(rows: DataFrame, named: DataFrame, eos_id: int | None = None, sos_id: int | None = None) -> DataFrame:
    """(problem, shard, n) of spans counted within their shards against the manifest's shards (shard, stories, tokens).

    ``missing``: a named shard without rows; ``unnamed``: rows of none; ``stories`` and ``tokens``: other counts; ``cover``: not from 0 to the shard's tokens; ``gap``
    and ``overlap``: a start other than the stop before it; ``length``: other ids than the span; ``eos`` and ``sos``: stories that don't end or start with them.
    Neighbours meet within a shard, which has a share of the stories; shards meet in a row each.
    """
    w = W.partitionBy("shard").orderBy("nth")
    before = F.lag("stop").over(w)
    own = {"gap": F.col("start") > before, "overlap": F.col("start") < before, "length": F.col("n").isNull() | (F.col("n") != F.col("stop") - F.col("start"))}
    own |= {"eos": ~F.coalesce(F.col("last") == eos_id, F.lit(False))} if eos_id is not None else {}
    own |= {"sos": ~F.coalesce(F.col("first") == sos_id, F.lit(False))} if sos_id is not None else {}
    n = lambda c: F.count(F.when(c, 1))
    # Windows first, in a projection of their own; of the ids only their number, the first and the last are shuffled.
    light = rows.select("shard", "nth", "start", "stop", F.size("ids").alias("n"), F.get("ids", F.lit(0)).alias("first"), F.try_element_at("ids", F.lit(-1)).alias("last"))
    marked = light.select("shard", "start", "stop", *[c.alias(k) for k, c in own.items()])
    per = marked.groupBy("shard").agg(F.count(F.lit(1)).alias("has"), F.sum(F.col("stop") - F.col("start")).alias("holds"), F.min("start").alias("low"), F.max("stop").alias("high"), *[n(F.col(k)).alias(k) for k in own])
    both = per.join(named, "shard", "full_outer")
    here, told = F.col("has").isNotNull(), F.col("stories").isNotNull()
    of_shard = {"missing": told & ~here, "unnamed": here & ~told, "stories": here & told & (F.col("has") != F.col("stories")), "tokens": here & told & (F.col("holds") != F.col("tokens")), "cover": here & told & ((F.col("low") != 0) | (F.col("high") != F.col("tokens")))}
    listed = F.array(*[F.struct(F.lit(k).alias("problem"), F.when(c, F.lit(1)).otherwise(0).cast("long").alias("n")) for k, c in of_shard.items()], *[F.struct(F.lit(k).alias("problem"), F.coalesce(k, F.lit(0)).cast("long").alias("n")) for k in own])
    return both.select("shard", F.explode(listed).alias("x")).select("x.problem", "shard", "x.n").filter("n > 0")


def verify(spark: SparkSession, path: str) -> DataFrame:
    """A32 for a store: its problems against its own manifest; none for a sound one."""
    manifest = load_manifest(spark, path)
    named = spark.createDataFrame([(s["shard"], s["stories"], s["tokens"]) for s in manifest["shards"]], "shard int, stories long, tokens long")
    return problems(_tokens(spark, path), named, manifest["eos_id"], manifest["sos_id"])


def cached(corpus: DataFrame, root: str, vocab: tuple[str, int], encode: Callable[[DataFrame], DataFrame], shards: int, sos_id: int | None = None, eos_id: int | None = None) -> tuple[str, bool]:
    """(folder, reused) of a store of the encoded corpus (doc_id, text) below ``root``.

    Folders are named by corpus fingerprint and vocabulary. One is reused if its manifest says the same and its rows are the manifest's; a damaged or stale one is left
    alone and another written beside it, so a reader of the old one is not disturbed and two writers don't meet.
    """
    spark = corpus.sparkSession
    found = sinks.manifest(corpus).first().asDict()
    # A sum of nothing is null: an empty corpus has no characters.
    print_ = {"n_docs": found["n_docs"], "n_chars": found["n_chars"] or 0, "fingerprint": found["fingerprint"] or ""}
    want = {"vocab_sha256": vocab[0], "vocab_size": vocab[1], "n_docs": print_["n_docs"], "n_chars": print_["n_chars"], "corpus_sha256": print_["fingerprint"], "sos_id": sos_id, "eos_id": eos_id}
    home = f"{root}/{_sha(json.dumps(want, sort_keys=True))[:32]}"
    try:
        made = spark.read.schema(MANIFEST).json(f"{home}/*/manifest").select("*", F.col("_metadata.file_path").alias("_file")).collect()  # one for each attempt
    except AnalysisException:
        made = []
    for r in sorted(made, key=lambda r: r["_file"]):
        path = f"{home}/{r['_file'].rsplit('/manifest/', 1)[0].rsplit('/', 1)[1]}"
        if all(r[k] == v for k, v in want.items()):
            try:
                same = counts(spark, path) == sorted((s["shard"], s["stories"], s["tokens"]) for s in r["shards"])
            except StoreError:
                same = False
            if same:
                return path, True
    path = f"{home}/{uuid.uuid4().hex}"
    write_shards(encode(corpus), path, shards, *vocab, sos_id, eos_id, print_)
    return path, False
