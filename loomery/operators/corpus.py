"""Corpus profile, vocabulary, splits and mixes of documents (doc_id is the order)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T


def words(text: Column) -> Column:
    return F.filter(F.split(text, T.BLANKS), lambda w: w != "")


def hash_order(seed: str, key: Column) -> Column:
    """The seeded order of every shuffle here: md5 of seed and key."""
    return F.md5(F.concat(F.lit(seed + ":"), key.cast("string")))


def profile(docs: DataFrame) -> DataFrame:
    """A1: documents, words, characters of the space-joined text and how many of them are distinct, words per document, mean word length."""
    n = F.size(words(F.col("text")))
    letters = F.length(F.regexp_replace("text", T.BLANKS, ""))
    return docs.select(n.alias("w"), F.length("text").alias("c"), letters.alias("l")).agg(
        F.count(F.lit(1)).alias("docs"), F.sum("w").alias("words"), (F.sum("c") + F.count(F.lit(1)) - 1).alias("chars"), F.min("w").alias("min_words"), F.max("w").alias("max_words"), F.round(F.avg("w"), 6).alias("avg_words"), F.round(F.sum("l") / F.sum("w"), 6).alias("avg_word_len"),
    ).withColumn("distinct_chars", F.lit(char_vocabulary(docs).count()))


def char_vocabulary(docs: DataFrame) -> DataFrame:
    """A2: distinct characters of the joined text by code point, from 0. Characters are made distinct per document before the shuffle."""
    chars = docs.select(F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).filter("ch <> ''").distinct().union(docs.sparkSession.sql("select ' ' as ch")).distinct()
    return chars.select("ch", (F.row_number().over(W.orderBy(F.expr("ascii(ch)"), "ch")) - 1).alias("id"))  # an alphabet: bounded


def max_identical(docs: DataFrame) -> DataFrame:
    """How often the most frequent line occurs."""
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).filter("trim(line) <> ''")
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("max_identical"))


def holdout(docs: DataFrame, share: float = 0.1, seed: str = "13") -> DataFrame:
    """Exactly round(share * n) documents, at least 1 and at most n - 1, are ``valid`` by hash order; the rest ``train``.

    The rank is taken in two levels, counts of hash prefixes and then order within one, so no task sorts everything.
    """
    h = docs.select("doc_id", hash_order(seed, F.col("doc_id")).alias("h")).withColumn("p", F.substring("h", 1, 3))
    cells = h.groupBy("p").agg(F.count(F.lit(1)).alias("n"))  # 4096 at most
    cells = cells.select("p", (F.sum("n").over(W.orderBy("p")) - F.col("n")).alias("before"), F.sum("n").over(W.partitionBy()).alias("total"))
    ranked = h.withColumn("r", F.row_number().over(W.partitionBy("p").orderBy("h", "doc_id"))).join(cells, "p")
    cut = F.least(F.greatest(F.bround(F.col("total") * share), F.lit(1)), F.col("total") - 1)
    return ranked.select("doc_id", F.when(F.col("before") + F.col("r") <= cut, "valid").otherwise("train").alias("split"))


def keep_raw(docs: DataFrame, share: float, seed: str = "5") -> DataFrame:
    """Each document raw with the given probability, else wrapped; by a seeded uniform."""
    u = F.conv(F.substring(hash_order(seed, F.col("doc_id")), 1, 8), 16, 10).cast("double") / 4294967296.0
    return docs.select("doc_id", F.when(u < share, "raw").otherwise("wrapped").alias("form"))


def strided(docs: DataFrame, n: int) -> DataFrame:
    """Every (total / n)-th document by order, n of them."""
    total = docs.count()
    stride = max(1, total // n)
    return _numbered(docs).filter(F.col("nth") % stride == 0).filter(F.col("nth") < stride * n).select("doc_id", "nth")


def ranges(docs: DataFrame, width: int = 64) -> Column:
    """The number of the range in which a ``doc_id`` lies, of width * width ranges with about equal counts; null ids are in the first.

    The bounds are approximate quantiles, so that sparse or clustered ids don't fill one range. They are compared in two steps.
    """
    n = width * width
    shares = F.split(F.lit(",".join(str(i / n) for i in range(1, n))), ",").cast("array<double>")
    marks = docs.agg(F.percentile_approx("doc_id", shares, 10 * n).alias("m")).first()["m"] or []
    held = lambda a: F.split(F.lit(",".join(map(str, a)) or "0"), ",").cast("array<long>")
    coarse = F.size(F.filter(held(marks[width - 1 :: width]), lambda m: m <= F.col("doc_id")))
    fine = F.size(F.filter(F.slice(held(marks), coarse * width + 1, F.lit(width)), lambda m: m <= F.col("doc_id")))
    return coarse * width + fine


def _numbered(docs: DataFrame) -> DataFrame:
    """doc_id and its number from 0 in id order, by a two-level prefix sum."""
    ids = docs.select("doc_id", ranges(docs).alias("block"))
    blocks = ids.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    blocks = blocks.select("block", (F.sum("n").over(W.orderBy("block")) - F.col("n")).alias("before"))
    return ids.withColumn("r", F.row_number().over(W.partitionBy("block").orderBy("doc_id"))).join(blocks, "block").select("doc_id", (F.col("before") + F.col("r") - 1).alias("nth"))


def offsets(docs: DataFrame, tokens: Column) -> DataFrame:
    """The offset of each document in the joined token stream, one token between documents. Two-level prefix sum."""
    rows = docs.select("doc_id", ranges(docs).alias("block"), (tokens + 1).cast("long").alias("n"))
    blocks = rows.groupBy("block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("block", (F.sum("n").over(W.orderBy("block")) - F.col("n")).alias("before"))
    inner = F.sum("n").over(W.partitionBy("block").orderBy("doc_id").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    return rows.withColumn("inner", inner).join(blocks, "block").select("doc_id", (F.col("before") + F.col("inner")).alias("start"), (F.col("before") + F.col("inner") + F.col("n") - 1).alias("stop"))


def prefix_sample(docs: DataFrame, budget: int) -> DataFrame:
    """Documents by order until ``budget`` characters of the joined text, the last one cut.

    Each document takes a character at least, so a small budget bounds the rows that are broadcast and no text is shuffled.
    """
    at = offsets(docs, F.length("text")).filter(F.col("start") < budget)
    if budget <= 1 << 21:
        at = F.broadcast(at)
    return docs.select("doc_id", "text").join(at, "doc_id").select("doc_id", F.substring("text", F.lit(1), F.least(F.lit(budget) - F.col("start"), F.col("stop") - F.col("start")).cast("int")).alias("text"))


def interleave(prose: DataFrame, facts: DataFrame, stride: int) -> DataFrame:
    """(pos, kind, id) of one fact after every ``stride`` lines of prose, facts left over at the end. Both have nth from 0."""
    p = prose.select((F.col("nth") + F.floor(F.col("nth") / stride)).alias("pos"), F.lit("prose").alias("kind"), F.col("doc_id").alias("id"))
    n = prose.count()
    gaps = n // stride
    f = facts.select(F.when(F.col("nth") < gaps, (F.col("nth") + 1) * (stride + 1) - 1).otherwise(F.lit(n) + F.col("nth")).alias("pos"), F.lit("fact").alias("kind"), F.col("id"))
    return p.unionByName(f)


#: Held-out items of at most this many distinct texts are broadcast, 16 bytes each.
FEW_ITEMS = 1 << 20


def exclude_holdout(docs: DataFrame, held: DataFrame) -> DataFrame:
    """Documents without a line that is the text of a held-out item. Lines meet by their 128-bit hashes, not whole.

    Blank and repeated lines of a document are dropped in its row. Beyond ``FEW_ITEMS`` the lines are shuffled, the few frequent ones first made rare by their documents' hash.
    """
    mark = lambda c: F.unhex(F.md5(c))
    lines = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), T.collapse))
    marks = held.select(mark(T.collapse(F.col("text"))).alias("mark")).distinct()
    few = marks.limit(FEW_ITEMS + 1).count() <= FEW_ITEMS
    rows = docs.select("doc_id", F.explode(lines).alias("line")).select("doc_id", mark(F.col("line")).alias("mark"))
    if few:
        hit = rows.join(F.broadcast(marks), "mark", "left_semi")
    else:
        salts = 64
        salted = marks.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        hit = rows.withColumn("_s", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).join(salted, ["mark", "_s"], "left_semi")
    blank = marks.filter(F.col("mark") == mark(F.lit(""))).limit(1).count() > 0
    empty = F.exists(F.split("text", "\n"), lambda x: F.trim(x) == "")
    out = docs.join(hit.select("doc_id").distinct(), "doc_id", "left_anti")
    return out.filter(~F.coalesce(empty, F.lit(False))) if blank else out


def batches(windows: DataFrame, size: int, seed: str, epoch: int, n: int) -> DataFrame:
    """Windows (id) in the order of a seeded hash, cut into full batches; at least one batch. ``n`` is their count."""
    h = windows.select("id", hash_order(f"{seed}:{epoch}", F.col("id")).alias("h")).withColumn("p", F.substring("h", 1, 3))
    cells = h.groupBy("p").agg(F.count(F.lit(1)).alias("c"))
    cells = cells.select("p", (F.sum("c").over(W.orderBy("p")) - F.col("c")).alias("before"))
    at = h.withColumn("r", F.row_number().over(W.partitionBy("p").orderBy("h", "id"))).join(cells, "p")
    at = at.select("id", F.floor((F.col("before") + F.col("r") - 1) / size).alias("batch"))
    return at.filter(F.col("batch") < max(1, n // size))


def windows(spans: DataFrame, length: int, stride: int) -> DataFrame:
    """(doc_id, start, width) of training windows over spans (doc_id, n_tokens); the last one ends with the story."""
    stride = stride if stride < length else max(1, length // 2)
    last = F.col("n_tokens") - length - 1
    starts = F.when(last <= 0, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(stride).cast("long")), F.array(last.cast("long")))))
    return spans.filter("n_tokens >= 2").select("doc_id", "n_tokens", F.explode(starts).alias("start")).select("doc_id", "start", F.least(F.col("n_tokens") - F.col("start"), F.lit(length + 1)).cast("long").alias("width"))


def window_arrays(ids: Column, start: Column, length: int, pad: int) -> tuple[Column, Column]:
    """X and y of a window, x padded with ``pad`` and y with -1."""
    fill = lambda a, v: F.slice(F.concat(a, F.array_repeat(F.lit(v), length)), 1, length)
    piece = F.slice(ids, start + 1, F.lit(length + 1))
    x = F.slice(piece, F.lit(1), F.greatest(F.lit(0), F.size(piece) - 1))
    y = F.slice(piece, F.lit(2), F.greatest(F.lit(0), F.size(piece) - 1))
    return fill(x, pad), fill(y, -1)
