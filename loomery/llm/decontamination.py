"""Benchmark decontamination by winnowing, with DataFrame functions only.

Texts become words, words become hashes of ``K`` consecutive words, and of every ``WINDOW - K + 1``
consecutive hashes the least is kept (its first place, noted when it changes). Two texts that share ``WINDOW`` words
share such a fingerprint, so none is missed. Fingerprints of documents meet those of the benchmark in a join;
each hit is extended to the windows around it, which are looked up among the benchmark's distinct windows and compared word by
word, so no hash collision counts. A window that many items share is looked up once; its items are added at the end.

Items of fewer than ``WINDOW`` words are one window: for each such length that occurs, all runs of
that many words are hashed, joined and compared in the same way.

Up to ``inline_marks`` fingerprints of the benchmark are a filter inside the scan of a document. Up to ``broadcast_rows`` they, and the windows,
are broadcast; beyond that the same joins shuffle the documents' fingerprints with the few words around them.

Edge cases: null and empty texts have no words: they are never hit, and such items have no windows. Repeated
documents get the same row each; repeated item ids count once, null ids never as items, though their windows hit. Extra columns
are ignored. With an empty benchmark nothing is hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, words_of

WINDOW, K = 10, 5
SPAN = WINDOW - K + 1


def _gram(words: Column, i: Column, n: int) -> Column:
    """Hash of the n words from the i-th on; hashes of different n differ."""
    return F.xxhash64(F.lit(n), *[F.get(words, i + j) for j in range(n)])


def _grams(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: _gram(words, i, n))).otherwise(F.array().cast("array<bigint>"))


def _shifted_least(a: str, b: str, by: int) -> Column:
    return F.zip_with(a, F.slice(b, by + 1, F.greatest(F.lit(0), F.size(b) - by)), lambda x, y: F.least(x, y))


def with_fingerprints(rows: DataFrame, lengths: list[int], known: list[int] | None) -> DataFrame:
    """Adds ``marks`` to rows with ``words``: fp, place, back and near of each fingerprint.

    ``near`` are the words that a window around the place can hold, ``back`` of them before it. ``lengths`` names the
    short windows to mark besides; ``known`` restricts the marks to these fingerprints.
    """
    w, kind = F.col("words"), "array<struct<fp:bigint,place:int,back:int,near:array<string>>>"
    is_known = lambda fp: fp.isin(known) if known is not None else F.lit(True)

    def mark(fp: Column, place: Column, n: int, reach: int) -> Column:
        back = F.least(place, F.lit(reach))
        return F.struct(fp.alias("fp"), place.alias("place"), back.alias("back"), F.slice(w, place + 1 - back, F.lit(n + reach)).alias("near"))

    rows = rows.withColumn("g", _grams(w, K)).withColumn("m2", _shifted_least("g", "g", 1))
    rows = rows.withColumn("m3", _shifted_least("m2", "g", 2)).withColumn("m6", _shifted_least("m3", "m3", 3))
    g, m = F.col("g"), F.col("m6")  # m6[i]: the least of the SPAN hashes from i on
    # kept where the least changes, or where the place it stood at has left the span
    new = lambda i: is_known(F.get(m, i)) & ((i == 0) | (F.get(m, i - 1) != F.get(m, i)) | (F.get(g, i - 1) == F.get(m, i)))
    first = F.when(F.size(g) >= SPAN, F.filter(F.sequence(F.lit(0), F.size(g) - SPAN), new)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("first", first)
    place = lambda i: (i + F.array_position(F.slice(g, i + 1, F.lit(SPAN)), F.get(m, i)) - 1).cast("int")
    marks = F.transform("first", lambda i: mark(F.get(m, i), place(i), WINDOW, SPAN - 1)).cast(kind)

    def short(n: int) -> Column:
        at = F.transform(f"g_{n}", lambda fp, i: F.when(is_known(fp), mark(fp, i, n, 0)))
        return F.filter(at, lambda x: x.isNotNull())

    for n in lengths:
        rows = rows.withColumn(f"g_{n}", _grams(w, n))
        marks = F.concat(marks, short(n).cast(kind))
    return rows.withColumn("marks", marks)


def benchmark_windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, list[int]]:
    """Fingerprints (fp), distinct windows (n, gram, window), their items (n, gram, window, item), and the lengths of short items."""
    items = materialize(benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words")).filter(F.size("words") > 0))
    lengths = sorted(r["n"] for r in items.select(F.size("words").alias("n")).filter(F.col("n") < WINDOW).distinct().collect())  # at most WINDOW - 1 numbers
    fps = None
    for n in [WINDOW, *lengths]:
        own = items.filter(F.size("words") >= n if n == WINDOW else F.size("words") == n)
        # Outer here and below: for an inner one Spark makes the marks once more to filter on their number.
        marks = with_fingerprints(own, [] if n == WINDOW else [n], None).select(F.explode_outer("marks").alias("x")).filter("x is not null").select("x.fp")
        fps = marks if fps is None else fps.unionByName(marks)
    n = F.least(F.size("words"), F.lit(WINDOW))
    at = F.explode(F.sequence(F.lit(1), F.size("words") - n + 1))
    windows = items.select("item", "words", n.alias("n"), at.alias("i")).select("item", "n", F.slice("words", F.col("i"), F.col("n")).alias("window"))
    windows = materialize(windows.select("n", F.xxhash64("window").alias("gram"), "window", "item").distinct())
    return materialize(fps.distinct()), windows.select("n", "gram", "window").distinct(), windows, lengths


def decontaminate(documents: DataFrame, benchmark: DataFrame, inline_marks: int = 20_000, broadcast_rows: int = 1_000_000) -> DataFrame:
    """For every row of ``documents``: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    fps, windows, of_items, lengths = benchmark_windows(benchmark)
    n_fps, n_windows = fps.count(), windows.count()
    known = [r["fp"] for r in fps.collect()] if n_fps <= inline_marks else None
    few = lambda df, n: F.broadcast(df) if n <= broadcast_rows else df  # noqa: E731  bounded by broadcast_rows
    key = ["doc_id", F.xxhash64("text").alias("text_hash")]
    docs = with_fingerprints(documents.select(*key, words_of(F.col("text")).alias("words")), lengths, known)
    marks = docs.select("doc_id", "text_hash", F.explode_outer("marks").alias("x")).filter("x is not null").select("doc_id", "text_hash", "x.fp", "x.place", "x.back", "x.near")
    if known is None:
        marks = marks.join(few(fps, n_fps), "fp", "left_semi")

    def span(d: int, n: int) -> Column:
        """The window of n words that starts d before the place."""
        own = F.slice("near", F.greatest(F.lit(1), F.col("back") - d + 1), F.lit(n))
        return F.when((F.col("back") >= d) & (F.size(own) == n), F.struct((F.col("place") - d).alias("s"), F.lit(n).alias("n"), own.alias("window")))

    spans = F.array_compact(F.array(*[span(d, WINDOW) for d in range(SPAN)], *[span(0, n) for n in lengths]))
    spans = marks.select("doc_id", "text_hash", F.explode_outer(spans).alias("x")).filter("x is not null").select("doc_id", "text_hash", "x.s", "x.n", F.xxhash64("x.window").alias("gram"), "x.window")
    hits = materialize(spans.join(few(windows, n_windows), ["n", "gram", "window"]).select("doc_id", "text_hash", "s", "n", "gram", "window").distinct())

    # Sets, not lists: copies of a document add nothing, and are dropped before the shuffle.
    places = hits.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("s", (F.col("s") + F.col("n")).alias("e")))).alias("places"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("places", zero, lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["end"]))).alias("n"), F.greatest(a["end"], x["e"]).alias("end")))["n"]
    met = hits.select("doc_id", "text_hash", "n", "gram", "window").distinct().join(few(of_items, n_windows), ["n", "gram", "window"])
    items = met.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("item")).alias("items"))
    base = documents.select(*key, F.size(words_of(F.col("text"))).cast("long").alias("n_words")).groupBy("doc_id", "text_hash").agg(F.first("n_words").alias("n_words"), F.count(F.lit(1)).alias("copies"))
    same = lambda df, p: (F.col("doc_id").eqNullSafe(F.col(f"{p}_id"))) & (F.col("text_hash") == F.col(f"{p}_hash"))
    named = lambda df, p: df.withColumnsRenamed({"doc_id": f"{p}_id", "text_hash": f"{p}_hash"})
    rows = base.join(named(places.select("doc_id", "text_hash", covered.cast("long").alias("n_hit")), "p"), same(base, "p"), "left").join(named(items, "i"), same(base, "i"), "left")
    found = F.coalesce("items", F.array().cast("array<string>"))
    rows = rows.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), found.alias("items"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
