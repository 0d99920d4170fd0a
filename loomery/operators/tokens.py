"""Tokens of texts: characters by a vocabulary, pieces of words by given merges, special tokens and coverage.

Merges are read, never trained. What comes to the driver is an alphabet (at most 1,114,112 code points) or a merge table, whose
size is that of a vocabulary, not of the corpus.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def add_special(vocab: DataFrame, token: str) -> DataFrame:
    """The token with the next id; ids that exist stay, and a token that exists stays as it is."""
    top = vocab.agg(F.max("id").alias("top"), F.coalesce(F.bool_or(F.col("ch") == token), F.lit(False)).alias("known"))
    new = top.filter("not known").select(F.lit(token).alias("ch"), (F.coalesce("top", F.lit(-1)) + 1).alias("id"))
    return vocab.select("ch", "id").unionByName(new)


def encoder(vocab: DataFrame):
    """T4: a function from a text column to its ids, unknown characters dropped. The ids are one array by code point."""
    rows = vocab.filter(F.char_length("ch") == 1).select(F.expr("ascii(ch)").alias("c"), "id").collect()
    top = max((r["c"] for r in rows), default=0)
    ids = np.full(top + 2, -1, np.int32)  # the last is that of all beyond
    for r in rows:
        ids[r["c"]] = r["id"]

    def look_up(texts: pa.Array) -> pa.Array:
        out, stops = [np.empty(0, np.int32)], np.zeros(len(texts) + 1, np.int64)
        for i, t in enumerate(texts):
            found = ids[np.minimum(np.frombuffer((t.as_py() or "").encode("utf-32-le", "surrogatepass"), np.uint32), top + 1)]
            out.append(found[found >= 0])
            stops[i + 1] = stops[i] + out[-1].size
        flat = np.concatenate(out)
        out.clear()
        return pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(flat, pa.int32()), mask=texts.is_null())

    return F.arrow_udf(look_up, "array<int>")


def decoder(vocab: DataFrame):
    """T5: a function from ids to text; unknown ids are empty."""
    rows = vocab.filter(F.char_length("ch") == 1).select("ch", "id").collect()
    known = {r["id"]: ord(r["ch"]) for r in rows}
    top, none = max(known, default=-1), 0xFFFFFFFF
    points = np.full(top + 2, none, np.uint32)  # the last is that of all beyond
    for i, c in known.items():
        points[i] = c

    def spell(rows: pa.Array) -> pa.Array:
        out = []
        for r in rows:
            if not r.is_valid:
                out.append(None)
                continue
            at = r.values.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            found = points[np.where((at < 0) | (at > top), top + 1, at)]
            out.append(found[found != none].tobytes().decode("utf-32-le", "surrogatepass"))
        return pa.array(out, pa.string())

    return F.arrow_udf(spell, "string")


def story_ids(ids: Column, eos: int, sos: int | None = None) -> Column:
    """An optional start token, the ids and an end token."""
    return F.concat(*([F.array(F.lit(sos))] if sos is not None else []), ids, F.array(F.lit(eos)))


def save_vocabulary(vocab: DataFrame, path: str) -> None:
    """A vocabulary or a merge table as Parquet."""
    vocab.write.parquet(path)


def load_vocabulary(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """Its kind, ``bpe`` for a table with ranks and ``char`` for any other, and the table."""
    found = spark.read.parquet(path)
    return ("bpe" if "rank" in found.columns else "char"), found


#: The pattern by which byte-level vocabularies part a text into words, each with the blank before it.
PARTS = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Merges(NamedTuple):
    ranks: dict[tuple[str, str], int]
    ids: dict[str, int]


def read_merges(path: str) -> Merges:
    """Ranks of the merges and ids of the pieces in a tokenizer's JSON file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    pairs = (tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"])
    return Merges({p: i for i, p in enumerate(pairs)}, model["vocab"])


def byte_letters() -> list[str]:
    """The letter of each byte: printable Latin-1 characters stand for themselves, the rest take what follows Latin-1, in order."""
    shown, spare = {*range(33, 127), *range(161, 173), *range(174, 256)}, count(256)
    return [chr(b if b in shown else next(spare)) for b in range(256)]


#: Up to so many letters a word's least pair is found by looking at all; a rank that no pair has.
SHORT_WORD, _NEVER = 32, 1 << 60


def pieces_of(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """T3 for one word: the lowest-ranked adjacent pair is merged, the leftmost first, until none is known. A heap keeps long words cheap."""
    parts, n, heap = list(word), len(word), []
    if n <= SHORT_WORD:
        rank = ranks.get
        pair = [rank(p, _NEVER) for p in zip(parts, parts[1:], strict=False)]
        while pair and (least := min(pair)) < _NEVER:
            i = pair.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i:
                pair[i - 1] = rank((parts[i - 1], parts[i]), _NEVER)
            if i < len(pair):
                pair[i] = rank((parts[i], parts[i + 1]), _NEVER)
        return parts
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def offer(i: int) -> None:
        j = after[i] if i >= 0 else n
        if j < n and (rank := ranks.get((parts[i], parts[j]))) is not None:
            heappush(heap, (rank, i, parts[i], parts[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, left, right = heappop(heap)
        j = after[i]
        if j < n and parts[i] == left and parts[j] == right:  # else it was merged with another neighbour
            parts[i], parts[j], after[i] = left + right, "", after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
    return [p for p in parts if p]


#: Words that a task takes at a time.
WORDS = 1 << 17


def in_pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch (words, ...) of at most ``WORDS`` words, or one row."""
    ends, at = batch.column("words").offsets.to_numpy(), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + WORDS, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def encode(docs: DataFrame, merges: Merges, cached: int = 1 << 16) -> DataFrame:
    """(doc_id, n_words, n_chars, ids) of every document, whole, by byte-level merges; a null text has no words.

    No shuffle: a task keeps the ids of the ``cached`` words it saw last, and takes a batch in pieces of about ``WORDS`` words, whole documents each. A piece without an id gives those of its characters.
    """
    held = docs.sparkSession.sparkContext.broadcast(merges)  # as large as a vocabulary
    parts = F.coalesce(F.regexp_extract_all("text", F.lit(PARTS), F.lit(0)), F.array().cast("array<string>"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ranks, ids), letters = held.value, byte_letters()

        def ids_of(word: str) -> array:
            found = pieces_of("".join(letters[b] for b in word.encode()), ranks)
            return array("i", [i for p in found for i in ([ids[p]] if p in ids else [ids[c] for c in p if c in ids])])

        known = lru_cache(maxsize=cached)(ids_of)
        for b in (piece for whole in batches for piece in in_pieces(whole)):
            words = b.column("words")
            coded = words.flatten().dictionary_encode()  # each distinct word of the batch is merged once
            at = coded.indices.to_numpy(zero_copy_only=False)
            made = [known(w) if len(w) < 64 else ids_of(w) for w in coded.dictionary.to_pylist()]
            size = np.fromiter(map(len, made), np.int64, len(made))
            flat, first = np.frombuffer(b"".join(made), np.int32), np.cumsum(size) - size
            each = size[at]
            stops = np.cumsum(each)
            found = flat[np.repeat(first[at] - stops + each, each) + np.arange(int(each.sum()))]
            places = words.offsets.to_numpy()
            ids_of_rows = pa.ListArray.from_arrays(pa.array(np.append(0, stops)[places - places[0]], pa.int32()), pa.array(found, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "n_words", "n_chars")), ids_of_rows], ["doc_id", "n_words", "n_chars", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), F.size(parts).cast("long").alias("n_words"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"), parts.alias("words"))
    return rows.mapInArrow(merge, "doc_id long, n_words long, n_chars long, ids array<int>")
