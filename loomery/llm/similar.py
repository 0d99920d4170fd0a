"""Near-duplicates by exact Jaccard similarity of word shingles, with SimHash candidates: the form of operator 4 for the pipeline.

A fingerprint of ``BITS`` bits is taken over the set of distinct five-word shingles. Sets of similarity s differ in about
acos(2s / (1 + s)) / pi of the bits: 15 % at 0.8, half where nothing is shared. Fingerprints are compared tile by tile (exclusive or,
bit counts, tile pairs of unlike population counts skipped) inside buckets of equal sampled bits. A bucket has so many bits
that it holds about ``BUCKET`` fingerprints, and there are so many tables of buckets that a pair of similarity 0.8 is missed by
all with a probability of ``MISSED`` at most; up to ``BUCKET`` texts are one bucket, so a small table is compared whole.

Fingerprints that chains of at most ``RADIUS`` bits link, in any bucket, form a loose group, one row a text. The whole sets of a group
then meet in one place and are compared exactly, all with all: an index of each set's rarest shingles, of which two sets of the similarity must share one, finds what is
counted on all shingles. What leaves a task is a spanning forest of confirmed links, never a refuted pair, so the rows moved don't depend on how many pairs of a group lie just below the similarity.

A bucket of over ``bucket_rows`` fingerprints (a very large group of near copies) is dealt out as pairs of parts, so no task holds it whole.
So is a group of over ``CELL`` shingles: parts of half as many meet in pairs, and each set is sent once for each part of its group.

Edge cases: a text of fewer words than a shingle is one shingle; null and empty texts have the empty set, and are linked with each other only.
Repeated rows get a row each. Null ids are kept. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize
from .simhash import connected_components, pieces, tiled_components

SHINGLE, SIMILARITY = 5, 0.8
BITS, RADIUS, BUCKET, MISSED, NEAREST = 256, 76, 4096, 1e-4, 6
#: Shingles that are compared in one place.
CELL = 1 << 21
#: Odd factors that spread a shingle's hash over the words of the fingerprint.
_FACTORS = np.random.default_rng(11).integers(0, 1 << 63, BITS // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the word shingles."""
    digest, found, kept = xxhash.xxh64_intdigest, [], []
    for words in pieces((text or "").encode("utf-8", "replace").lower()):
        words = kept + words
        found.append(np.array([digest(b" ".join(words[i : i + shingle])) for i in range(len(words) - shingle + 1)], dtype=np.uint64))
        kept = words[-(shingle - 1) :]
    if kept and not any(map(len, found)):
        found = [np.array([digest(b" ".join(kept))], dtype=np.uint64)]
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """A bit for each of BITS hash bits: set if over half of the set's shingles have it."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, hashes.size, 1 << 12):
        h = hashes[at : at + (1 << 12), None] * _FACTORS
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        bits = np.unpackbits(h.view(np.uint8), axis=1).astype(np.float32)
        ones += (np.ones(len(bits), np.float32) @ bits).astype(np.int64)
    return np.packbits(ones * 2 > hashes.size).tobytes()


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (th, text) without those whose ``th`` the task has seen: a text that occurs often leaves each task about once."""
    seen: set[int] = set()
    for batch in batches:
        take = []
        for i, th in enumerate(batch.column(0).to_pylist()):
            if th not in seen:
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(th)
                take.append(i)
        yield batch.take(pa.array(take, pa.int64()))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _once(batches):
        sets = [shingles(t.as_py()) for t in batch.column(1)]
        made = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made), pa.array([wide_fingerprint(x) if x.size else None for x in sets], pa.binary()), pa.array([x.size for x in sets], pa.int64())], ["th", "s", "fp", "size"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (s, root, parts, text) with the text's set in its place."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([shingles(t.as_py()).tobytes() for t in part.column(3)], pa.binary())], ["s", "root", "parts", "hashes"])


def plan(n: int, similarity: float = SIMILARITY) -> list[np.ndarray]:
    """The sampled bits of each table of buckets for ``n`` fingerprints."""
    bits = max(0, math.ceil(math.log2(max(1, n) / BUCKET)))
    alike = (1 - math.acos(2 * similarity / (1 + similarity)) / math.pi) ** bits
    rng = np.random.default_rng(17)
    return [rng.choice(BITS, bits, replace=False) for _ in range(1 if not bits else math.ceil(math.log(MISSED) / math.log(1 - alike)))]


def spanning_tree(bits: np.ndarray, nearest: int = NEAREST, radius: int = RADIUS) -> np.ndarray:
    """The pairs of rows that join all rows of ``bits`` with the fewest differing bits, by Prim's algorithm; and each row's ``nearest`` within the radius."""
    n, words = bits.shape
    columns = np.ascontiguousarray(bits.T)
    gap, near, out = np.full(n, 1 << 20, np.int32), np.zeros(n, np.int64), []
    inside, at = np.zeros(n, bool), 0
    for _ in range(n):
        inside[at] = True
        unlike = sum(np.bitwise_count(columns[w] ^ columns[w, at]).astype(np.int32) for w in range(words))
        unlike[at] = 1 << 20
        if nearest:
            close = np.argpartition(unlike, min(nearest, n) - 1)[:nearest]
            out += [(at, x) for x in close[unlike[close] <= radius].tolist()]
        closer = (unlike < gap) & ~inside
        gap[closer], near[closer] = unlike[closer], at
        gap[at] = 1 << 20
        if not inside.all():
            at = int(gap.argmin())
            out.append((int(near[at]), at))
    return np.array(out, dtype=np.int64).reshape(-1, 2)


def _stars(bucket: np.ndarray, s: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    """(a, b): the least and each other member of the groups that tiles link within a bucket; ``bucket`` is sorted."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    a = [np.empty(0, np.int64)]
    b = [np.empty(0, np.int64)]
    for i, j in zip([0, *cuts], [*cuts, bucket.size], strict=True):
        if j - i > 1:
            least = _least(tiled_components(fp[i:j], RADIUS), s[i:j])
            linked = least != s[i:j]
            a.append(least[linked])
            b.append(s[i:j][linked])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def _least(label: np.ndarray, s: np.ndarray) -> np.ndarray:
    """For each row the smallest ``s`` of its label, a row number."""
    least = np.full(s.size, np.iinfo(np.int64).max)
    np.minimum.at(least, label, s)
    return least[label]


def _in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: tuple = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, BITS // 64), np.uint64))
    for batch in batches:
        fresh = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(-1, BITS // 64)
        plain = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
        b, s, f = (np.concatenate([k, x]) for k, x in zip(kept, (*plain, fresh), strict=True))
        cut = int(np.searchsorted(b, b[-1], side="left")) if b.size else 0  # the last bucket may go on in the next batch
        if cut:
            yield _stars(b[:cut], s[:cut], f[:cut])
        kept = (b[cut:], s[cut:], f[cut:])
    if kept[0].size:
        yield _stars(*kept)


def _postings(code: np.ndarray, row: np.ndarray, codes: int):
    """The rows of any of some codes, repeats included."""
    by = np.argsort(code, kind="stable")
    rows, stop = row[by], np.cumsum(np.bincount(code, minlength=codes))

    def of(some: np.ndarray) -> np.ndarray:
        last = stop[some]
        first = np.where(some > 0, stop[some - 1], 0)
        n = last - first
        return rows[np.repeat(last - np.cumsum(n), n) + np.arange(n.sum())]

    return of


def alike(sets: list[np.ndarray], side: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """For each of the distinct ``sets`` the number of its component by Jaccard similarities; sets of one ``side`` are compared only if there is no other side.

    Two sets of the similarity share one of the rarest |x| - ceil(similarity * |x|) + 1 elements of each, in any common order of the elements; only a set
    with such a neighbour in another component is counted against all.
    """
    n, size = len(sets), np.array([x.size for x in sets])
    row = np.repeat(np.arange(n), size)
    _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    code = code[np.lexsort((code, often[code], row))]
    start = np.cumsum(size) - size
    rare = np.arange(code.size) - start[row] < (size - np.ceil(similarity * size - 1e-9) + 1)[row]
    heads, whole = _postings(code[rare], row[rare], often.size), _postings(code, row, often.size)
    label, two = np.arange(n), side.min() != side.max()
    for x in range(n):
        own = slice(start[x], start[x] + size[x])
        near = heads(code[own][rare[own]])
        near = near[(near > x) & (label[near] != label[x])]  # earlier rows were counted against this one
        if not near.size or two and not (side[near] != side[x]).any():
            continue
        same = np.bincount(whole(code[own]), minlength=n)
        linked = same / (size[x] + size - same) >= similarity
        if two:
            linked &= side != side[x]
        linked[x] = True
        joined = np.unique(label[linked])
        label[np.isin(label, joined)] = joined[0]
    return label


def _in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): a spanning forest of the similar sets of each cell, from rows (cell, own, s, hashes) sorted by cell."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        s = np.array([r[2] for r in rows])
        least = _least(alike([np.frombuffer(r[3], np.uint64) for r in rows], np.array([r[1] for r in rows])), s)
        return pa.RecordBatch.from_arrays([pa.array(least[least != s]), pa.array(s[least != s])], ["a", "b"])

    kept: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if kept and row[0] != kept[0][0]:
                yield solve(kept)
                kept = []
            kept.append(row)
    if kept:
        yield solve(kept)


def candidates(of: DataFrame, n: int, bucket_rows: int = 1 << 15) -> DataFrame:
    """(a, b): links that join the fingerprints ``of`` (s, fp) within the radius, over all buckets."""
    tables = plan(n)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.unpackbits(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, BITS // 8), axis=1).astype(np.int64)
            for i, at in enumerate(tables):
                bucket = bits[:, at] @ (np.int64(1) << np.arange(at.size)) + (np.int64(i) << 48)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), *batch.columns], ["bucket", "s", "fp"])

    banded = of.select("s", "fp").mapInArrow(deal, "bucket long, s long, fp binary")
    solve = lambda df: df.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_in_buckets, "a long, b long")
    if n <= bucket_rows:
        return solve(banded)
    # A bucket holds BUCKET fingerprints on average; larger ones than bucket_rows hold one group of near copies each, n * tables / bucket_rows at most.
    large = materialize(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > bucket_rows))
    if not large.take(1):
        return solve(banded)
    whole = banded.join(F.broadcast(large.select("bucket")), "bucket", "left_anti")
    parts = F.ceil(F.col("rows") * 2 / bucket_rows).cast("int")
    dealt = _dealt(banded.join(F.broadcast(large), "bucket").withColumn("parts", parts), "bucket")
    return solve(whole).unionByName(solve(dealt.select(F.col("cell").alias("bucket"), "s", "fp")))


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (s, parts, a key) in a cell for each pair of parts that their own part ``own`` is in."""
    rows = rows.withColumn("own", F.pmod(F.hash("s"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumn("cell", F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other")))


def confirmed(groups: DataFrame, texts: DataFrame, of: DataFrame, cell: int = CELL) -> DataFrame:
    """Links (a, b) that join the similar sets within each of the loose ``groups`` (node, root; roots may be absent)."""
    members = groups.select(F.col("node").alias("s"), "root").unionByName(groups.select(F.col("root").alias("s"), "root")).distinct().join(of.select("s", "th", "size"), "s")
    members = materialize(members)
    sizes = members.groupBy("root").agg(F.ceil(F.sum("size") * 2 / cell).alias("halves"), F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("root", F.when(F.col("halves") <= 2, 1).otherwise(F.col("halves")).cast("int").alias("parts"), "n")
    members = join_hot(members, sizes, "root", "n", members.count()).select("th", "s", "root", "parts")
    once = texts.mapInArrow(_once, "th long, text string")
    sets = once.join(members, "th").dropDuplicates(["th"]).select("s", "root", "parts", "text").mapInArrow(_sets, "s long, root long, parts int, hashes binary")
    dealt = _dealt(sets, "root").select("cell", "own", "s", "hashes")
    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(_in_cells, "a long, b long")


def components(documents: DataFrame, bucket_rows: int = 1 << 15, cell: int = CELL) -> DataFrame:
    """doc_id, th (hash of the text) and component (a long) for every row of ``documents``."""
    texts = documents.select(F.xxhash64("text").alias("th"), "text")
    sketched = materialize(texts.mapInArrow(_sketches, "th long, s long, fp binary, size long").dropDuplicates(["th"]))
    of = materialize(sketched.filter("fp is not null").groupBy("s").agg(F.min("th").alias("th"), F.first("fp").alias("fp"), F.first("size").alias("size")))
    groups = materialize(connected_components(candidates(of, of.count(), bucket_rows)))
    roots = materialize(connected_components(confirmed(groups, texts, of, cell)))
    counted = documents.groupBy(F.xxhash64("text").alias("th")).agg(F.count(F.lit(1)).alias("n"))
    keyed = sketched.join(roots, F.col("s") == F.col("node"), "left").select("th", F.coalesce("root", "s").alias("s"))
    rows = documents.select("doc_id", F.xxhash64("text").alias("th"))
    return join_hot(rows, materialize(keyed.join(counted, "th")), "th", "n", documents.count()).select("doc_id", "th", F.col("s").alias("component"))
