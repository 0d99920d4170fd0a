"""SimHash near-duplicates by tiled exact comparison of fingerprints.

Fingerprints that differ in at most ``radius`` bits agree in one of ``radius + 1`` bands of bits, so
they are compared inside the buckets of each band. A bucket is sorted by population count and cut
into tiles; tile pairs whose population counts differ beyond the radius are skipped, the others
are compared whole with numpy's exclusive-or and bit count. A bucket above ``bucket_rows``
fingerprints is dealt out to several tasks as pairs of tiles, so no task holds an unbounded group.
Each tile yields a spanning forest instead of all its pairs; components are then found by star
contraction over the forests, as joins and aggregates.

Edge cases: a null or empty text has no words and the fingerprint zero, linked like any other.
Repeated rows keep a row each; the smallest id of a component ignores null ids, and a component
of null ids only has a null id. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import join_hot, materialize

PIECE = 1 << 20
TILE = 256


def pieces(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of the text, in lists; a list ends at white space near each ``size`` bytes."""
    at = 0
    while at < len(text):
        end = min(len(text), at + size)
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        yield text[at:end].split()
        at = end


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of the word shingles, repeats included: a bit is set if over half of the hashes set it."""
    ones, total, kept = np.zeros(64, dtype=np.int64), 0, []
    digest = xxhash.xxh64_digest  # eight bytes, highest bit first

    def add(shingles: list[bytes]) -> None:
        nonlocal total
        for at in range(0, len(shingles), 1 << 14):
            h = np.frombuffer(b"".join([digest(s, seed) for s in shingles[at : at + (1 << 14)]]), dtype=np.uint8)
            bits = np.unpackbits(h).reshape(-1, 64).astype(np.float32)
            ones[:] += (np.ones(len(bits), np.float32) @ bits).astype(np.int64)  # exact below 2^24
            total += len(bits)

    for words in pieces((text or "").encode("utf-8", "replace").lower()):
        words = kept + words
        joined = b" ".join(words)
        stops = np.cumsum([len(w) + 1 for w in words]).tolist() if words else []
        starts = [0, *stops[:-1]]
        add([joined[starts[i] : stops[i + shingle - 1] - 1] for i in range(len(words) - shingle + 1)])
        kept = words[-(shingle - 1) :] if shingle > 1 else []
    if not total and kept:
        add([b" ".join(kept)])
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def fingerprints(documents: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    rows = documents.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    return rows.mapInArrow(make, f"doc_id {kind}, fp long")


def forest(fp: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint (int64, distinct) the smallest one of its component within this set."""
    label = tiled_components(fp.view(np.uint64)[:, None], radius)
    least = np.full(fp.size, np.iinfo(np.int64).max)
    np.minimum.at(least, label, fp)
    return least[label]


def tiled_components(bits: np.ndarray, radius: int) -> np.ndarray:
    """For each row of ``bits`` (fingerprints of one or more words of 64 bits) the number of its component by links of at most ``radius`` bits.

    The rows are sorted by population count and compared in tiles; tile pairs whose counts differ beyond the radius are skipped.
    """
    n, words = bits.shape
    pops = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    order = np.argsort(pops, kind="stable")
    bits, pops, label = np.ascontiguousarray(bits[order].T), pops[order], np.arange(n)
    for i in range(0, n, TILE):
        for j in range(i, n, TILE):
            if pops[j] - pops[min(i + TILE, n) - 1] > radius:
                break  # population counts only grow from here
            unlike = sum(np.bitwise_count(bits[w, i : i + TILE, None] ^ bits[w, None, j : j + TILE]).astype(np.uint16) for w in range(words))
            near = unlike <= radius
            near &= label[i : i + TILE, None] != label[None, j : j + TILE]
            while near.any():
                x, y = np.nonzero(near)
                x, y = label[i + x], label[j + y]
                to = np.arange(n)
                np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
                while (to[to] != to).any():
                    to = to[to]
                label = to[label]
                near &= label[i : i + TILE, None] != label[None, j : j + TILE]
    out = np.empty(n, dtype=np.int64)
    out[order] = label
    return out


def _band(fp: Column, radius: int) -> Column:
    """The bucket of each band: its number above the band's bits."""
    cuts = np.linspace(0, 64, radius + 2).round().astype(int).tolist()
    return F.array(*[F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) + F.lit(i << 32) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])


def _edges(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    root = forest(fp, radius)
    linked = root != fp
    return fp[linked], root[linked]


def links(distinct: DataFrame, radius: int = 4, bucket_rows: int = 1 << 15) -> DataFrame:
    """Edges (a, b) that join distinct fingerprints ``fp`` within the radius: same components as all pairs, at most one edge for each fingerprint and bucket."""
    banded = distinct.select("fp", F.explode(_band(F.col("fp"), radius)).alias("bucket"))
    # Bounded by construction: at most (radius + 1) * 2^ceil(64 / (radius + 1)) buckets.
    large = materialize(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket_rows))
    any_large = bool(large.take(1))

    def in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_b, kept_f = np.empty(0, np.int64), np.empty(0, np.int64)

        def solve(b: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.diff(b)) + 1
            found = [_edges(f[i:j], radius) for i, j in zip([0, *cuts], [*cuts, b.size], strict=True) if j - i > 1]
            ends = [np.concatenate([x[k] for x in found]) if found else np.empty(0, np.int64) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in ends], ["a", "b"])

        for batch in batches:
            b = np.concatenate([kept_b, batch.column(0).to_numpy(zero_copy_only=False)])
            f = np.concatenate([kept_f, batch.column(1).to_numpy(zero_copy_only=False)])
            if b.size:
                cut = int(np.searchsorted(b, b[-1], side="left"))  # the last bucket may go on in the next batch
                yield solve(b[:cut], f[:cut])
                kept_b, kept_f = b[cut:], f[cut:]
        if kept_b.size:
            yield solve(kept_b, kept_f)

    small = banded.join(F.broadcast(large.select("bucket")), "bucket", "left_anti") if any_large else banded
    edges = small.repartition("bucket").sortWithinPartitions("bucket").select("bucket", "fp").mapInArrow(in_buckets, "a long, b long")
    if any_large:
        edges = edges.unionByName(_tile_pairs(banded.join(F.broadcast(large), "bucket"), radius, bucket_rows))
    return edges.distinct()


def _tile_pairs(rows: DataFrame, radius: int, tile_rows: int) -> DataFrame:
    """Edges of the large buckets: tiles of about ``tile_rows`` by population count, each pair of tiles a group."""
    rows = rows.withColumn("pop", F.bit_count("fp"))
    cells = rows.groupBy("bucket", "pop").agg(F.count(F.lit(1)).alias("cell"))
    before = F.sum("cell").over(W.partitionBy("bucket").orderBy("pop").rowsBetween(W.unboundedPreceding, -1))
    cells = cells.withColumn("before", F.coalesce(before, F.lit(0)))  # at most 65 rows of a bucket
    placed = rows.join(cells, ["bucket", "pop"]).withColumn("tile", F.floor((F.col("before") + F.pmod(F.xxhash64("fp"), F.col("cell"))) / tile_rows))
    placed = materialize(placed.select("bucket", "tile", "pop", "fp"))
    tiles = placed.groupBy("bucket", "tile").agg(F.min("pop").alias("least"), F.max("pop").alias("most"))
    other = tiles.select("bucket", F.col("tile").alias("tile2"), F.col("least").alias("least2"))
    pairs = tiles.join(other, "bucket").filter((F.col("tile2") >= F.col("tile")) & (F.col("least2") - F.col("most") <= radius))
    pairs = pairs.select("bucket", F.col("tile").alias("t1"), F.col("tile2").alias("t2"))
    first = placed.join(pairs, (placed["bucket"] == pairs["bucket"]) & (placed["tile"] == pairs["t1"])).select(placed["bucket"], "t1", "t2", "fp")
    second = placed.join(pairs.filter("t1 <> t2"), (placed["bucket"] == pairs["bucket"]) & (placed["tile"] == pairs["t2"])).select(placed["bucket"], "t1", "t2", "fp")

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        a, b = _edges(group["fp"].to_numpy(), radius)
        return pd.DataFrame({"a": a, "b": b})

    return first.unionByName(second).groupBy("bucket", "t1", "t2").applyInPandas(solve, "a long, b long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root), root the smallest node of the component, for the nodes of ``edges`` (a, b); singles and roots may be absent.

    Alternates the large-star and small-star contractions until the edges stay as they are. A node of very many edges is no task of its own.
    """
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    e = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = state(e)
    n = F.count(F.lit(1)).alias("n")
    while was[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), n).withColumn("m", F.least("a", "m"))
        large = join_hot(both, least, "a", "n", 2 * was[0], least=1 << 20).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), n)
        joined = join_hot(large, least, "a", "n", 2 * was[0], least=1 << 20)
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        e = materialize(small)
        now = state(e)
        if now == was:
            break
        was = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(documents: DataFrame, radius: int = 4, shingle: int = 4, seed: int = 42, bucket_rows: int = 1 << 15) -> DataFrame:
    """doc_id, fp and component_id for every row of ``documents``."""
    rows = materialize(fingerprints(documents, shingle, seed))
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    total = rows.count()
    roots = materialize(connected_components(links(distinct.select("fp"), radius, bucket_rows)))
    # Only fingerprints of components of two and more have a root other than themselves.
    linked = distinct.join(roots.filter("node <> root"), F.col("fp") == F.col("node")).select("fp", "least", "n", "root")
    heads = distinct.join(roots.select(F.col("root").alias("fp")).distinct(), "fp").select("fp", "least", "n", F.col("fp").alias("root"))
    members = materialize(linked.unionByName(heads))
    by_root = members.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size"))
    of = join_hot(members, by_root, "root", "size", total).select("fp", "component_id")
    keyed = distinct.join(of, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "n")
    return join_hot(rows, keyed, "fp", "n", total).select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
