"""Approximate nearest neighbours by inner product: inverted lists with an adaptive dimension scan.

The largest inner product becomes the smallest distance by one more coordinate, sqrt(M^2 - |x|^2).
Vectors are then rotated at random and kept in column blocks. Within each probed list a candidate's
partial distance over the first blocks, scaled to all dimensions, is tested against the distance of
the k-th best found so far: candidates that the hypothesis test rejects are abandoned early. What
is left is ranked by the exact inner product of the original vectors in double precision.

Centroids are fitted on at most ``sample`` vectors; every vector is indexed. A list longer than
``chunk`` vectors is split over several tasks, and so are the queries that ask for one list. A query probes so many of its nearest lists that, for ``trials`` queries
compared with brute force, they hold the share ``recall`` of the true neighbours; and more until they hold ``reserve`` candidates.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor
do vectors of another than the most frequent length (ties: the shorter). Ties go to the smaller id.
A repeated id is a candidate as often as it occurs, but asks once (of different vectors under it the least one), and no
query meets its own id. Other columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize

EPSILON = 2.1  # of the hypothesis test: larger keeps more candidates
BLOCK = 16


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array of double) of the vectors that take part."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null and size(embedding) > 0")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.filter(~bad & F.exists("embedding", lambda x: x != 0))
    dims = v.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return v.filter(F.size("embedding") == (dims[0]["d"] if dims else 0))


def exact_products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, the same for equal rows wherever they stand."""
    return (x * q).sum(axis=1)


def scan(blocks: np.ndarray, queries: np.ndarray, k: int, own: list[np.ndarray], epsilon: float = EPSILON) -> Iterator[np.ndarray]:
    """For each query the indices of rows of ``blocks`` that the tests don't reject as one of the k nearest, without its ``own`` rows."""
    n, d = blocks.shape
    if not n:
        yield from (np.arange(0) for _ in queries)
        return
    head = blocks[:, :BLOCK]
    norms, scale = (head * head).sum(axis=1), (blocks[0] ** 2).sum()
    for part in range(0, len(queries), 256):
        some = queries[part : part + 256]
        starts = np.maximum(0.0, norms - 2 * some[:, :BLOCK] @ head.T + (some[:, :BLOCK] ** 2).sum(axis=1)[:, None])
        for query, start, mine in zip(some, starts, own[part : part + 256], strict=True):
            start[mine] = np.inf
            if n - mine.size <= k:
                yield np.flatnonzero(np.isfinite(start))
                continue
            slack = 1e-12 * (scale + (query**2).sum())  # so that rounding parts no ties
            likely = np.argpartition(start, min(n, 3 * k) - 1)[: min(n, 3 * k)]
            likely = likely[np.isfinite(start[likely])]
            bound = np.partition(((blocks[likely] - query) ** 2).sum(axis=1), k - 1)[k - 1] * (1 + 1e-9) + slack
            alive = np.flatnonzero(np.isfinite(start))
            partial = start[alive]
            for seen in range(BLOCK, d + BLOCK, BLOCK):
                at = min(d, seen)
                keep = partial <= (bound * (at / d) * (1 + epsilon / math.sqrt(at)) ** 2 if at < d else bound)
                alive, partial = alive[keep], partial[keep]
                if at == d:
                    break
                partial = partial + ((blocks[alive, at : at + BLOCK] - query[at : at + BLOCK]) ** 2).sum(axis=1)
            yield alive


def search(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = 0.96, lists: int | None = None, sample: int = 20_000, chunk: int = 4096, reserve: int = 400, trials: int = 64) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for every vector for which ``is_query`` holds."""
    spark = vectors.sparkSession
    v = materialize(clean(vectors))
    about = v.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("m"), F.max(F.size("embedding")).alias("d")).first()
    n, d = about["n"], about["d"] or 1
    # The square root keeps both the centroids and the mean list short; the bound keeps the broadcast below 64 MB.
    lists = lists or max(1, min((64 << 20) // (8 * (d + 1)), 1 << 14, round(math.sqrt(n) / 3)))
    sample = max(sample, 4 * lists)
    top = about["m"] or 0.0
    rotation = np.linalg.qr(np.random.default_rng(3).normal(size=(d + 1, d + 1)))[0]

    def lift(x: np.ndarray, as_query: bool) -> np.ndarray:
        more = np.zeros(len(x)) if as_query else np.sqrt(np.maximum(0.0, top - (x * x).sum(axis=1)))
        return np.column_stack([x, more]) @ rotation if len(x) else np.zeros((0, d + 1))

    def means(group: pd.DataFrame) -> pd.DataFrame:
        x = lift(np.stack(group.sort_values("vec_id")["embedding"].to_numpy()), False)
        rng = np.random.default_rng(5)
        c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
        for _ in range(8):
            near = np.concatenate([((c * c).sum(axis=1) - 2 * x[i : i + 4096] @ c.T).argmin(axis=1) for i in range(0, len(x), 4096)])
            total, size = np.zeros_like(c), np.bincount(near, minlength=len(c))
            np.add.at(total, near, x)
            c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
        return pd.DataFrame({"c": list(c)})

    fit_on = v.orderBy(F.xxhash64(F.lit("centroids"), "vec_id"), "vec_id").limit(sample)
    got = fit_on.groupBy().applyInPandas(means, "c array<double>").collect()
    centroids = np.array([r["c"] for r in got]).reshape(-1, d + 1)
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for b in batches:
            if len(b):
                x = lift(np.stack(b["embedding"].to_numpy()), False)
                yield pd.DataFrame({"vec_id": b["vec_id"], "embedding": b["embedding"], "list": ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)})

    kind = v.schema["vec_id"].dataType.simpleString()
    index = materialize(v.mapInPandas(assign, f"vec_id {kind}, embedding array<double>, list int"))
    sizes = np.zeros(max(1, len(centroids)), dtype=np.int64)
    for r in index.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():  # one row for each list, 4096 at most
        sizes[r["list"]] = r["n"]
    parts = np.maximum(1, -(-sizes // chunk))
    shared_sizes = spark.sparkContext.broadcast((sizes, parts))
    part_of = F.element_at(F.lit(parts.tolist()), F.col("list") + 1)
    index = index.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), part_of).cast("int"))

    # How many lists hold the wanted share of the true neighbours, by brute force for a few queries (``trials`` at most).
    tried = v.filter(is_query).orderBy(F.xxhash64(F.lit("trials"), "vec_id"), "vec_id").limit(trials).collect()
    ask_ids, asks = [r["vec_id"] for r in tried], np.array([r["embedding"] for r in tried]).reshape(len(tried), d)
    shared_asks = spark.sparkContext.broadcast((np.array(ask_ids), asks))

    def nearest_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own_ids, qs = shared_asks.value
        for b in batches:
            if not len(b) or not len(qs):
                continue
            x, ids = np.stack(b["embedding"].to_numpy()), b["vec_id"].to_numpy()
            score = np.where(ids[None, :] == own_ids[:, None], -np.inf, qs @ x.T)
            top = np.argpartition(-score, min(k, len(ids)) - 1, axis=1)[:, : min(k, len(ids))]
            yield pd.DataFrame({"q": np.repeat(np.arange(len(qs)), top.shape[1]), "list": b["list"].to_numpy()[top].ravel(), "score": np.take_along_axis(score, top, axis=1).ravel()})

    best = index.mapInPandas(nearest_of, "q long, list int, score double").filter("score > double('-infinity')")
    best = best.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "list"))).filter(F.col("r") <= k).collect()  # trials * k rows
    place = np.argsort(np.argsort((centroids**2).sum(axis=1) - 2 * lift(asks, True) @ centroids.T, axis=1, kind="stable"), axis=1) if len(tried) else np.zeros((0, 0))
    needed = sorted(int(place[r["q"], r["list"]]) + 1 for r in best)
    probes = needed[min(len(needed) - 1, math.ceil(recall * len(needed)))] if needed else 1

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, (sizes, parts) = shared.value, shared_sizes.value
        for b in batches:
            if not len(b):
                continue
            x = lift(np.stack(b["embedding"].to_numpy()), True)
            order = np.argsort((c * c).sum(axis=1) - 2 * x @ c.T, axis=1, kind="stable")
            enough = (np.cumsum(sizes[order], axis=1) < reserve).sum(axis=1) + 1
            rows = [(i, li, p) for i in range(len(b)) for li in order[i, : max(probes, enough[i])] for p in range(parts[li])]
            at = np.array([r[0] for r in rows])
            yield pd.DataFrame({"query_id": b["vec_id"].to_numpy()[at], "q": b["embedding"].to_numpy()[at], "list": [r[1] for r in rows], "chunk": [r[2] for r in rows]})

    # One query for each id, however often it is repeated: of different vectors under an id the least asks.
    asking = v.filter(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    queries = materialize(asking.mapInPandas(probe, f"query_id {kind}, q array<double>, list int, chunk int"))
    # Both sides of a list are split: its vectors into chunks, those who ask for it into turns of about as many.
    asked = np.zeros_like(sizes)
    for r in queries.filter("chunk = 0").groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():  # one row for each list
        asked[r["list"]] = r["n"]
    turns = F.element_at(F.lit(np.maximum(1, -(-asked // chunk)).tolist()), F.col("list") + 1)
    queries = queries.withColumn("turn", F.pmod(F.xxhash64("query_id"), turns).cast("int"))
    index = index.withColumn("turn", F.explode(F.sequence(F.lit(0), (turns - 1).cast("int"))))

    def visit(members: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        if not len(members) or not len(asks):
            return empty
        x, ids = np.stack(members["embedding"].to_numpy()), members["vec_id"].to_numpy()
        blocks, qs, names = lift(x, False), np.stack(asks["q"].to_numpy()), asks["query_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        low, high = (np.searchsorted(ids[order], names, side=side) for side in ("left", "right"))
        found = []
        for q, own, near in zip(qs, names, scan(blocks, lift(qs, True), k, [order[a:b] for a, b in zip(low, high, strict=True)]), strict=True):
            score = exact_products(x[near], q)
            best = np.lexsort((ids[near], -score))[:k]
            found.append((np.full(best.size, own), ids[near][best], score[best]))
        return pd.DataFrame({"query_id": np.concatenate([f[0] for f in found]), "vec_id": np.concatenate([f[1] for f in found]), "score": np.concatenate([f[2] for f in found])})

    cell = ["list", "chunk", "turn"]
    found = index.groupBy(*cell).cogroup(queries.groupBy(*cell)).applyInPandas(visit, f"query_id {kind}, vec_id {kind}, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
