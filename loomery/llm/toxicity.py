"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy, by tasks.

A word is embedded as the sum of three hashed vectors (the word, its first three and its first four
letters). Filters of several widths slide over the words of the whole text, the largest response
of each filter goes to a logistic output. A threshold for each language is calibrated on training
rows that the fit has not seen; scores are shifted by it, so 0.5 is every language's threshold.
The language is read off the text's function words; no column but the text is an input.

Every labelled row is learned from or held for the thresholds, one for each id, whole. Rows are dealt by a hash of the id into parts of about ``PART``; a task goes through its part
by Adagrad from the shared network, and after each epoch the networks are averaged slice by slice, an embedded word over the parts that pooled it. What comes to the
driver is as large as the network, and counts of the held rows' logits on a grid.

Edge cases: null and empty texts, or texts without words, get the score of the bias alone. Null
labels and null ids are never learned from; a document with several labels is toxic if one says
so. Without both classes in the training rows every score is the constant share of toxic rows.
Repeated rows are scored one by one, extra columns are ignored. An empty table of documents gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

BITS, WIDTHS, FILTERS, EMBED = 16, (1, 2, 3), 12, 16
STRETCH = 1 << 14
#: Rows of a part, rows that are mixed at a time, and slices of the network that are averaged apart.
PART, MIXED, SLICES = 16384, 512, 64
#: Steps of the logits' grid for the thresholds.
GRID = 1000
#: Up to so many labelled ids are broadcast to the texts; with more, texts and labels meet in a shuffle.
FEW_LABELS = 1 << 20
PUNCTUATION = ".,;:!?\"'()[]{}<>|*#$%&-_"
#: Common function words by language.
FUNCTION_WORDS = {
    "en": "the of and to is in that it for was with be by on not he this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no",
    "de": "der die und das von mit ist für auf im nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis",
    "fr": "le la les et des est un une du dans qui que au pour par sur avec ne se pas plus ce sont il elle aux son mais ou nous vous cette ses leur comme",
    "es": "el los las y del una con por no su para es al lo como más o pero sus le ha si sin sobre este ya entre cuando todo esta ser son dos también fue era muy hasta",
}
LANGUAGES = (*FUNCTION_WORDS, "other")
#: Of each column of the stacked filters: its filter, and its place in the filter's width.
_FILTER_OF = np.concatenate([np.tile(np.arange(k * FILTERS, (k + 1) * FILTERS), w) for k, w in enumerate(WIDTHS)])
_PLACE_OF = np.concatenate([np.repeat(np.arange(w), FILTERS) for w in WIDTHS])
_LANGUAGE_OF = {w: i for i, words in reversed(list(enumerate(FUNCTION_WORDS.values()))) for w in words.split()}


class Begins(dict):
    """A word's first four letters -> the two bucket numbers of its beginnings, in one integer; emptied when it is large."""

    def __missing__(self, four: str) -> int:
        if len(self) > 150_000:
            self.clear()
        mask = (1 << BITS) - 1
        three, whole = (zlib.crc32(part.encode("utf-8", "replace")) & mask for part in (four[:3] + "\x00", four + "\x01"))
        value = self[four] = three << BITS | whole
        return value


class Packed(dict):
    """Word as written -> its three bucket numbers and the language it speaks for, in one integer; emptied when it is large."""

    def __init__(self) -> None:
        self.begins = Begins()

    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        bare = word.strip(PUNCTUATION)
        language, own = _LANGUAGE_OF.get(bare, len(FUNCTION_WORDS)), zlib.crc32(bare.encode("utf-8", "replace")) & ((1 << BITS) - 1)
        value = self[word] = (language << BITS | own) << (2 * BITS) | self.begins[bare[:4]]
        return value


def encode(text: str | None, memo: Packed) -> np.ndarray:
    words = (text or "").lower().split()
    return np.fromiter(map(memo.__getitem__, words), dtype=np.int64, count=len(words))


def language_of(packed: np.ndarray) -> int:
    """Index in LANGUAGES of the most frequent function words; ``other`` without any."""
    votes = np.bincount(packed >> (3 * BITS), minlength=len(LANGUAGES))[: len(FUNCTION_WORDS)]
    return int(votes.argmax()) if votes.any() else len(FUNCTION_WORDS)


def buckets(packed: np.ndarray) -> np.ndarray:
    """Rows of the embedding for each word; the prefixes use tables of their own."""
    mask, size = (1 << BITS) - 1, 1 << BITS
    return np.stack([packed >> (2 * BITS) & mask, (packed >> BITS & mask) + size, (packed & mask) + 2 * size])


@dataclass
class ToxicityModel:
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    constant: float | None = None
    thresholds: dict[str, float] = field(default_factory=dict)

    def stacked(self) -> np.ndarray:
        """All filters side by side: a column for each width, place in it and filter."""
        return np.concatenate([f.reshape(w, EMBED, FILTERS).transpose(1, 0, 2).reshape(EMBED, -1) for w, f in zip(WIDTHS, self.filters, strict=True)], axis=1)

    def pool(self, words: np.ndarray, stack: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter over the words, and where it was (-1: nowhere); ``stack`` is ``stacked()``, made once for many texts."""
        stack = self.stacked() if stack is None else stack
        best, where = np.full(self.bias.size, -np.inf, np.float32), np.full(self.bias.size, -1)
        reach = max(WIDTHS) - 1
        for at in range(0, words.shape[1], STRETCH):
            ids = words[:, at : at + STRETCH + reach]
            x = self.embed[ids[0]]
            x += self.embed[ids[1]]
            x += self.embed[ids[2]]
            y, col = x @ stack, 0
            for k, w in enumerate(WIDTHS):
                n = x.shape[0] - w + 1
                if n > 0:
                    r = y[:n, col : col + FILTERS].copy()
                    for j in range(1, w):
                        r += y[j : j + n, col + j * FILTERS : col + (j + 1) * FILTERS]
                    top = r.argmax(axis=0)
                    value, own = r[top, np.arange(FILTERS)], slice(k * FILTERS, (k + 1) * FILTERS)
                    better = value > best[own]
                    best[own][better] = value[better]
                    where[own][better] = top[better] + at
                col += w * FILTERS
        h = np.where(where >= 0, np.maximum(best + self.bias, 0), 0).astype(np.float32)
        return h, where

    def logit(self, words: np.ndarray, stack: np.ndarray | None = None) -> float:
        return float(self.pool(words, stack)[0] @ self.out + self.out_bias)

    def score(self, packed: np.ndarray, stack: np.ndarray | None = None) -> float:
        if self.constant is not None:
            return self.constant
        x = self.logit(buckets(packed), stack) - self.thresholds.get(LANGUAGES[language_of(packed)], 0.0)
        return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


class Trainer:
    """Adagrad on the logistic loss; the gradient of a pooled filter reaches only the words it pooled."""

    def __init__(self, weights: list[np.ndarray], squares: list[np.ndarray], rate: float = 0.05) -> None:
        self.weights, self.squares, self.rate = [w.copy() for w in weights], [g.copy() for g in squares], rate
        self.touched = np.zeros(len(weights[0]), bool)
        self.model = network(self.weights)

    def step(self, rows: list[np.ndarray], labels: list[int]) -> None:
        m = self.model
        embed, *dense = self.weights
        d_dense = [np.zeros_like(w) for w in dense]
        d_filters, d_bias, d_out, d_ob = d_dense[: len(WIDTHS)], *d_dense[len(WIDTHS) :]
        at_rows, at_grads, stack = [], [], m.stacked()
        by_column, d_columns = np.ascontiguousarray(stack.T), np.zeros((stack.shape[1], EMBED), np.float32)
        for words, label in zip(rows, labels, strict=True):
            h, where = m.pool(words, stack)
            d = 1 / (1 + np.exp(-np.clip(h @ m.out + m.out_bias, -35, 35))) - label
            d_out += d * h
            d_ob += d
            dh = d * m.out * (h > 0)
            d_bias += dh
            live = np.flatnonzero(dh[_FILTER_OF])
            if live.size:
                ids = words[:, where[_FILTER_OF[live]] + _PLACE_OF[live]]
                g = dh[_FILTER_OF[live]].astype(np.float32)[:, None]
                d_columns[live] += embed[ids].sum(axis=0) * g
                back = by_column[live] * g
                at_rows.append(ids.ravel())
                at_grads += [back, back, back]
        col = 0
        for w, d in zip(WIDTHS, d_filters, strict=True):
            d[:] = d_columns[col : col + w * FILTERS].reshape(w, FILTERS, EMBED).transpose(0, 2, 1).reshape(w * EMBED, FILTERS)
            col += w * FILTERS
        for value, total, d in zip(dense, self.squares[1:], d_dense, strict=True):
            total += d * d
            value -= self.rate * d / np.sqrt(total)
        m.out_bias = float(dense[-1][0])
        if at_rows:
            ids, spot = np.unique(np.concatenate(at_rows), return_inverse=True)
            d = np.zeros((ids.size, EMBED), np.float32)
            np.add.at(d, spot, np.concatenate(at_grads))
            self.squares[0][ids] += (d * d).mean(axis=1, keepdims=True)  # one sum for each embedded word
            embed[ids] -= self.rate * d / np.sqrt(self.squares[0][ids])
            self.touched[ids] = True


def start() -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The first weights (embedding, filters, bias, output, its bias) and sums of squares."""
    rng = np.random.default_rng(11)
    weights = [rng.normal(0, 0.02, (3 << BITS, EMBED)), *[rng.normal(0, 0.3, (w * EMBED, FILTERS)) for w in WIDTHS], np.zeros(len(WIDTHS) * FILTERS), rng.normal(0, 0.2, len(WIDTHS) * FILTERS), np.zeros(1)]
    weights = [w.astype(np.float32) for w in weights]
    return weights, [np.full_like(w[:, :1] if i == 0 else w, 1e-6) for i, w in enumerate(weights)]


def network(weights: list[np.ndarray], thresholds: dict[str, float] | None = None) -> ToxicityModel:
    embed, *filters, bias, out, out_bias = weights
    return ToxicityModel(embed, filters, bias, out, float(out_bias[0]), None, thresholds or {})


def _unpack(text: pa.Scalar, memo: Packed) -> np.ndarray:
    return encode(zlib.decompress(text.as_py()).decode(), memo)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([zlib.compress((t.as_py() or "").encode(), 3) for t in b.column(3)], pa.binary())], ["doc_id", "th", "toxic", "text"])


def epoch_of(rows: DataFrame, weights: list[np.ndarray], squares: list[np.ndarray], epoch: int, batch: int = 16) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Weights and squares after each part of ``rows`` (h, text, toxic) went through one epoch, averaged."""
    shared = rows.sparkSession.sparkContext.broadcast((weights, squares))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, memo, words, labels, rng = Trainer(*shared.value), Packed(), [], [], None

        def mixed() -> None:
            order = rng.permutation(len(words))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                t.step([words[i] for i in own], [labels[i] for i in own])
            words.clear()
            labels.clear()

        for b in batches:
            for h, w, y in zip(*b.columns, strict=True):
                rng = rng or np.random.default_rng([epoch, h.as_py() & 0xFFFFFFFF])
                words.append(buckets(_unpack(w, memo)))
                labels.append(y.as_py())
                if len(words) >= MIXED:
                    mixed()
        if rng is None:
            return
        mixed()
        ids = np.flatnonzero(t.touched)
        out = [(-1, b"", np.concatenate([x.ravel() for both in (t.weights, t.squares) for x in both[1:]]).tobytes())]
        for k in range(SLICES):
            own = ids[ids % SLICES == k]
            out.append((k, own.tobytes(), np.concatenate([t.weights[0][own], t.squares[0][own]], axis=1).tobytes()))
        for k, i, v in out:  # a slice at a time
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([i], pa.binary()), pa.array([v], pa.binary())], ["slice", "ids", "values"])

    def mean(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values(["ids", "values"], ignore_index=True)  # the same sums in whatever order they came
        if parts["slice"][0] < 0:
            return pd.DataFrame({"ids": [b""], "values": [np.mean([np.frombuffer(v, np.float32) for v in parts["values"]], axis=0, dtype=np.float64).astype(np.float32).tobytes()]})
        size = 3 << BITS
        total, n = np.zeros((size // SLICES, EMBED + 1)), np.zeros(size // SLICES)
        for i, v in zip(parts["ids"], parts["values"], strict=True):
            at = np.frombuffer(i, np.int64) // SLICES
            total[at] += np.frombuffer(v, np.float32).reshape(-1, EMBED + 1)
            n[at] += 1
        seen = np.flatnonzero(n)
        return pd.DataFrame({"ids": [(seen * SLICES + int(parts["slice"][0])).tobytes()], "values": [(total[seen] / n[seen, None]).astype(np.float32).tobytes()]})

    made = rows.select("h", "text", "toxic").mapInArrow(learn, "slice int, ids binary, values binary").groupBy("slice").applyInPandas(mean, "ids binary, values binary").collect()  # as large as the network
    shared.unpersist()
    new, sums = [w.copy() for w in weights], [g.copy() for g in squares]
    for r in made:
        ids, values = np.frombuffer(bytes(r["ids"]), np.int64), np.frombuffer(bytes(r["values"]), np.float32)
        if ids.size:
            new[0][ids], sums[0][ids] = np.split(values.reshape(-1, EMBED + 1), [EMBED], axis=1)
        elif values.size:
            cuts = np.split(values, np.cumsum([x.size for both in (new, sums) for x in both[1:]])[:-1])
            new[1:], sums[1:] = ([v.reshape(w.shape) for v, w in zip(part, weights[1:], strict=True)] for part in (cuts[: len(new) - 1], cuts[len(new) - 1 :]))
    return new, sums


def best_threshold(logits: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> float:
    """The logit of best balanced accuracy over rows of distinct logits or labels with their counts; between two logits the middle."""
    x, at = np.unique(logits, return_inverse=True)
    of = [np.bincount(at, counts * (labels == c), minlength=x.size) for c in (0, 1)]
    if not of[0].sum() or not of[1].sum():
        return 0.0
    hits = np.append(0, np.cumsum(of[0])) / of[0].sum() + 1 - np.append(0, np.cumsum(of[1])) / of[1].sum()
    cut = np.concatenate([[x[0] - 1], (x[1:] + x[:-1]) / 2, [x[-1] + 1]])
    top = np.flatnonzero(hits >= hits.max() - 1e-12)
    return float(cut[top[np.argmin(np.abs(cut[top]))]])


def thresholds_of(rows: DataFrame, model: ToxicityModel) -> dict[str, float]:
    """A threshold for each language from all ``rows`` (text, toxic): their logits are counted on a grid, whose size doesn't grow with them."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, stack = Packed(), shared.value.stacked()
        for b in batches:
            packed = [_unpack(t, memo) for t in b.column(0)]
            at = [round(GRID * float(np.clip(shared.value.logit(buckets(p), stack), -35, 35))) for p in packed]
            yield pa.RecordBatch.from_arrays([pa.array(map(language_of, packed), pa.int32()), pa.array(at, pa.int32()), b.column(1)], ["spoken", "at", "toxic"])

    found = rows.select("text", "toxic").mapInArrow(logits, "spoken int, at int, toxic int").groupBy("spoken", "at", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()
    spoken, at, y, n = np.array([tuple(r) for r in found], np.int64).reshape(-1, 4).T
    overall = best_threshold(at / GRID, y, n)
    enough = lambda own: min(n[own & (y == c)].sum() for c in (0, 1)) >= 8
    return {name: best_threshold(at[spoken == k] / GRID, y[spoken == k], n[spoken == k]) if enough(spoken == k) else overall for k, name in enumerate(LANGUAGES)}


def train(documents: DataFrame, labels: DataFrame, learn: Column, epochs: int = 4, part_rows: int = PART) -> ToxicityModel:
    """``labels`` has doc_id and toxic; ``learn`` says over doc_id which of its rows may be learned from. A fifth of those sets the thresholds, all others fit the network."""
    known = labels.filter(learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    constant = ToxicityModel(np.zeros((0, 0)), [], np.zeros(0), np.zeros(0), 0.0, constant=float(counts.get(1, 0) / max(1, sum(counts.values()))))
    if set(counts) != {0, 1}:
        return constant
    parts = max(1, round(sum(counts.values()) / part_rows))
    rows = documents.select("doc_id", "text").join(F.broadcast(known) if sum(counts.values()) <= FEW_LABELS else known, "doc_id")
    rows = rows.select("doc_id", F.xxhash64("text").alias("th"), "toxic", "text").mapInArrow(_packed, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, th long, toxic int, text binary")
    rows = rows.repartition(parts, "doc_id").groupBy("doc_id").agg(*[F.min_by(c, "th").alias(c) for c in ("text", "toxic")])  # one row for each id
    rows = materialize(rows.select(F.xxhash64(F.lit("toxicity"), "doc_id").alias("h"), "toxic", "text").sortWithinPartitions("h"))
    held = F.pmod("h", F.lit(5)) == 4
    fitted = rows.filter(~held)
    if not fitted.take(1):
        return constant
    weights, squares = start()
    for i in range(epochs):
        weights, squares = epoch_of(fitted, weights, squares, i)
    return network(weights, thresholds_of(rows.filter(held), network(weights)))


def predict(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score (0 to 1, 0.5 is each language's threshold) for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select("doc_id", "text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, model = Packed(), shared.value
        stack = model.stacked() if model.constant is None else None
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(encode(t.as_py(), memo), stack) for t in batch.column(1)], pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
