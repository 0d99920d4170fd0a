"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is good or bad. A line is described by the buckets of its measures (length, words, character classes, repeated words,
repeated lines), and by those of the line before and after it; a chain of two states with weights for transitions ties
neighbouring labels. Forward-backward marginals, weighted by the lines' lengths, give the share of a text that is good, and a logistic curve
calibrated on learning rows that the fit has not seen turns it into a score; its cut of best balanced accuracy lies at ``CUT``.

Labels are of documents. All lines of a good document are taken for good. Lines of a bad one begin as bad; a field without transitions is
fitted, then lines that it finds good (but for the worst of each document) become good, and the chain is fitted to those.

The fit uses at most ``per_class`` documents of either class of at most ``max_lines`` lines, one row for each id. Scoring reads every
text whole, line by line.

Edge cases: null and empty texts are one empty line. Null labels and null ids are never learned from; a document of several labels is good
if all say so. Without both classes every score is the share of good rows (1 without any label). Repeated rows are scored one by one, an empty table
gives an empty result, extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A score of at least this much means good.
CUT = 0.3
#: A longer line is measured in pieces, cut at a blank if there is one near.
PIECE, NEAR = 1 << 20, 1 << 12
#: Upper edges of the buckets.
SHARES = (0.0, 0.01, 0.03, 0.06, 0.1, 0.15, 0.25, 0.4, 0.6, 0.8, 0.95)
SIZES = (0, 2, 5, 10, 20, 40, 80, 160, 320, 640, 1280)
WORD_SIZES = (1.5, 2.5, 3, 3.5, 4, 4.5, 5, 6, 7, 9, 13)
MEASURES = ("bytes", "words", "upper", "digits", "stops", "marks", "blanks", "word_size", "repeated", "adjacent", "ending", "top", "end", "begin", "again")
BUCKETS = max(map(len, (SHARES, SIZES, WORD_SIZES))) + 1
#: Places of a line's neighbourhood whose measures count: the line, the one before, the one after.
PLACES = 3
OUTSIDE = BUCKETS  # bucket of a place beyond the text
#: Character classes: 0 letters and all beyond ASCII, 1 upper case, 2 digits, 3 blanks, 4 stops, 5 other marks.
_CLASS = np.full(256, 5, np.uint8)
_CLASS[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[0x20, *range(0x09, 0x0E)]] = 3
_CLASS[list(b".,;:?'\"-")] = 4


def _pieces(line: bytes) -> Iterator[bytes]:
    at = 0
    while len(line) - at > PIECE:
        blank = line.find(b" ", at + PIECE, at + PIECE + NEAR)
        stop = blank if blank >= 0 else at + PIECE
        yield line[at:stop]
        at = stop
    yield line[at:] if at else line


def measure(line: bytes) -> tuple:
    """The measures of one line, those of MEASURES in order but for the last."""
    classes, words, adjacent, ending, letters, seen, previous = np.zeros(6, np.int64), 0, 0, 0, 0, {}, None
    for piece in _pieces(line):
        classes += np.bincount(_CLASS[np.frombuffer(piece, np.uint8)], minlength=6)
        own = piece.split()
        words += len(own)
        letters += sum(map(len, own))
        adjacent += sum(map(bytes.__eq__, own, own[1:])) + (bool(own) and own[0] == previous)
        ending += sum(w[-1] not in _WORD_ENDS for w in own)
        for w in own:
            seen[w] = seen.get(w, 0) + 1
        previous = own[-1] if own else previous
    n, w = max(1, len(line)), max(1, words)
    first, last = _CLASS[line[0]] if line else 6, _CLASS[line[-1]] if line else 6
    return (len(line), words, *(classes[k] / n for k in range(1, 6) if k != 3), classes[3] / n, letters / w, 1 - len(seen) / w, adjacent / w, ending / w, max(seen.values(), default=0) / w, last, first)


_WORD_ENDS = frozenset([*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("0"), ord("9") + 1), *range(0x80, 0x100)])


def describe(text: str | bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every line's measures (uint8), and the lines' bytes."""
    data = (text or b"") if not isinstance(text, str) else text.encode("utf-8", "replace")
    lines, seen, previous, again = data.split(b"\n"), set(), None, []
    rows = []
    for line in lines:
        rows.append(measure(line))
        h = (len(line), zlib.crc32(line), zlib.adler32(line))
        again.append(2 if h == previous else 1 if h in seen else 0)
        seen.add(h)
        previous = h
    x = np.array(rows, np.float64)
    out = np.empty((len(lines), len(MEASURES)), np.uint8)
    for j, name in enumerate(MEASURES[:-1]):
        edges = SIZES if name in ("bytes", "words") else WORD_SIZES if name == "word_size" else None
        out[:, j] = x[:, j] if name in ("end", "begin") else np.searchsorted(edges or SHARES, x[:, j], side="left")
    out[:, -1] = again
    return out, x[:, 0]


def places(buckets: np.ndarray) -> np.ndarray:
    """Indices of a line's weights: its own buckets and its neighbours'."""
    n, m = buckets.shape
    edge = np.full((1, m), OUTSIDE, np.int64)
    around = (buckets.astype(np.int64), np.concatenate([edge, buckets[:-1]]), np.concatenate([buckets[1:], edge]))
    width = BUCKETS + 1
    return np.concatenate([(p * m + np.arange(m)) * width + b for p, b in enumerate(around)], axis=1)


WEIGHTS = PLACES * len(MEASURES) * (BUCKETS + 1)


def marginals(scores: np.ndarray, starts: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """P(good) of each line of one text: scores of good over bad, log weights of the first state (bad, good) and of moves [from, to]."""
    n = len(scores)
    e = np.exp(np.clip(scores, -30, 30)).tolist()
    (bb, bg), (gb, gg) = np.exp(moves).tolist()
    sb, sg = np.exp(starts).tolist()
    forward, b, g = [], sb, sg * e[0]
    for i in range(n):
        if i:
            b, g = b * bb + g * gb, (b * bg + g * gg) * e[i]
        total = b + g
        b, g = b / total, g / total
        forward.append((b, g))
    out, b, g = np.empty(n), 1.0, 1.0
    for i in range(n - 1, -1, -1):
        fb, fg = forward[i]
        out[i] = fg * g / (fb * b + fg * g)
        ng = g * e[i]
        b, g = bb * b + bg * ng, gb * b + gg * ng
        total = b + g
        b, g = b / total, g / total
    return out


@dataclass
class LineField:
    weights: np.ndarray
    starts: np.ndarray
    moves: np.ndarray
    slope: float = 1.0
    middle: float = 0.5
    constant: float | None = None

    def lines(self, buckets: np.ndarray) -> np.ndarray:
        return marginals(self.weights[places(buckets)].sum(axis=1), self.starts, self.moves)

    def share(self, text: str | bytes | None) -> float:
        """The good share of a text: marginals weighted by bytes (one more for each line)."""
        buckets, size = describe(text)
        return float(np.average(self.lines(buckets), weights=size + 1))

    def score(self, text: str | bytes | None) -> float:
        return self.constant if self.constant is not None else self.curve(self.share(text))

    def curve(self, share: float) -> float:
        x = self.slope * (share - self.middle) + np.log(CUT / (1 - CUT))
        return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def _expected(scores: np.ndarray, lengths: np.ndarray, starts: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals (documents x lines), expected moves and expected first states of many texts at once, longest first."""
    d, t = scores.shape
    f, g = np.zeros((t, d, 2)), np.zeros((t, d, 2))
    emit = np.stack([np.zeros_like(scores), scores], axis=2)
    f[0] = starts + emit[:, 0]
    live = [int((lengths > i).sum()) for i in range(t)]
    for i in range(1, t):
        a = live[i]
        f[i, :a] = np.logaddexp(f[i - 1, :a, 0, None] + moves[0], f[i - 1, :a, 1, None] + moves[1]) + emit[:a, i]
    for i in range(t - 2, -1, -1):
        a = live[i + 1]
        onward = emit[:a, i + 1] + g[i + 1, :a]
        g[i, :a] = np.logaddexp(moves[:, 0] + onward[:, None, 0], moves[:, 1] + onward[:, None, 1])
    whole = np.logaddexp(f[0, :, 0] + g[0, :, 0], f[0, :, 1] + g[0, :, 1])
    p = np.exp(f[:, :, 1] + g[:, :, 1] - whole).T
    pairs = np.zeros((2, 2))
    for i in range(1, t):
        a = live[i]
        onward = emit[:a, i] + g[i, :a]
        pairs += np.exp(f[i - 1, :a, :, None] + moves + onward[:, None, :] - whole[:a, None, None]).sum(axis=0)
    first = np.array([(1 - p[:, 0]).sum(), p[:, 0].sum()])
    return p, pairs, first


def fit_field(index: list[np.ndarray], labels: list[np.ndarray], chain: bool, steps: int, rate: float = 0.3, decay: float = 1e-4) -> LineField:
    """Adagrad on the log-likelihood of the line labels; without ``chain`` moves and starts stay zero."""
    order = sorted(range(len(index)), key=lambda i: -len(index[i]))
    lengths = np.array([len(index[i]) for i in order])
    d, t = len(order), int(lengths.max())
    inside = np.arange(t) < lengths[:, None]
    flat, y = np.concatenate([index[i] for i in order]), np.concatenate([labels[i] for i in order]).astype(np.float64)
    observed, first = np.zeros((2, 2)), np.zeros(2)
    for i in order:
        np.add.at(observed, (labels[i][:-1], labels[i][1:]), 1)
        first[labels[i][0]] += 1
    w, starts, moves = np.zeros(WEIGHTS), np.zeros(2), np.zeros((2, 2))
    sums = [np.full_like(x, 1e-8) for x in (w, starts, moves)]
    for _ in range(steps):
        scores = np.zeros((d, t))
        scores[inside] = w[flat].sum(axis=1)
        p, pairs, begun = _expected(scores, lengths, starts, moves)
        error = y - p[inside]
        grads = [np.bincount(flat.ravel(), np.repeat(error, flat.shape[1]), WEIGHTS) / len(y) - decay * w]
        grads += [(first - begun) / d, (observed - pairs) / max(1.0, observed.sum())] if chain else []
        for value, total, g in zip((w, starts, moves), sums, grads, strict=False):
            total += g * g
            value += rate * g / np.sqrt(total)
    return LineField(w, starts, moves)


def best_cut(x: np.ndarray, y: np.ndarray) -> float:
    """The value of best balanced accuracy; of several the middle of the widest gap."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    hits = np.append(0, np.cumsum(y == 0)) / (y == 0).sum() + 1 - np.append(0, np.cumsum(y == 1)) / (y == 1).sum()
    edges = np.concatenate([[0.0], x, [1.0]])
    top = np.flatnonzero(hits >= hits.max() - 1e-12)
    k = top[np.argmax(edges[top + 1] - edges[top])]
    return float((edges[k] + edges[k + 1]) / 2)


def fit(buckets: list[np.ndarray], sizes: list[np.ndarray], y: np.ndarray, steps: int = 120) -> LineField:
    """From described documents and their labels; every fifth of either class calibrates."""
    held = np.zeros(len(y), bool)
    for c in (0, 1):
        held[np.flatnonzero(y == c)[4::5]] = True
    own = np.flatnonzero(~held)
    index = [places(buckets[i]) for i in own]
    flat = fit_field(index, [np.full(len(ix), y[i]) for ix, i in zip(index, own, strict=True)], chain=False, steps=steps)
    labels = []
    for ix, i in zip(index, own, strict=True):
        line = np.ones(len(ix), np.int64)
        if not y[i]:
            s = flat.weights[ix].sum(axis=1)
            line = (s > 0).astype(np.int64)
            line[np.argmin(s)] = 0
        labels.append(line)
    m = fit_field(index, labels, chain=True, steps=steps)
    at = np.flatnonzero(held)
    share = np.array([np.average(m.lines(buckets[i]), weights=sizes[i] + 1) for i in at])
    if len({*y[at]}) == 2:
        m.middle = best_cut(share, y[at])
    m.slope = _slope(share - m.middle, y[at])
    return m


def _slope(x: np.ndarray, y: np.ndarray) -> float:
    """Of the logistic curve through the cut, by the likelihood of classes of equal weight."""
    if len({*y}) < 2:
        return 10.0
    weight = np.where(y == 1, 1 / (y == 1).sum(), 1 / (y == 0).sum())
    grid = np.linspace(2, 30, 57)
    loss = [np.sum(weight * np.logaddexp(0, -(2 * y - 1) * (k * x + np.log(CUT / (1 - CUT))))) for k in grid]
    return float(grid[int(np.argmin(loss))])


def train(documents: DataFrame, labels: DataFrame, learn: Column, per_class: int = 1500, max_lines: int = 2000) -> LineField:
    """``labels`` has doc_id and quality; ``learn`` says over doc_id which of its rows may be learned from."""
    known = labels.filter(learn & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min((F.col("quality") > 0).cast("int")).alias("quality"))
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    constant = LineField(np.zeros(0), np.zeros(2), np.zeros((2, 2)), constant=float(counts.get(1, 0) / max(1, sum(counts.values()))) if counts else 1.0)
    if set(counts) != {0, 1}:
        return constant
    order = F.xxhash64(F.lit("quality sample"), "doc_id")
    picked = known.filter("quality = 1").orderBy(order, "doc_id").limit(per_class).unionByName(known.filter("quality = 0").orderBy(order, "doc_id").limit(per_class))
    rows = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")  # at most 2 * per_class ids
    rows = rows.filter(F.length("text") - F.length(F.replace("text", F.lit("\n"))) < max_lines).select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"), "quality")

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [describe(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), batch.column("quality"), pa.array([b.tobytes() for b, _ in done], pa.binary()), pa.array([s.tobytes() for _, s in done], pa.binary())], ["doc_id", "th", "quality", "buckets", "sizes"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    sample = rows.mapInArrow(described, f"doc_id {kind}, th bigint, quality int, buckets binary, sizes binary")
    sample = sample.groupBy("doc_id").agg(*[F.min_by(c, "th").alias(c) for c in ("quality", "buckets", "sizes")])  # one row for each id

    def learned(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["quality", "doc_id"], ignore_index=True)
        y = rows["quality"].to_numpy()
        if len({*y}) < 2:
            return pd.DataFrame({"weights": [], "chain": []})
        m = fit([np.frombuffer(b, np.uint8).reshape(-1, len(MEASURES)) for b in rows["buckets"]], [np.frombuffer(s) for s in rows["sizes"]], y)
        return pd.DataFrame({"weights": [m.weights.tobytes()], "chain": [[*m.starts, *m.moves.ravel(), m.slope, m.middle]]})

    r = sample.groupBy().applyInPandas(learned, "weights binary, chain array<double>").collect()
    if not r:
        return constant
    c = r[0]["chain"]
    return LineField(np.frombuffer(bytes(r[0]["weights"])), np.array(c[:2]), np.array(c[2:6]).reshape(2, 2), c[6], c[7])


def predict(documents: DataFrame, model: LineField) -> DataFrame:
    """doc_id and score (0 to 1, at least CUT is good) of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select("doc_id", F.col("text").cast("binary").alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t.as_py()) for t in batch.column(1)], pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def label_lines(documents: DataFrame, model: LineField) -> DataFrame:
    """doc_id, line (from 0), n_bytes, good (marginal) and label of every line of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select("doc_id", F.col("text").cast("binary").alias("text"))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                buckets, size = describe(text.as_py())
                p = model.lines(buckets) if model.constant is None else np.full(len(size), model.constant)
                n = len(size)
                yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()] * n, batch.schema.types[0]), pa.array(np.arange(n)), pa.array(size.astype(np.int64)), pa.array(p), pa.array(np.where(p >= 0.5, "good", "bad").tolist(), pa.string())], ["doc_id", "line", "n_bytes", "good", "label"])

    return rows.mapInArrow(lines, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, line bigint, n_bytes bigint, good double, label string")
