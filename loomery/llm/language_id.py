"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader (per-coordinate rates, elastic-net penalty), then
calibrated by a single temperature. Document frequencies come from every training row; the
regression is fitted on a sample of at most about ``per_language`` rows of each language.

Edge cases: a null text, or one without a letter, is ``und`` with score 0. Rows with a null
language or a null id are never learned from; a null id counts as not held out. Repeated rows are
predicted one by one. Without training rows every prediction is ``und``. Texts of any length are
read whole, in slices. Columns beyond ``doc_id``, ``text`` and ``lang`` are passed through; ``predict`` replaces those
named ``lang_pred`` or ``score``, ``recognised`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UND = "und"
ORDERS = (1, 2, 3)
SLICE = 1 << 18
MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917], dtype=np.uint32)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def ngram_counts(text: str, bits: int) -> np.ndarray:
    """Occurrences of each hashed character n-gram of the whole text."""
    total, last, shift = 0, max(ORDERS) - 1, np.uint32(32 - bits)
    for at in range(0, len(text), SLICE):
        codes = np.frombuffer(text[at : at + SLICE + last].lower().encode("utf-32-le", "replace"), dtype=np.uint32)
        mixed = [codes * m for m in MULTIPLIERS]
        whole = at + SLICE >= len(text)
        hashed = []
        for n in ORDERS:
            size = codes.size - n + 1 if whole else min(codes.size - n + 1, SLICE)
            if size > 0:
                h = mixed[0][:size] + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
                for j in range(1, n):
                    h += mixed[j][j : j + size]
                h >>= shift
                hashed.append(h)
        total = total + np.bincount(np.concatenate(hashed).astype(np.intp), minlength=1 << bits)
    return total if len(text) else np.zeros(1 << bits, dtype=np.int64)


def tfidf(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and L2-normalised sublinear TF-IDF values of a document."""
    index = np.flatnonzero(counts)
    value = (1.0 + np.log(counts[index])) * idf[index]
    norm = np.sqrt((value * value).sum())
    return index, value / norm if norm > 0 else value


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list, labels: np.ndarray, k: int, dim: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Follow the regularised leader over (indices, values) rows; the last coordinate is the bias."""
    z, n = np.zeros((dim + 1, k)), np.zeros((dim + 1, k))
    weigh = lambda zi, ni: np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            index, value = rows[i]
            at, x = np.append(index, dim), np.append(value, 1.0)
            zi, ni = z[at], n[at]
            w = weigh(zi, ni)
            g = softmax(x @ w)
            g[labels[i]] -= 1.0
            g = x[:, None] * g
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[at] = zi + g - sigma * w
            n[at] = ni + g * g
    w = weigh(z, n)
    return w[:dim], w[dim]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-12).mean()
    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(documents: DataFrame, learn: Column, bits: int = 14, per_language: int = 600, epochs: int = 3, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.002, l2: float = 1e-4) -> LanguageModel:
    """Fit on the rows of ``documents`` (doc_id, text, lang) for which ``learn`` holds."""
    spark = documents.sparkSession
    rows = documents.filter(learn & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    per = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = tuple(sorted(per))
    dim = 1 << bits
    if not languages:
        return LanguageModel((), np.ones(dim), np.zeros((dim, 0)), np.zeros(0), 1.0)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs = np.zeros(dim, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                df += ngram_counts(text.as_py(), bits) > 0
                docs += 1
        if docs:
            index = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(index, dim)), pa.array(np.append(df[index], docs))], ["term", "df"])

    # One row for each term of the fixed hash range: bounded, however large the corpus.
    found = rows.select("text").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(dim + 1)
    df[found["term"].to_numpy()] = found["df"].to_numpy()
    idf = np.log((1.0 + df[dim]) / (1.0 + df[:dim])) + 1.0
    shared = spark.sparkContext.broadcast((idf, {x: i for i, x in enumerate(languages)}))

    rate = F.lit(0.0)
    for language, n in per.items():
        rate = F.when(F.col("lang") == language, F.lit(min(1.0, per_language / n))).otherwise(rate)
    # By id and text: rows that share an id are drawn each for itself, and rows that repeat both are learned from once.
    mark = F.xxhash64(F.lit("language sample"), "doc_id", "text")
    uniform = F.pmod(mark, F.lit(1 << 30)) / float(1 << 30)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, code = shared.value
        for batch in batches:
            made = [tfidf(ngram_counts(t.as_py(), bits), idf) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([code[x.as_py()] for x in batch.column(1)], pa.int32()), pa.array([i.astype(np.int32).tobytes() for i, _ in made], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in made], pa.binary())],
                ["label", "terms", "tfidf"],
            )

    k = len(languages)

    def fit(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values(["label", "terms", "tfidf"], ignore_index=True)
        x = [(np.frombuffer(a, np.int32), np.frombuffer(b, np.float32).astype(np.float64)) for a, b in zip(sample["terms"], sample["tfidf"], strict=True)]
        y = sample["label"].to_numpy()
        held = np.arange(len(x)) % 5 == 4
        w, bias = fit_ftrl([r for r, h in zip(x, held, strict=True) if not h], y[~held], k, dim, epochs, alpha, beta, l1, l2)
        logits = np.array([v @ w[i] + bias for (i, v), h in zip(x, held, strict=True) if h]).reshape(-1, k)
        return pd.DataFrame({"weights": [w.tobytes()], "bias": [bias.tobytes()], "temperature": [fit_temperature(logits, y[held])]})

    drawn = rows.withColumn("mark", mark).filter(uniform < rate).groupBy("mark", "lang").agg(F.first("text").alias("text"))
    sample = drawn.select("text", "lang").mapInArrow(features, "label int, terms binary, tfidf binary")
    fitted = sample.groupBy().applyInPandas(fit, "weights binary, bias binary, temperature double").collect()
    if not fitted:
        return LanguageModel((), idf, np.zeros((dim, 0)), np.zeros(0), 1.0)
    one = fitted[0]
    return LanguageModel(languages, idf, np.frombuffer(bytes(one["weights"])).reshape(dim, k), np.frombuffer(bytes(one["bias"])), one["temperature"])


def predict_text(model: LanguageModel, text: str | None) -> tuple[str, float]:
    if not model.languages or not has_letter(text):
        return UND, 0.0
    counts = ngram_counts(text, int(model.idf.size).bit_length() - 1)
    index, value = tfidf(counts, model.idf)
    p = softmax((value @ model.weights[index] + model.bias) / model.temperature)
    best = int(p.argmax())
    return model.languages[best], float(p[best])


def _scored(batch: pa.RecordBatch, at: int, model: LanguageModel) -> tuple[pa.Array, pa.Array]:
    made = [predict_text(model, t.as_py()) for t in batch.column(at)]
    return pa.array([a for a, _ in made], pa.string()), pa.array([b for _, b in made], pa.float64())


def predict(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of ``documents`` with ``lang_pred`` and ``score``, which replace columns of these names; only ``text`` is looked at."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = [c for c in documents.columns if c not in ("lang_pred", "score")]
    rows = documents.select(*names)
    schema = rows.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *_scored(batch, names.index("text"), shared.value)], [*names, "lang_pred", "score"])

    return rows.mapInArrow(score, schema)


def recognised(documents: DataFrame, model: LanguageModel, least: float) -> DataFrame:
    """The rows of ``documents``, columns as they are, whose language is known with a probability of ``least`` or more."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spoken, score = _scored(batch, at, shared.value)
            good = [a != UND and b >= least for a, b in zip(spoken.to_pylist(), score.to_pylist(), strict=True)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return documents.mapInArrow(keep, documents.schema)
