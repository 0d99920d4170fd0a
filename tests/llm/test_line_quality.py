"""The line field against sums over all labelings, its held-out accuracy and edge cases."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.llm import line_quality as lq
from loomery.llm import queries
from loomery.llm.common import crc_bucket, table


def test_marginals_by_enumeration():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 7):
        scores, starts, moves = rng.normal(0, 2, n), rng.normal(0, 1, 2), rng.normal(0, 1, (2, 2))
        weight = {y: np.exp(starts[y[0]] + sum(s for s, k in zip(scores, y, strict=True) if k) + sum(moves[a, b] for a, b in itertools.pairwise(y))) for y in itertools.product((0, 1), repeat=n)}
        total = sum(weight.values())
        want = [sum(w for y, w in weight.items() if y[i]) / total for i in range(n)]
        assert np.allclose(lq.marginals(scores, starts, moves), want)
        padded = np.zeros((1, n))
        padded[0] = scores
        p, pairs, first = lq._expected(padded, np.array([n]), starts, moves)
        assert np.allclose(p[0], want)
        assert np.allclose(pairs, [[sum(w * sum((a, b) == m for m in itertools.pairwise(y)) for y, w in weight.items()) / total for b in (0, 1)] for a in (0, 1)])
        assert np.allclose(first, [1 - want[0], want[0]])


def test_neighbours_count():
    """A line whose measures say nothing takes its label from the lines around it."""
    clean, junk = "A plain line of words that says a thing.", "BUY!! $$$ NOW!! $$$ ###"
    rng = np.random.default_rng(1)
    texts, y = [], []
    for i in range(200):
        kind = clean if i % 2 else junk
        texts.append("\n".join(f"{kind} {rng.integers(10)}" for _ in range(5)))
        y.append(i % 2)
    seen = [lq.describe(t) for t in texts]
    m = lq.fit([b for b, _ in seen], [s for _, s in seen], np.array(y))
    between = lambda kind: m.lines(lq.describe("\n".join([f"{kind} 1", f"{kind} 2", "zzz", f"{kind} 3", f"{kind} 4"]))[0])[2]
    assert between(clean) > 0.5 > between(junk)


def test_long_lines_are_measured_whole(monkeypatch):
    line = b"word other third " * 900
    whole = lq.measure(line)
    monkeypatch.setattr(lq, "PIECE", 100)
    assert lq.measure(line) == pytest.approx(whole)


def test_held_out(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    got = queries.op11_line_field(spark, "/root/testdata/sf0.01")
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    rows = got.filter("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    for c in (0, 1):
        own = [r["predicted"] == c for r in rows if r["quality"] == c]
        assert sum(own) >= 0.9 * len(own)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "\n\n\n"), (4, "one line"), (4, "one line"), (4, "another text of the id"), (None, "no id"), (5, "w " * 300_000), (6, "x" * 3_000_000), (7, "line\n" * 20_000), (8, "\x00\x01 é")]
    docs += [(100 + i, ("Plain words stand here.\nAnd here." if i % 2 else "$$$ ### $$$\n!!! ###")) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit(1), "quality": F.lit(0), "th": F.lit("x")})
    labels = spark.createDataFrame([(100 + i, i % 2, None) for i in range(60)] + [(101, 1, 0), (None, 0, 0), (1, None, 0), (4, 1, 0)], "doc_id long, quality int, text int")
    model = lq.train(df, labels, F.lit(True))
    got = lq.predict(df, model).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got)
    assert all((r["score"] >= lq.CUT) == bool(r["doc_id"] % 2) for r in got if r["doc_id"] and r["doc_id"] >= 100)
    lines = lq.label_lines(df, model)
    assert lines.filter("doc_id = 7").count() == 20_001 and lines.filter("doc_id = 1").count() == 1
    assert lq.predict(df.limit(0), model).count() == 0
    assert lq.train(df, labels.filter("quality = 1"), F.lit(True)).constant == 1.0
    assert lq.train(df, labels.limit(0), F.lit(True)).constant == 1.0
    assert lq.train(df.limit(0), labels, F.lit(True)).constant == pytest.approx(31 / 61)


def test_one_id_for_many_rows_is_learned_once(spark):
    docs = spark.createDataFrame([(1, f"text {i}\nof one id") for i in range(500)] + [(i, "$$$ !!! ###") for i in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] + [(i, 0) for i in range(2, 40)], "doc_id long, quality int")
    model = lq.train(docs, labels, F.coalesce(crc_bucket(F.col("doc_id"), 5) >= 0, F.lit(False)))
    assert model.constant is None
