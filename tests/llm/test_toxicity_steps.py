"""The work of the toxicity network's inner steps."""

import zlib

import numpy as np

from loomery.llm import toxicity as t


def test_beginnings_are_hashed_once(monkeypatch):
    """Words that begin alike cost one hash each; the numbers are those of the word and its first three and four letters."""
    calls, words = [], [f"tree{i}" for i in range(500)] + ["ab", "é", "--", "(the)"]
    plain = lambda w: [zlib.crc32(p.encode()) & 0xFFFF for p in (w, w[:3] + "\x00", w[:4] + "\x01")]
    expected = np.array([plain(w.strip(t.PUNCTUATION)) for w in words]).T + np.array([[0], [1 << 16], [2 << 16]])
    crc32 = zlib.crc32
    monkeypatch.setattr(t.zlib, "crc32", lambda x: calls.append(x) or crc32(x))
    packed = t.encode(" ".join(words), t.Packed())
    assert (t.buckets(packed) == expected).all() and len(calls) <= len(words) + 2 * 5
    assert t.LANGUAGES[packed[-1] >> 48] == "en"


def test_step_is_the_gradient_of_each_pooled_filter(monkeypatch):
    """One step of all widths at once equals a loop over widths, places and filters; the filters are stacked once for all rows."""
    rng = np.random.default_rng(2)
    rows = [t.buckets(rng.integers(0, 1 << 48, n)) for n in (40, 7, 2, 1, 0, 25)]
    labels, (weights, squares) = [1, 0, 1, 0, 1, 0], t.start()
    m = t.network([w.copy() for w in weights])
    dense = [np.zeros_like(w) for w in weights]
    for words, label in zip(rows, labels, strict=True):
        h, where = m.pool(words)
        d = 1 / (1 + np.exp(-(h @ m.out + m.out_bias))) - label
        dense[-1] += d
        dense[-2] += d * h
        for f in np.flatnonzero(h > 0):
            k, own = divmod(f, t.FILTERS)
            g = d * m.out[f]
            dense[-3][f] += g
            for j in range(t.WIDTHS[k]):
                part, ids = slice(j * t.EMBED, (j + 1) * t.EMBED), words[:, where[f] + j]
                dense[1 + k][part, own] += weights[0][ids].sum(axis=0) * g
                np.add.at(dense[0], ids, m.filters[k][part, own] * g)
    stacks, stacked = [], t.ToxicityModel.stacked
    monkeypatch.setattr(t.ToxicityModel, "stacked", lambda self: stacks.append(1) or stacked(self))
    trainer = t.Trainer(weights, squares)
    trainer.step(rows, labels)
    assert len(stacks) == 1 and (trainer.touched == (dense[0] != 0).any(axis=1)).all()
    for total, before, d in zip(trainer.squares[1:], squares[1:], dense[1:], strict=True):
        assert np.allclose(total - before, d * d, rtol=1e-3, atol=1e-6)
    assert np.allclose((trainer.squares[0] - squares[0])[:, 0], (dense[0] ** 2).mean(axis=1), rtol=1e-3, atol=1e-6)
    for after, total, before, d in zip(trainer.weights, trainer.squares, weights, dense, strict=True):
        assert np.allclose(before - after, trainer.rate * d / np.sqrt(total), rtol=1e-2, atol=1e-4)
