"""A batch of words is taken in pieces of whole rows, so a task's memory doesn't follow the size of its batches."""

import pyarrow as pa

from loomery.operators import tokens as K


def test_pieces_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(K, "WORDS", 10)
    rows = [["a"] * n for n in (3, 4, 4, 0, 25, 1, 9, 1, 0)]
    pieces = list(K.in_pieces(pa.RecordBatch.from_arrays([pa.array(rows)], ["words"]).slice(1)))
    assert [r for p in pieces for r in p.column("words").to_pylist()] == rows[1:]
    assert all(p.num_rows == 1 or sum(map(len, p.column("words").to_pylist())) <= 10 for p in pieces)
