"""Fill-in-the-middle against a version on plain strings, and its edge cases."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from loomery.llm import fill_middle as fim
from loomery.llm.common import table

D = "/root/testdata/sf0.001"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_version(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return (doc_id, n, "plain", None, None, sha(text), sha(text)), text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, form, len(p), len(m), sha(out), sha(text)), out


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64, 1 << 16])
def test_frames_of_any_size_round_trip(size):
    rng = random.Random(size)
    for _ in range(60):
        text = "".join(rng.choice(["a", "b", " ", "\n", "\t", "é", "漢", "<", "P", ">", "S", " ", "x y"]) for _ in range(rng.randrange(40)))
        units = UNIT.findall(text)
        n, frames = fim.cut_frames(text.encode(), size)
        assert n == len(units) and sum(f["chars"] for f in frames) == len(text)
        if re.search("<[PSM]>", text):
            continue
        a, b = sorted(rng.randrange(n + 1) for _ in range(2))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        for form, want in (("psm", f"<P>{p}<S>{s}<M>{m}"), ("spm", f"<S>{s}<P>{p}<M>{m}")):
            out, in_prefix, in_middle = fim.rearrange(frames, n, a, b, form)
            assert (fim.decode(out), in_prefix, in_middle) == (want, len(p), len(m))
            assert b"".join(fim.restore(out, form)).decode() == text
            # Frames that part markers, as another writer may cut them.
            cut = [fim.zstandard.ZstdCompressor().compress(want.encode()[i : i + size]) for i in range(0, len(want.encode()), size)]
            assert b"".join(fim.restore(cut, form)).decode() == text


def test_only_cut_frames_are_decompressed(monkeypatch):
    n, frames = fim.cut_frames(b"word " * 20_000, 1000)
    seen = []
    real = fim.zstandard.ZstdDecompressor

    class Counting:
        def decompress(self, data):
            seen.append(len(data))
            return real().decompress(data)

    monkeypatch.setattr(fim.zstandard, "ZstdDecompressor", Counting)
    fim.rearrange(frames, n, 7000, 12_000, "spm")
    assert len(frames) == 100 and len(seen) <= 6


def rows_of(df):
    return [tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")) for r in df.collect()]


def key(r):
    return (r[0] is None, r[0] or 0, *map(str, r[1:]))


def test_whole_table_and_odd_rows(spark, tmp_path):
    long = "the quick brown fox  jumps\tover é " * 30_000
    odd = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " \n "), (10**6 + 3, "has <P> inside"), (10**6 + 4, long), (10**6 + 5, "x" * 200_000), (None, "no id at all"), (5, "repeated id"), (5, "repeated id")]
    odd += [(2 * 10**6 + i, t) for i in range(40) for t in (" lead and trail ", "\x00 nul \x0b tab", "ü")]
    docs = table(spark, D, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    docs = docs.withColumns({"form": F.lit(1), "n": F.lit("clash"), "frames": F.lit(2.0)})
    want = {}
    for r in docs.collect():
        row, out = plain_version(r["doc_id"], r["text"])
        want.setdefault(row, out)
    got = fim.transform(fim.choose(fim.store(docs, f"{tmp_path}/frames", frame=4096)))
    assert sorted(rows_of(got), key=key) == sorted((plain_version(r["doc_id"], r["text"])[0] for r in docs.collect()), key=key)
    for r in got.limit(300).collect():
        row = tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"))
        assert fim.decode(r["output"]) == want[row]
    assert {r[2] for r in rows_of(got)} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert fim.transform(fim.choose(fim.compress(spark.createDataFrame([], "doc_id long, text string")))).collect() == []
