"""The prefix trie against a version on Python dicts, with blocks and chunks small enough to be crossed."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from loomery.llm import prefix_trie
from loomery.llm.common import table

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def plain_version(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    paths = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(c % 100 if c >= 0 else -(-c % 100))
        paths[c] = tuple(turns.get(base, [])[:h] + mine[h:])
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    children = {n: sum(1 for m in members if len(m) == len(n) + 1 and m[: len(n)] == n) for n in members}
    out = []
    for n, who in members.items():
        below = [m for m in members if m[: len(n)] == n]
        ends = ",".join(map(str, sorted(c for c in who if len(paths[c]) == len(n))))
        saved = sum((len(members[m]) - 1) * (len(m[-1][1]) if m else 0) for m in below)
        out.append((min(who), len(n), min(members[n[:-1]]) if n else None, len(who), children[n], sum(children[m] == 0 for m in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def built(df, **more):
    return sorted((tuple(r[c] for c in COLUMNS) for r in prefix_trie.trie(df, **more).collect()), key=str)


def made(seed, convs, longest, words):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        for i in range(rng.randrange(1, longest + 1)):
            rows.append((c, i, rng.choice(["user", "assistant"]) if rng.random() < 0.1 else ("user", "assistant")[i % 2], rng.choice(words)))
    return rows


@pytest.mark.parametrize(("seed", "block", "chunk"), [(1, 8, 512), (2, 2, 2), (3, 3, 1), (4, 1, 3)])
def test_against_plain_version(spark, seed, block, chunk):
    # A large group of copies and of shared first turns; conversation 300 is absent and 200 short.
    rows = made(seed, [*range(40), *range(201, 215), *range(305, 312), -5, -100, 10**15], 13, ["a", "bé", "c" * 20])
    rows += [(c, i, "user", f"copy {i}") for c in range(400, 440) for i in range(9)] + [(200, 0, "user", "short")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert built(df, block=block, chunk=chunk) == plain_version(rows)


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(1, None, None, None), (1, None, "b", "x"), (1, 3, "a", "same"), (1, 3, "a", "same"), (1, 3, "a", "other"), (None, 1, "user", "no conversation"), (7, 0, "", ""), (100, 0, "u", "漢字"), (101, 5, "u", "漢字"), (102, 0, None, "漢字")]
    df = spark.createDataFrame([(*r, 1, 2.0, "z") for r in rows], SCHEMA + ", block int, k double, p1 string")
    assert built(df) == plain_version(rows)


def test_turnless_and_empty(spark):
    # crc32("2") % 6 of the own turns are left out and conversation 0 is absent: no turn remains.
    only = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(only, 0, "user", "gone")]
    assert built(spark.createDataFrame(rows, SCHEMA)) == plain_version(rows) == [(only, 0, None, 1, 0, 1, 0, hashlib.sha256(str(only).encode()).hexdigest())]
    assert built(spark.createDataFrame([], SCHEMA)) == []


def test_one_conversation_of_many_turns(spark):
    rows = [(100, i, "user", f"turn {i}") for i in range(400)] + [(c, i, "user", f"turn {i}") for c in (101, 102) for i in range(3)]
    assert built(spark.createDataFrame(rows, SCHEMA).repartition(7), block=4, chunk=4) == plain_version(rows)


def test_whole_table(spark):
    df = table(spark, "/root/testdata/sf0.001", "conversations")
    assert built(df) == plain_version([tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in df.collect()])


def test_every_conversation_is_a_member_of_the_root(spark):
    df = table(spark, "/root/testdata/sf0.01", "conversations")
    root = prefix_trie.trie(df).filter("depth = 0").first()
    assert root["n_convs"] == df.select("conv_id").distinct().count() and root["conv_id"] == df.agg(F.min("conv_id")).first()[0]
