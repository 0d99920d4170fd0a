"""Near copies by exact similarity against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from loomery.llm import similar


def near_copies():
    """Texts of 40 to 200 words, each with copies of which one to four words are changed."""
    rng, texts = random.Random(3), []
    word = lambda: f"w{rng.randrange(5000)}"
    for n in [40, 100, 200] * 15:
        base = [word() for _ in range(n)]
        texts.append(base)
        for changes in (1, 2, 4):
            copy = list(base)
            for at in rng.sample(range(n), changes):
                copy[at] = word()
            texts.append(copy)
    return [" ".join(t) for t in texts] + ["one two", "one  TWO", "one three", "", None, "a b c d e f"]


def brute(texts):
    def grams(t):
        w = (t or "").lower().split()
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())

    sets, root = list(map(grams, texts)), list(range(len(texts)))
    near = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if (len(a & b) >= 0.8 * len(a | b) if a or b else True)]
    changed = True
    while changed:
        changed = False
        for i, j in near:
            if root[i] != root[j]:
                root[i] = root[j] = min(root[i], root[j])
                changed = True
    return near, root


def grouped(pairs):
    groups = {}
    for i, c in pairs:
        groups.setdefault(c, set()).add(i)
    return {frozenset(g) for g in groups.values()}


def test_components_equal_brute_force(spark):
    texts = near_copies()
    near, root = brute(texts)
    got = {r["doc_id"]: r["component"] for r in similar.components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = sum(got[i] == got[j] for i, j in near)
    print("pairs of similarity 0.8 and more:", len(near), "found:", found)
    assert len(near) > 60 and found == len(near)
    assert grouped(got.items()) == grouped(enumerate(root))


def test_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    texts = [" ".join(base[:at] + [f"x{n}"] + base[at + 1 :]) for n, at in enumerate(rng.choices(range(80), k=300))]
    got = {r["component"] for r in similar.components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(got) == len(set(brute(texts)[1])) == 1


def test_dedup_stage_drops_near_copies(spark):
    import corpus_pipeline as p

    texts = near_copies()
    root = brute(texts)[1]
    out = p.dedup_stage(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n", F.lit(1)), "")
    assert {r["doc_id"] for r in out.collect()} == {i for i, c in enumerate(root) if i == c} and out.columns == ["doc_id", "text", "n"]


def test_spanning_trees_are_least():
    bits = np.random.default_rng(6).integers(0, 1 << 63, (40, 4), dtype=np.uint64)
    far = lambda i, j: int(np.bitwise_count(bits[i] ^ bits[j]).sum())
    root, least = list(range(40)), 0
    for d, i, j in sorted((far(i, j), i, j) for i in range(40) for j in range(i)):
        if root[i] != root[j]:
            least, root = least + d, [root[i] if r == root[j] else r for r in root]
    tree = similar.spanning_tree(bits, nearest=0)
    assert len(tree) == 39 and sum(far(i, j) for i, j in tree) == least


def test_many_buckets_lose_no_link(spark, monkeypatch):
    """Tables of sampled bits, and buckets that are dealt out in parts."""
    texts = near_copies()
    near, _ = brute(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(similar, "BUCKET", 8)
    for bucket_rows in (1 << 15, 6):
        got = {r["doc_id"]: r["component"] for r in similar.components(docs, bucket_rows).collect()}
        assert len(similar.plan(len(texts))) > 10 and sum(got[i] == got[j] for i, j in near) == len(near)


def crowded(seed, changes=(2, 5)):
    """Three groups of 80 texts of 100 words, one to three or five words changed in each: most pairs of a group lie below the similarity, many just above."""
    rng, texts = random.Random(seed), []
    for _ in range(3):
        base = [f"w{rng.randrange(5000)}" for _ in range(100)]
        for _ in range(80):
            copy = list(base)
            for at in rng.sample(range(100), rng.randint(*changes)):
                copy[at] = f"w{rng.randrange(5000)}"
            texts.append(" ".join(copy))
    return texts


def test_no_link_is_lost_in_crowded_groups(spark):
    """All tables in one call, told apart by words of their own, so that no link crosses them."""
    tables = [[" ".join(f"{w}t{k}" for w in t.split()) for t in crowded(100 + k, (1, 3) if k % 2 else (1, 5))] for k in range(8)]
    texts = [t for table in tables for t in table]
    got = {r["doc_id"]: r["component"] for r in similar.components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    pairs = 0
    for k, table in enumerate(tables):
        near, root = brute(table)
        pairs += len(near)
        own = {i: got[240 * k + i] for i in range(240)}
        assert all(own[i] == own[j] for i, j in near)
        assert grouped(own.items()) == grouped(enumerate(root))
    assert pairs > 20


def test_refuted_pairs_are_not_moved(spark):
    """A group whose pairs lie just below the similarity sends less than a row a text on, dealt out or whole."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for n in range(200):
        copy = list(base)
        for at in rng.sample(range(0, 100, 10), 2) + rng.sample(range(5, 100, 10), 1):
            copy[at] = f"x{n}y{at}"
        texts.append(" ".join(copy))
    near, root = brute(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("xxhash64(text) as th", "text")
    of = docs.mapInArrow(similar._sketches, "th long, s long, fp binary, size long").cache()
    groups = similar.connected_components(similar.candidates(of, of.count())).cache()
    assert groups.count() == 199 and len(near) < 2000
    for cell in (similar.CELL, 4000):
        links = similar.confirmed(groups, docs, of, cell)
        assert links.count() < 200 * (1 if cell == similar.CELL else 10)
        got = {r["doc_id"]: r["component"] for r in similar.components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), cell=cell).collect()}
        assert grouped(got.items()) == grouped(enumerate(root))


def test_rare_shingles_find_every_similar_set():
    rng = np.random.default_rng(4)
    for _ in range(30):
        sets = [np.unique(rng.choice(12, rng.integers(1, 12))).astype(np.uint64) for _ in range(12)]
        side = rng.integers(0, 2, 12)
        for own in (np.zeros(12, int), side):
            root, two = list(range(12)), own.min() != own.max()
            for i in range(12):
                for j in range(i):
                    same = np.intersect1d(sets[i], sets[j]).size
                    if same / (sets[i].size + sets[j].size - same) >= 0.8 and not (two and own[i] == own[j]):
                        root = [root[i] if r == root[j] else r for r in root]
            assert grouped(enumerate(similar.alike(sets, own).tolist())) == grouped(enumerate(root))
