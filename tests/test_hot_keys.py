"""Joins and selections with one key in most rows, on both of their ways; acceptance rules, tensors' labels and health."""

import hashlib

import pytest
from pyspark.sql import functions as F

from loomery.operators import corpus as C
from loomery.operators import evaluation as E
from loomery.operators import packs as K
from loomery.operators import related as R
from loomery.operators import tensors as A


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_holdout_lines_with_a_frequent_line(spark, monkeypatch, few):
    monkeypatch.setattr(C, "FEW_ITEMS", few)
    docs = [(i, "same line\nsame line\n\nown " + str(i)) for i in range(300)] + [(1000 + i, f"a\n  held   item \n{i}") for i in range(50)] + [(2000, ""), (2001, None), (2002, "held item")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = lambda *held: {r[0] for r in C.exclude_holdout(df, spark.createDataFrame([(h,) for h in held], "text string")).select("doc_id").collect()}
    assert kept("held item") == {i for i, _ in docs} - {*range(1000, 1050), 2002}
    assert kept("same line", "held item") == {2000, 2001}
    assert kept("") == {*range(1000, 1050), 2001, 2002}
    assert kept() == {i for i, _ in docs}


@pytest.mark.parametrize("few", [0, 1 << 16])
def test_related_prompts_of_a_hot_entity(spark, monkeypatch, few):
    monkeypatch.setattr(R, "FEW_FACTS", few)
    index = spark.createDataFrame([("hot" if i % 2 else f"e{i % 7}", f"k{i}", i, f"q{i}") for i in range(400)], "entity string, key string, ord long, user string")
    asked = index.select(F.col("ord").alias("qid"), "entity", "key")
    got = {}
    for r in R.related_prompts(asked, index).collect():
        got.setdefault(r["qid"], {})[r["rank"]] = r["ord"]
    rows = index.collect()
    for q in rows:
        near = sorted(r["ord"] for r in rows if r["entity"] == q["entity"] and r["key"] != q["key"])[:5]
        assert [got[q["ord"]][k] for k in sorted(got[q["ord"]])] == near


@pytest.mark.parametrize("n", [0, 1, 7, 500, 2999, 3000, 5000])
def test_first_by_hash_is_exact(spark, n):
    rows = spark.range(3000).withColumn("text", F.lit("x"))
    want = sorted(range(3000), key=lambda i: (hashlib.md5(f"s:{i}".encode()).hexdigest(), i))[:n]
    assert sorted(r["id"] for r in K.first_by_hash(rows, n, "s").collect()) == sorted(want)


def test_shuffled_places(spark):
    mix = spark.range(500).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), "id")
    got = sorted((r["place"], r["source"], r["id"]) for r in K.shuffled(mix).collect())
    want = sorted((hashlib.md5(f"7:mix:{'a' if i % 3 == 0 else 'b'}:{i}".encode()).hexdigest(), i) for i in range(500))
    assert [(p, i) for p, _, i in got] == [(k, i) for k, (_, i) in enumerate(want)]


def verdict(spark, replies, expected=None):
    df = spark.createDataFrame([("r", p, t) for p, t in replies], "run string, prompt string, text string")
    return E.acceptance(df, expected).first()


def test_acceptance_rules(spark):
    named = [("a cat named Bob and one named Tim", "and tim ran"), ("a dog named Sue", "Sue sat"), ("a fox named Max", "it hid")]
    plain = [("say more", "all is well")] * 5
    ok = verdict(spark, named + plain)
    assert (ok["named"], ok["held_rate"], ok["restarts"], ok["dumps"], ok["verdict"]) == (3, pytest.approx(2 / 3, abs=1e-6), 0.0, 0, "PASS")
    assert verdict(spark, [*named[:1], ("one named Ann", "no"), *plain])["verdict"] == "REVIEW"  # exactly half
    assert verdict(spark, plain)["verdict"] == "REVIEW"  # no name anywhere
    restarts = [("x", "So. oNCE UPON a time")] * 2
    assert verdict(spark, named + plain[:3] + restarts)["verdict"] == "REVIEW"  # exactly a quarter
    assert verdict(spark, named + plain + restarts)["verdict"] == "PASS"
    assert verdict(spark, [*named, *plain, ("x", " ")])["verdict"] == "REVIEW"  # a dump
    asks = spark.createDataFrame([("What is 17 + 4?", "21")], "prompt string, substring string")
    assert verdict(spark, named + plain, asks)["missing"] == 1
    assert verdict(spark, [*named, *plain, ("What is 17 + 4?", "It is 20."), ("What is 17 + 4?", "It is 21.")], asks)["verdict"] == "PASS"


def test_axes_and_units(spark):
    leaves = {"token_embedding": ("token", "residual"), "mlp_contract": ("mlp hidden", "residual"), "qkv_proj": ("residual", "qkv"), "ln_gamma": ("gamma", "scale"), "other": ("row", "col")}
    df = spark.createDataFrame([(k,) for k in leaves], "leaf string")
    assert {r[0]: (r[1], r[2]) for r in df.select("leaf", *A.plane_axes(F.col("leaf"))).collect()} == leaves
    units = spark.createDataFrame([("qkv", 0, 12), ("qkv", 5, 12), ("qkv", 11, 12), ("qkv", 12, 13), ("qkv", 1, 2), ("token", 7, 12)], "kind string, i int, w int")
    assert [r[0] for r in units.select(A.unit_label(F.col("kind"), F.col("i"), F.col("w"))).collect()] == ["Q[0]", "K[1]", "V[3]", "qkv 12", "qkv 1", "token 7"]
    assert A.heatmap_steps(72, 73) == (1, 2) and A.heatmap_steps(1000, 5) == (14, 1)


def test_health_of_gradients_and_archives(spark):
    cells = lambda *norms: spark.createDataFrame([(i, float(x)) for i, x in enumerate(norms)], "layer int, x double")
    get = lambda *n: tuple(A.gradient_health(cells(*n)).first())
    assert get(1, 2, 20) == (1.0, 20.0, 20.0, [], True)
    assert get(1, 2, 21)[4] is False and get(3, 0, 3) == (3.0, 3.0, 1.0, [1], False) and get(5) == (5.0, 5.0, 1.0, [], True)
    t = spark.createDataFrame([("a", 0, ["dead"]), ("b", 0, ["dead", "sparse"]), ("c", 1, ["dead"]), ("d", 1, []), ("e", None, ["sparse"])], "key string, layer int, flags array<string>")
    assert tuple(A.archive_health(t).first()) == (["dead", "sparse"], [0], False)
    assert tuple(A.archive_health(t.filter("key = 'e'")).first()) == (["sparse"], [], True)
    ranks = spark.createDataFrame([(1, [1.0, 2.0, 2.0], 2), (2, [1.0, 2.0, 2.0], 1), (3, [0.0], -1)], "id int, logits array<double>, target int")
    assert {r["id"]: (r["rank"], [b["id"] for b in r["top"]]) for r in A.token_ranks(ranks, 2).collect()} == {1: (2, [1, 2]), 2: (1, [1, 2])}
    assert tuple(A.token_scores(ranks.withColumn("f", F.lit("x")).filter("id = 3"), "f").first()) == ("x", 0, 0.0, False, None)
