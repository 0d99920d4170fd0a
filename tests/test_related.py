"""Entities, related prompts, template hits, label folding and array archives on small cases."""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from loomery import registry
from loomery.functions import text as T
from loomery.functions import topics
from loomery.operators import related as R
from loomery.sources import arrays


def test_entities_of_closed_templates(spark):
    rows = [(1, "What is the capital of France?", "Paris"), (2, "x", "The capital of France is Paris."), (3, "Who invented the plough?", "Jethro Tull is credited with inventing the plough."), (4, "Why?", "Because"), (5, None, "Paris is the capital of France"), (6, "Where is Rome?", None)]
    got = {r["n"]: set(r["e"]) for r in spark.createDataFrame(rows, "n int, u string, a string").select("n", R.fact_entities(F.col("u"), F.col("a")).alias("e")).collect()}
    assert got == {1: {"france"}, 2: {"france", "paris"}, 3: {"the plough", "jethro tull"}, 4: set(), 5: {"paris", "france"}, 6: {"rome"}}


def test_related_prompts_exclude_the_asker_and_stop_at_the_limit(spark):
    index = spark.createDataFrame([("hot", i, f"k{i}", f"K{i}") for i in range(50)] + [("cold", 3, "k3", "K3"), ("cold", 60, "k60", "K60")], "entity string, ord long, key string, user string")
    asked = spark.createDataFrame([(1, "hot", "k2"), (2, "cold", "k3"), (3, "none", "k"), (4, "cold", None), (4, "hot", None)], "qid int, entity string, key string")
    got = {}
    for r in R.related_prompts(asked, index).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["ord"])
    assert got == {1: [0, 1, 3, 4, 5], 2: [60], 4: [0, 1, 2, 3, 4]}


def test_template_hits(spark):
    index = spark.createDataFrame([("who invented plough", "Tull"), ("what is plough", "A tool"), ("who invented the wheel", "?"), ("where is rome", "Italy")], "key string, assistant string")
    entities = spark.createDataFrame([("plough",), ("the wheel",)], "entity string")
    typed = spark.createDataFrame([(1, "Who invented the plough?"), (2, "who invented plough"), (3, "Who invented wheel?"), (4, "Where is the Rome?"), (5, ""), (6, None), (7, "who invented wheel")], "qid int, typed string")
    session = spark.createDataFrame([(7, "The wheel.")], "qid int, entity string")
    got = {(r["qid"], r["key"], r["match_type"]) for r in R.template_hits(typed, index, entities, session).collect()}
    assert got == {(1, "who invented plough", "template"), (2, "who invented plough", "exact"), (7, "who invented the wheel", "template")}


def test_folded_labels(spark):
    rows = [("CO₂  and β–x",), ("Café",), ("日本",), ("",), (None,), ("ﬁne ½",)]
    got = [r["f"] for r in spark.createDataFrame(rows, "t string").coalesce(1).select(T.fold_label(F.col("t")).alias("f")).collect()]
    assert got == ["CO2 and beta-x", "Cafe", "日本", "", None, "fine 12"]


def test_folded_texts_equal_a_plain_loop(spark):
    d = "/root/testdata/sf0.001"
    docs = pd.read_parquet(f"{d}/documents.parquet")
    want = {i: None if t is None else hashlib.sha256(T.folded(t).encode()).hexdigest() for i, t in zip(docs["doc_id"], docs["text"], strict=True)}
    assert {r["doc_id"]: r["sha256"] for r in registry.queries()["folded_texts"](spark, d).collect()} == want


def test_arrays_come_back_whole(spark, tmp_path):
    a, b = np.arange(12, dtype=np.float32).reshape(4, 3), np.zeros((0, 2))
    (tmp_path / "in").mkdir()
    np.savez(tmp_path / "in" / "w.npz", a=a, b=b)
    np.save(tmp_path / "one.npy", np.array([1, 2]))
    got = {}
    for r in arrays.read_arrays(spark, str(tmp_path), chunk=5).orderBy("key", "at").collect():
        got.setdefault((r["key"], tuple(r["shape"])), []).extend(r["values"])
    assert got == {("a", (4, 3)): a.reshape(-1).tolist(), ("b", (0, 2)): [], ("one", (2,)): [1.0, 2.0]}


def test_topics_of_fact_lines(spark):
    rows = {
        "The Gotthard Tunnel runs 57 kilometres below the Alps.": "Gotthard Tunnel",
        "Afterwards they walked on through the wet grass, where nobody lived.": None,
        "Meanwhile, the prices rose for a second year in all of these places.": None,
        "Average yearly rainfall (measured since 1950): 812 mm.": "Average yearly rainfall",
        "New Zealand is a country in the Pacific, far from its nearest neighbour.": "New Zealand",
        "These were soon followed by the first maps of Patagonia in the north.": "Patagonia",
        "Copper, tin, zinc and lead are examples of metals.": "Copper",
        "Otters are playful river mammals.": "Otters",
        "": None,
        None: None,
    }
    df = spark.createDataFrame([(t,) for t in rows], "t string").select("t", topics.topic(F.col("t")).alias("topic"))
    assert {r["t"]: r["topic"] for r in df.collect()} == rows
