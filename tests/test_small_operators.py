"""Sanitized replies, look-ups by source, questions of shared answers, and writers that nothing else covers."""

from pyspark.sql import functions as F

from loomery.functions import text as T
from loomery.operators import pairs as P
from loomery.sources import sinks


def test_sanitized_replies(spark):
    cases = {
        "fine answer": "fine answer",
        "answer User: next question": "answer",
        "answer Us": "answer",
        "answer User Assist": "answer",
        "answer Assistant: User": "answer",
        "answer <end> more": "answer",
        "Us": "",
        "bus": "bus",
        "": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "text string")
    assert {r["text"]: r["clean"] for r in df.select("text", T.sanitize_reply(F.col("text"), ("<end>",)).alias("clean")).collect()} == cases


def test_lookup_by_source(spark):
    index = spark.createDataFrame([("what is x", "a", "trained"), ("what is y", "b", "learned")], "key string, assistant string, source string")
    asked = spark.createDataFrame([(1, "What is X?"), (2, "What is Y?")], "qid int, typed string")
    assert {r["qid"]: r["assistant"] for r in P.lookup(asked, index).collect()} == {1: "a", 2: "b"}
    assert {r["qid"]: r["assistant"] for r in P.lookup(asked, index, "trained").collect()} == {1: "a", 2: None}


def test_questions_of_shared_answers(spark):
    rows = spark.createDataFrame([(1, "What is A?", "One."), (2, "What is B?", "one"), (3, "what is a", "One"), (4, "What is C?", "two")], "ord long, user string, assistant string")
    assert {tuple(r) for r in P.sharing_questions(rows).select("answer", "question").collect()} == {("one", "what is a"), ("one", "what is b")}


def test_pair_files_and_domains(spark, tmp_path):
    pairs = spark.createDataFrame([("q 1", "a 1", "places"), ("q 2", "a 2", "people")], "user string, assistant string, domain string")
    sinks.pair_files(pairs, f"{tmp_path}/native", f"{tmp_path}/records")
    assert {r[0] for r in spark.read.text(f"{tmp_path}/native").collect()} == {"User: q 1 Assistant: a 1", "User: q 2 Assistant: a 2"}
    assert {(r["query"]["user"], r["response"]["assistant"]) for r in spark.read.json(f"{tmp_path}/records").collect()} == {("q 1", "a 1"), ("q 2", "a 2")}
    sinks.by_domain(pairs, f"{tmp_path}/domains")
    assert spark.read.parquet(f"{tmp_path}/domains/domain=people").first()["user"] == "q 2"
    sinks.append_json(pairs.limit(1), f"{tmp_path}/log")
    sinks.append_json(pairs.limit(1), f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 2


def test_remember_only_new_keys(spark, tmp_path):
    index = spark.createDataFrame([("what is x",)], "key string")
    learned = spark.createDataFrame([(1, "What is X?", "old"), (2, "What is Y?", "first"), (3, "what is y", "second"), (4, "", "none")], "ord long, user string, assistant string")
    sinks.remember(index, learned, f"{tmp_path}/learned")
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/learned").select("key", "assistant").collect()] == [("what is y", "first")]
