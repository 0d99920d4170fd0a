"""Tokens, evaluation labels and streams on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from loomery.operators import evaluation as E
from loomery.operators import runs as R
from loomery.operators import tokens as K
from loomery.streaming import streams as S


def test_pieces_follow_ranks():
    ranks = {("a", "b"): 0, ("ab", "c"): 1, ("c", "c"): 2}
    assert K.pieces_of("abcc", ranks) == ["abc", "c"]
    assert K.pieces_of("xcc", ranks) == ["x", "cc"]
    assert K.pieces_of("", ranks) == []


def test_ids_equal_the_vocabulary_s_own_encoder(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = "/opt/tokenizers/byte_bpe_50k.json"
    odd = ["", " ", "the cat  the\n\n hat", "x" * 5000, "don't we'll", "Straße 東京 😀😀 naïve", "a b\t\tc ", "12345 6.7e8 !!??", "ab" * 700 + " ba"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate([*odd, None])], "doc_id long, text string"))
    own = tokenizers.Tokenizer.from_file(path)
    own.encode_special_tokens = True
    want = {r["doc_id"]: own.encode(r["text"] or "", add_special_tokens=False).ids for r in docs.collect()}
    assert {r["doc_id"]: list(r["ids"]) for r in K.encode(docs, K.read_merges(path)).collect()} == want


def test_learned_keys_outlive_a_batch(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    index = spark.createDataFrame([("old",)], "key string")
    schema = "user string, assistant string"
    for pairs in ([("New?", "a"), ("new", "b"), ("Old?", "c")], [("NEW", "d"), ("Other?", "e"), ("", "f")]):
        spark.createDataFrame(pairs, schema).coalesce(1).write.mode("append").parquet(source)
        S.learned(spark.readStream.schema(schema).parquet(source), index, store, str(tmp_path / "offsets")).awaitTermination()
    assert sorted((r["key"], r["batch"]) for r in spark.read.parquet(store).collect()) == [("new", 0), ("other", 1)]


def test_special_tokens_and_unknown_characters(spark, tmp_path):
    vocab = spark.createDataFrame([(" ", 0), ("a", 1), ("é", 2)], "ch string, id int")
    twice = K.add_special(K.add_special(vocab, "<eos>"), "<eos>")
    assert {(r["ch"], r["id"]) for r in twice.collect()} == {(" ", 0), ("a", 1), ("é", 2), ("<eos>", 3)}
    row = spark.createDataFrame([("aé😀 a",)], "text string").select(K.encoder(vocab)(F.col("text")).alias("ids")).select("ids", K.decoder(vocab)(F.col("ids")).alias("back")).first()
    assert (row["ids"], row["back"]) == ([1, 2, 0, 1], "aé a")
    K.save_vocabulary(vocab, str(tmp_path / "v"))
    assert K.load_vocabulary(spark, str(tmp_path / "v"))[0] == "char"


def test_router_labels(spark):
    rows = [(1, "cabinet", "k", "trained", "K?"), (2, "miss", None, "trained", None), (3, "cabinet", "k", "miss", None), (4, "search", None, "search_or_miss", None), (5, "cabinet", "k", "trained", "other"), (6, "miss", None, None, None)]
    got = E.label_routes(spark.createDataFrame(rows, "qid int, kind string, key string, intent string, canonical string"))
    assert [r["label"] for r in got.orderBy("qid").collect()] == ["ROUTE_OK", "ROUTER_FALSE_MISS", "ROUTER_FALSE_HIT", "ROUTE_OK", "ROUTER_FALSE_MISS", "UNLABELED"]


def test_gate_reasons(spark):
    rows = [(1, None, 0, 1.0), (2, 1, 0, 1.0), (3, 0, 2, 1.0), (4, 0, 0, 0.5), (5, 0, 0, 1.0)]
    got = {r["run"]: r["reason"] for r in E.gate(spark.createDataFrame(rows, "run int, missed long, swaps long, exact double")).collect()}
    assert got == {1: "missing_anchor_hits", 2: "anchor_miss", 3: "harvested_entity_swaps=2", 4: "harvested_exact", 5: "ok"}


def six(x):
    return None if x is None else round(x, 6)


def record(q, kind="TARGET_MISMATCH"):
    return json.dumps({"typed_question": q, "canonical_question": q, "expected": "x", "classification": kind}) + "\n"


def test_harvest_waits_and_keeps_the_rest(spark, tmp_path):
    source, pending = tmp_path / "in", str(tmp_path / "pending")
    source.mkdir()
    run = lambda: S.pend(S.records(spark, str(source)), pending, str(tmp_path / "offsets")).awaitTermination()
    none = spark.createDataFrame([], "key string")
    (source / "a.jsonl").write_text(record("q1?") + record("q1?") + record("q2?") + record("q3?", "MATCH") + "not json\n")
    run()
    assert S.harvest(spark.read.parquet(pending), none, ready=3).count() == 0
    (source / "b.jsonl").write_text(record("q4?") + record("q5?") + record("q6?"))
    run()
    waiting = spark.read.parquet(pending)
    first = [r["key"] for r in S.harvest(waiting, none, ready=3, most=3).orderBy("ord").collect()]
    assert first == ["q1", "q2", "q4"]
    done = spark.createDataFrame([(k,) for k in first], "key string")
    assert {r["key"] for r in S.harvest(waiting, done, ready=2).collect()} == {"q5", "q6"}


def test_live_runs_carry_state_between_batches(spark, tmp_path):
    rows = [("a", i, i % 9, None if i % 5 == 4 else float((i * 7) % 11 + 1)) for i in range(24)]
    schema = "file string, ord long, step long, loss double"
    source = str(tmp_path / "rows")
    for part in (rows[:10], rows[10:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    got = {(r["run"], r["ord"], r["action"], six(r["ema"])) for r in S.drain(S.live_runs(stream, max_steps=7), "t").collect()}
    runs = R.segments(spark.createDataFrame(rows, schema))
    ema = {(r["run"], r["ord"]): six(r["ema"]) for r in R.ema(runs, 0.3).collect()}
    assert got == {(r["run"], r["ord"], r["action"], ema[r["run"], r["ord"]]) for r in R.decide(runs, max_steps=7).collect()}


def test_diagnostics_go_to_both_sinks(spark, tmp_path):
    source, paths = str(tmp_path / "in"), [str(tmp_path / n) for n in ("all", "retrain", "offsets")]
    spark.createDataFrame([("Who invented X?", "ann."), ("who invented x", "Bob"), ("unknown", "?")], "typed string, generated string").write.parquet(source)
    facts = spark.createDataFrame([(1, "Who invented X?", "Ann"), (2, "who invented x", "Ann")], "ord long, user string, assistant string")
    S.diagnose(spark.readStream.schema("typed string, generated string").parquet(source), facts, *paths).awaitTermination()
    assert (spark.read.parquet(paths[0]).count(), [r["generated"] for r in spark.read.parquet(paths[1]).collect()]) == (2, ["Bob"])
