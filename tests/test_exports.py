"""Exports of any schema, artefacts, decisions, fixtures, datasets and shard listings on small files."""

import json

import pytest
from pyspark.sql import functions as F

from loomery.sources import exports as X
from loomery.sources import tables as T


def test_ragged_exports(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"step": 1, "loss": 2.5, "lr": "0.1,"}\n{"step": 0, "loss": 9}\nnot json\n{"step": "2", "loss": "nan", "deep": {"x": 1}}\n{"loss": 3}\n')
    (tmp_path / "b.csv").write_text("step,avg_loss,grad_norm\n1,3.5,\n0,1,1\nx,1,1\n2,4.5\n3,none,7\n")
    (tmp_path / "c.csv").write_text('"step","tok_s"\n5,60\n')
    rows = X.structured(spark, str(tmp_path))
    assert {"file", "ord", "step", "loss", "lr", "deep", "avg_loss", "grad_norm", "tok_s"} == set(rows.columns)
    got = {(r["file"], r["step"]): (r["loss"], r["lr"], r["avg_loss"], r["grad_norm"], r["tok_s"]) for r in rows.collect()}
    assert got == {("a.jsonl", 1): (2.5, 0.1, None, None, None), ("a.jsonl", 2): (None, None, None, None, None), ("b.csv", 1): (None, None, 3.5, None, None), ("b.csv", 2): (None, None, 4.5, None, None), ("b.csv", 3): (None, None, None, 7.0, None), ("c.csv", 5): (None, None, None, None, 60.0)}
    assert {(r["file"], r["loss"]) for r in X.losses(rows).collect()} == {("a.jsonl", 2.5), ("b.csv", 3.5), ("b.csv", 4.5)}
    assert {(r["file"], r["step"]) for r in X.structured(spark, str(tmp_path), last=1).collect()} == {("a.jsonl", 2), ("b.csv", 3), ("c.csv", 5)}


def test_logs_are_preferred(spark):
    logs = spark.createDataFrame([("a", 1.0)], "run string, loss double")
    exports = spark.createDataFrame([("a", 9.0), ("b", 2.0)], "run string, loss double")
    assert {tuple(r) for r in X.preferred(logs, exports, "run").collect()} == {("a", 1.0), ("b", 2.0)}


def test_stage_table_skips_what_is_missing(spark, tmp_path):
    (tmp_path / "stage31_baseline.json").write_text(json.dumps({"runtime": {"tokens_per_sec": 586, "step_ms": 1.5}, "quality": {"train_loss": 0.9}}))
    (tmp_path / "stage32_kv_generate.json").write_text("{broken")
    (tmp_path / "stage35_fp16_storage.json").write_text(json.dumps({"parity_ok": True, "cast_path": "device"}))
    (tmp_path / "stage34_activation_account.json").write_text(json.dumps({"parameter_mb": 3}))
    got = [tuple(r)[1:] for r in X.stage_table(spark, str(tmp_path)).collect()]
    assert got == [("3.1 train", "586", "1.5", None, "0.9"), ("3.4 activations", None, None, None, "3"), ("3.5 FP16 storage", None, None, "true", None), ("3.10 FP16 device cast", "device", "true", None, None)]


def test_decisions_fixture_timeline(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text("\n".join(json.dumps({"step": i, "val_loss": i / 2}) for i in range(100)) + "\n{bad\n")
    got = X.decisions(spark, str(tmp_path / "d.jsonl")).orderBy("ord").collect()
    assert len(got) == 79 and got[0]["record"] == {"step": "21", "val_loss": "10.5"} and got[-1]["record"]["step"] == "99"
    (tmp_path / "f.jsonl").write_text('{"query": "q1", "intent": "trained", "canonical": "c"}\n\n{"intent": "x"}\n{"query": ""}\n')
    assert [tuple(r) for r in X.fixture(spark, str(tmp_path / "f.jsonl")).collect()] == [("q1", "trained", "c")]
    (tmp_path / "bad.jsonl").write_text("{oops\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        X.fixture(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "t.jsonl").write_text('{"pool": "a", "event": "alloc", "key": "w", "nbytes": 5}\n{"pool": "a", "event": "clear"}\n')
    assert [(r["event"], r["nbytes"]) for r in X.timeline(spark, str(tmp_path / "t.jsonl")).orderBy("ord").collect()] == [("alloc", 5), ("clear", None)]


def test_lines_follow_the_paths(spark, tmp_path):
    for name, text in (("b.txt", "3\n\n 4 \n"), ("a.txt", "1\n2"), ("c.log", "no"), ("z.txt", "5\n")):
        (tmp_path / name).write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3b")
    try:
        rows = T.corpus(spark, str(tmp_path)).repartition(3).orderBy("ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["text"] for r in rows] == ["1", "2", "3", "4", "5"]
    (tmp_path / "bytes.log").write_bytes(b"ok \xff\xfe\n")
    assert T.lines(spark, str(tmp_path / "bytes.log")).first()["text"].startswith("ok")


def test_empty_corpora_are_errors(spark, tmp_path):
    (tmp_path / "e.txt").write_text("\n \n")
    with pytest.raises(ValueError, match="no text"):
        T.corpus(spark, str(tmp_path))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.log").write_text("a")
    with pytest.raises(ValueError, match="no text files"):
        T.corpus(spark, str(tmp_path / "sub"))


def test_resolver_order(spark, tmp_path):
    (tmp_path / "one.txt").write_text("from one\n")
    (tmp_path / "two.txt").write_text("from two\n")
    get = lambda **c: [r["text"] for r in T.resolve(spark, c, str(tmp_path)).orderBy("ord").collect()]
    assert get(corpus=["x", "y"], path="nowhere", combine=True) == ["x", "y"]
    assert get(path=str(tmp_path / "two.txt"), combine=True) == ["from two"]
    assert get(path=str(tmp_path), combine=True) == get(name="data_dir") == ["from one", "from two"]
    assert get(path=str(tmp_path), name="one") == get(name="one") == ["from one"]
    assert get() == list(T.BUILTIN["minimal"]) and get(name="tiny_code") == list(T.BUILTIN["tiny_code"])
    with pytest.raises(ValueError, match="unknown dataset"):
        get(name="none")


def test_catalog_previews(spark, tmp_path):
    (tmp_path / "a.txt").write_text("A  first\n\nline " + "x" * 200)
    r = T.catalog(spark, str(tmp_path)).first()
    assert r["name"] == "a" and r["preview"] == ("A first line " + "x" * 200)[:90] and r["length"] == 215


def test_shard_listing(spark):
    files = spark.createDataFrame([("d/train-01.parquet",), ("d/Validation-0.parquet",), ("d/readme.md",), ("d/train-00.parquet",), ("d/test-0.parquet",)], "path string")
    assert [tuple(r) for r in T.split_shards(files).collect()] == [("d/Validation-0.parquet", "valid"), ("d/train-00.parquet", "train"), ("d/train-01.parquet", "train")]
    with pytest.raises(ValueError, match="incomplete: train only"):
        T.split_shards(files.filter(F.contains(F.col("path"), F.lit("train"))))


def test_mixed_train_lines(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"text": "prose"}\n{"query": {"user": "q"}, "response": {"assistant": "a"}, "text": " own "}\n{"user": "q", "assistant": "a"}\n{"other": 1}\nplain\n')
    assert [r["text"] for r in T.train_lines(spark, str(tmp_path / "m.jsonl")).orderBy("ord").collect()] == ["prose", "own", "User: q Assistant: a"]


def test_quarantine_of_unreadable_files(spark, tmp_path):
    (tmp_path / "q.json").write_text('["What is  X?", ""]')
    (tmp_path / "bad.json").write_text("{oops")
    assert [r["key"] for r in T.quarantine(spark, str(tmp_path / "q.json")).collect()] == ["what is x"]
    assert T.quarantine(spark, str(tmp_path / "bad.json")).count() == T.quarantine(spark, str(tmp_path / "none.json")).count() == 0
