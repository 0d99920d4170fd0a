"""Growing files: half lines, rotation, truncation and split parts; the start gate as batch and stream."""

import os
import random

import pytest
from pyspark.sql import functions as F

from loomery.streaming import cursor as C
from loomery.streaming import starts as G
from loomery.streaming import streams as S


class Follow:
    """A cursor as one query drives it: batch after batch, the end of one the start of the next."""

    def __init__(self, folder, **options):
        self.reader = C.CursorReader({"path": str(folder), **options})
        self.at = self.reader.initialOffset()

    def batch(self):
        end = self.reader.latestOffset()
        lines = [x for p in self.reader.partitions(self.at, end) for b in self.reader.read(p) for x in b.column("line").to_pylist()]
        self.at = end
        return lines


def put(path, text, mode="ab"):
    with open(path, mode) as f:
        f.write(text.encode())


def test_only_complete_lines(tmp_path):
    f = Follow(tmp_path)
    assert f.batch() == []
    put(tmp_path / "a", "one\ntwo\nthr")
    assert f.batch() == ["one", "two"] and f.batch() == []
    put(tmp_path / "a", "ee\n\n  \nfour")
    assert f.batch() == ["three"]
    put(tmp_path / "a", "\n")
    put(tmp_path / "b", "other\r\n")
    assert sorted(f.batch()) == ["four", "other"]


def test_rotation_restarts(tmp_path):
    f = Follow(tmp_path, pattern="*.log")
    put(tmp_path / "x.log", "old 1\nold 2\n")
    assert f.batch() == ["old 1", "old 2"]
    os.rename(tmp_path / "x.log", tmp_path / "x.log.1")
    put(tmp_path / "x.log", "new 1\nnew 2\nnew 3 is longer than all before\n")
    assert f.batch() == ["new 1", "new 2", "new 3 is longer than all before"]


def test_truncation_clamps(tmp_path):
    f = Follow(tmp_path)
    put(tmp_path / "x", "one\ntwo\nthree\n")
    assert len(f.batch()) == 3
    os.truncate(tmp_path / "x", 6)  # within the second line
    assert f.batch() == []
    put(tmp_path / "x", "rest\nfour\n")
    assert f.batch() == ["rest", "four"]  # nothing of what was read before comes again
    os.truncate(tmp_path / "x", 0)
    assert f.batch() == []
    put(tmp_path / "x", "anew\n")
    assert f.batch() == ["anew"]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64])
def test_parts_cover_every_line_once(tmp_path, size):
    rng = random.Random(size)
    lines = ["é" * rng.randrange(1, 12) + str(i) for i in range(40)]
    put(tmp_path / "x", "\n".join(lines) + "\npart of a li")
    assert Follow(tmp_path, partbytes=str(size)).batch() == lines


def test_remote_folders_are_refused():
    with pytest.raises(ValueError, match="mounted"):
        C.local_path("s3://bucket/logs")


def test_stream_of_records(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()

    def run():
        stream = C.growing_records(spark, str(logs), "q string, n int")
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/rows").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted(((r["q"] or "", r["n"]) for r in spark.read.schema("q string, n int").parquet(f"{tmp_path}/rows").collect()))

    put(logs / "a.jsonl", '{"q": "x", "n": 1}\nnot json\n[1, 2]\n{"q": "broken"\n{"q": "y", "n"')
    assert run() == [("x", 1)]
    put(logs / "a.jsonl", ": 2}\n")
    put(logs / "b.jsonl", '{"n": 3}\n')
    put(logs / "c.txt", '{"q": "other pattern"}\n')
    assert run() == [("", 3), ("x", 1), ("y", 2)]


def test_gate_rules():
    g = G.Gate(300, 3600, 2)
    assert [g.take(0, "start"), g.take(10, "start"), g.take(20, "start")] == [(True, None), (True, None), (False, "max_starts_per_hour")]
    assert g.take(3601, "start") == (True, None) and g.starts == [10, 3601]
    g.take(4000, "fail")
    assert g.take(4299, "start") == (False, "backoff") and g.take(4300, "start") == (True, None)
    for t in (5000, 5001, 5002, 5003, 5004):
        g.take(t, "fail")
    assert g.until == 5004 + 3600 and g.failures == 6
    g.take(5005, "ok")
    assert g.failures == 0 and g.take(9000, "start") == (True, None)
    assert G.Gate(300, 3600, -1).take(0, "start") == (True, None) and G.Gate(300, 3600, 0).take(0, "start") == (False, "max_starts_per_hour")


def test_stream_in_many_batches_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    rows, t = [], 0.0
    for i in range(400):
        t += rng.expovariate(1 / 300)
        rows.append((f"k{rng.randrange(4)}", i, t, rng.choice(["start", "start", "fail", "ok"])))
    df = spark.createDataFrame(rows, "key string, ord long, s double, outcome string").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    for low in range(0, 400, 100):
        df.filter((F.col("ord") >= low) & (F.col("ord") < low + 100)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in")
        got = S.drain(G.allowed_starts(stream), "starts-test").collect()
    finally:
        spark.conf.unset(name)
    want = G.allowed_starts_batch(df).collect()
    take = lambda rows: sorted((r["key"], r["ord"], r["allowed"], r["reason"] or "", r["failures"], r["starts"]) for r in rows)
    assert take(got) == take(want) and len(want) > 100


def test_reasons_of_poison(spark, tmp_path):
    rows = [(1, 1, "gate_fail", "a"), (1, 2, "gate_fail", "b"), (1, 3, "promoted", ""), (2, 1, "crash", "segv"), (2, 2, "promoted", "x"), (2, 3, "crash", "oom")]
    spark.createDataFrame(rows, "key long, ord long, outcome string, reason string").coalesce(1).write.parquet(f"{tmp_path}/o")
    got = S.drain(S.key_states(spark.readStream.schema("key long, ord long, outcome string, reason string").parquet(f"{tmp_path}/o")), "reasons")
    assert {(r["key"], r["ord"]): (r["poison"], r["reason"]) for r in got.collect()} == {(1, 1): (False, None), (1, 2): (True, "gate:b"), (1, 3): (False, None), (2, 1): (True, "segv"), (2, 2): (False, None), (2, 3): (True, "oom")}
