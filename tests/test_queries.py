"""Every query with SQL against DuckDB on the smallest tables, and golden cases of the text functions."""

import duckdb
import pytest
from pyspark.sql import functions as F

from loomery import registry
from loomery.functions import text as T
from loomery.operators import corpus as C
from loomery.operators import pairs as P
from loomery.sources import sinks, tables

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v) if v is None or isinstance(v, bool) else str(int(v)) if not isinstance(v, str) and hasattr(v, "__int__") else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = registry.queries()[name](spark, D)
    cols = sorted(df.columns)
    r = duck.sql(registry.oracle_sql()[name])
    names = list(r.columns)
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert sorted(tuple(norm(x[c]) for c in cols) for x in df.collect()) == sorted(tuple(norm(x[i]) for i in at) for x in r.fetchall())


def test_conflicts_vanish(spark):
    rows = [(1, "Where is Kashmir?", "India"), (2, "Where is Kashmir?", "Pakistan"), (3, "What is Oxygen?", "A gas."), (4, "what is oxygen?", "a gas")]
    assert [r["ord"] for r in P.drop_conflicts(spark.createDataFrame(rows, "ord long, user string, assistant string")).collect()] == []


def test_keys(spark):
    one = spark.createDataFrame([("User:  What is  Straße? Assistant: x", "It's: A b.")], "q string, a string")
    r = one.select(T.question_key(F.col("q")).alias("q"), T.answer_key(F.col("a")).alias("a")).first()
    assert (r["q"], r["a"]) == ("what is strasse", "it s a b")


def test_windows_end_with_the_story(spark):
    w = C.windows(spark.createDataFrame([(1, 3), (2, 6), (3, 1)], "doc_id long, n_tokens long"), 4, 128).orderBy("doc_id", "start").collect()
    assert [(r["doc_id"], r["start"], r["width"]) for r in w] == [(1, 0, 3), (2, 0, 5), (2, 1, 5)]


def test_offsets_of_sparse_ids(spark):
    ids = [None, *range(50), *(10**12 + i * i for i in range(50)), 7, 7]
    docs = spark.createDataFrame([(i, n % 5) for n, i in enumerate(ids)], "doc_id long, n long")
    got = C.offsets(docs, F.col("n")).collect()
    assert len(got) == len(ids) and sum(r["stop"] - r["start"] + 1 for r in got) == sum(n % 5 + 1 for n in range(len(ids)))
    starts = sorted((r["start"], r["stop"], -1 if r["doc_id"] is None else r["doc_id"]) for r in got)
    assert all(a[1] + 1 == b[0] and a[2] <= b[2] for a, b in zip(starts, starts[1:], strict=False))
    assert C._numbered(docs.limit(0)).count() == 0


def test_glued_json(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"user": "a", "assistant": "b"}{"query": {"user": "c"}, "response": {"assistant": "d"}}\nnot json\n')
    assert {(r["user"], r["assistant"]) for r in tables.pairs(spark, str(tmp_path / "a.jsonl")).collect()} == {("a", "b"), ("c", "d")}


def test_text_shard_counts(spark, tmp_path):
    assert sinks.text_shard(spark.createDataFrame([("a  b",), (" ",), ("“c”",)], "text string"), str(tmp_path / "out")) == 2
