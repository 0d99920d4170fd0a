"""The pipeline's stages against brute force and on odd tables, and the whole of it."""

import pytest
from pyspark.sql import functions as F
from test_similar import brute

from loomery.llm import decontamination, language_id
from loomery.llm.common import table

D = "/root/testdata/sf0.001"
#: Column names that operators use themselves.
ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, tokens int, rate string, copies int, component int, _th long, shard int, n_hit int"
BENCHMARK = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


@pytest.fixture(scope="module")
def odd(spark):
    long = "the quick brown fox jumps over lazy dogs all day long and never sleeps " * 2000
    texts = [None, "", "...", f"some words {BENCHMARK} more", "la casa de los niños es muy grande y bonita", long, "É é K k İ", "\x00 a\tb", "hello world this is fine text"]
    extra = (42.0, "mine", 7, "r", 9, 5, 6, 3, 1)
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", None, *extra) for i, t in enumerate(texts)]
    more = [(8, "a text of its own under a repeated id", None, None, None, *extra), (None, "no id here", "de", "s", 1, *extra), (None, f"nor here {BENCHMARK}", "en", "s", 1, *extra)]
    return spark.createDataFrame([*rows, rows[8], *more], ODD)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(1, BENCHMARK)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(None, 1, 0), (5, None, 1), (4, 1, 0), (999, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages_keep_the_right_rows_of_odd_tables(spark, odd, folder):
    import corpus_pipeline as p

    whole = sorted(map(str, odd.collect()))
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, odd, folder)
        rows = out.collect()
        assert out.columns == odd.columns and set(map(str, rows)) <= set(whole), name
        ids = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in rows)
        if name == "simhash_dedup":
            assert len(rows) == len(ids) == len(whole) - 2 and (False, 8, "a text of its own under a repeated id") in ids  # the repeated row and one of null and empty go
        if name == "decontamination":
            assert len(rows) == len(whole) - 2 and not any(BENCHMARK in t for _, _, t in ids)
    assert p.shard_stage(spark, odd, folder).count() == len(whole)
    for _, stage in p.STAGES:
        assert stage(spark, odd.limit(0), folder).count() == 0


def test_pipeline_against_brute_force(spark):
    """Each stage of ``run`` on all documents, by plain loops over what the stage before kept."""
    import corpus_pipeline as p

    ran = {r["doc_id"]: r for r in p.run(spark, D).collect()}
    docs = table(spark, D, "documents")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language_id.train(docs, ~held)
    left = sorted(i for i, t in text.items() if language_id.predict_text(model, t)[1] >= p.LEAST_LANGUAGE_SCORE)
    root = brute([text[i] for i in left])[1]
    left = [left[i] for i, r in enumerate(root) if i == r]
    sets = [set(zip(*[w[i:] for i in range(10)], strict=False)) for w in (words(r["text"]) for r in table(spark, D, "benchmark").collect())]
    windows = set().union(*sets)
    left = [i for i in left if windows.isdisjoint(zip(*[words(text[i])[k:] for k in range(10)], strict=False))]
    mixed = p.mix_stage(spark, docs.filter(F.col("doc_id").isin(left)), D)
    assert set(ran) == {r["doc_id"] for r in mixed.collect()} and len(ran) > 0.5 * len(text)
    counts = [sum(r["shard"] == s for r in ran.values()) for s in range(16)]
    assert max(counts) - min(counts) <= 1


def words(t):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def test_decontamination_is_by_text(spark, odd):
    bench = spark.createDataFrame([(1, BENCHMARK)], "item_id long, text string")
    assert decontamination.decontaminate(odd, bench).filter("contaminated").count() == 2
