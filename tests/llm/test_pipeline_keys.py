"""Pipeline stages on tables with null and repeated ids."""

BENCHMARK = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
A = "one two three four five six seven eight nine ten eleven twelve"
B = "red orange yellow green blue indigo violet black white grey pink brown"
C = "jan feb mar apr may jun jul aug sep oct nov dec"


def kept(stage, spark, rows, where=""):
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    out = stage(spark, docs, where)
    assert out.columns == docs.columns
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in out.collect())


def test_dedup_of_null_and_repeated_ids(spark):
    import corpus_pipeline as p

    rows = [(None, A), (None, A), (None, B), (1, C), (2, C), (2, "a text of its own that must stay"), (None, C), (7, "same row"), (7, "same row"), (7, "another row with that id")]
    want = [(False, 1, C), (False, 2, "a text of its own that must stay"), (False, 7, "another row with that id"), (False, 7, "same row"), (True, 0, A), (True, 0, B)]
    assert kept(p.dedup_stage, spark, rows) == sorted(want)


def test_decontamination_of_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([(1, BENCHMARK)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"x {BENCHMARK} y"), (None, A), (3, f"z {BENCHMARK}"), (3, B), (4, C), (4, C)]
    assert kept(p.decontaminate_stage, spark, rows, str(tmp_path)) == sorted([(True, 0, A), (False, 3, B), (False, 4, C), (False, 4, C)])


def test_few_and_many_dropped_keys_agree(spark, monkeypatch):
    """Broadcast keys and shuffled ones drop the same rows; few of them shuffle no text."""
    import corpus_pipeline as p

    rows = [(i % 40 if i % 7 else None, f"{'same words of one long text ' * 3}{i % 11}", i) for i in range(120)] + [(200, None, 1), (None, None, 2), (201, "", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    few = p.dedup_stage(spark, docs, "")
    assert "SortMergeJoin" not in few._jdf.queryExecution().optimizedPlan().toString() and "strategy=broadcast" in few._jdf.queryExecution().optimizedPlan().toString()
    kept = sorted((r["doc_id"], r["text"]) for r in few.filter("doc_id is not null and text is not null").collect())
    n = few.count()
    monkeypatch.setattr(p, "FEW_KEYS", 0)
    many = p.dedup_stage(spark, docs, "")
    assert kept == sorted((r["doc_id"], r["text"]) for r in many.filter("doc_id is not null and text is not null").collect()) and n == many.count() < 123
