"""Pairs are dealt to more tasks the more there are."""

from loomery.operators import pairs as P
from loomery.plans import fact_queries as Q


def test_tasks_grow_with_pairs(spark, monkeypatch):
    monkeypatch.setattr(P, "PAIRS_A_TASK", 10)
    rows = [(i, f"Who invented thing {i % 300}?", f"Bo{i % 300} is credited with inventing thing {i % 300}.") for i in range(400)]
    pairs = spark.createDataFrame(rows, "ord long, user string, assistant string")
    assert P.tasks_for(pairs) == 40
    assert Q.linked(pairs).rdd.getNumPartitions() == 40 and Q.linked(pairs).count() == 900
