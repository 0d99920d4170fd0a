"""Slots of questions by their keys, and the query's plan."""

from pyspark.sql import functions as F

from loomery.functions import text as T
from loomery.plans import pack_queries as Q


def test_a_key_is_made_once(spark):
    found = Q.dirty_gold(spark, "/root/testdata/sf0.001")
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("(?i)^user:") <= 5  # a projection for each pack
    df = spark.createDataFrame([("What is the capital of X?",), ("What is Y's capital?",), ("Which organ system does the lung belong to?",), ("When was Ada born?",), ("Is 7 a prime number?",), ("What is up?",), (None,)], "q string")
    assert [r[0] for r in df.select(T.slot(F.col("q"))).collect()] == ["x", "y", "lung", "ada", "7", "", ""]
