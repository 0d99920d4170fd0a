"""Rates where domains are scarce, where targets are out of reach and where posteriors part nothing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.llm import mixing, queries

CELLS = "tokens long, p_clean double, p_low double, p_toxic double"


def fit(spark, rows):
    found = mixing.fit_rates(spark.createDataFrame(rows, CELLS), queries.WEIGHTS)
    rates = [max(0.0, 1 + sum(p * x for p, x in zip(r[1:], found.pull.values(), strict=True))) for r in rows]
    reached = {d: sum(t * r * p[i] for (t, *p), r in zip(rows, rates, strict=True)) for i, d in enumerate(mixing.DOMAINS)}
    assert all(reached[d] == pytest.approx(found.reached[d], rel=1e-9, abs=1e-6) for d in reached)
    assert all(b < a for a, b in zip(found.objective, found.objective[1:], strict=False))  # the objective falls with each step
    return rates, found


def by_multipliers(rows, goal):
    """The rates nearest to 1 that reach the targets, max(0, 1 + posteriors * multipliers), by damped Newton steps on the multipliers."""
    t, p = np.array([r[0] for r in rows], float), np.array([r[1:] for r in rows])
    x, soft = np.zeros(3), 1e-7 * t.sum() * np.ones(3)
    rate = lambda x: np.maximum(0, 1 + p @ x)
    worth = lambda x: (t * rate(x) ** 2).sum() / 2 - goal @ x + (soft * x * x).sum() / 2
    for _ in range(200):
        r = rate(x)
        g = p.T @ (t * r) - goal + soft * x
        move = np.linalg.solve((p * (t * (r > 0))[:, None]).T @ p + np.diag(soft), g)
        size = 1.0
        while worth(x - size * move) > worth(x) - 1e-4 * size * (g @ move) and size > 1e-9:
            size /= 2
        x = x - size * move
    return rate(x)


def test_scarce_domains_do_not_shrink_the_clean(spark):
    rates, found = fit(spark, [(96_100_000, 0.98, 0.01, 0.01), (1_900_000, 0.1, 0.9, 0.0), (1_900_000, 0.1, 0.0, 0.9)])
    there = 96_100_000 * 0.98 + 380_000 * 1.0
    assert found.target["clean"] == pytest.approx(there) and 0.85 < rates[0] < 1.1 and rates[1] > 5 and found.met
    assert all(abs(found.reached[d] / found.target[d] - 1) < 1e-3 for d in found.target)


def test_targets_are_reached(spark):
    _, found = fit(spark, [(9000, 0.97, 0.02, 0.01), (700, 0.38, 0.6, 0.02), (300, 0.2, 0.2, 0.6), (500, 0.0, 1.0, 0.0)])
    assert found.met and all(abs(found.reached[d] / found.target[d] - 1) < 1e-3 for d in found.target)


def test_rates_are_the_nearest_to_one_that_reach_the_targets(spark):
    rows = [(9000, 0.97, 0.02, 0.01), (700, 0.38, 0.6, 0.02), (300, 0.2, 0.2, 0.6), (5000, 0.05, 0.94, 0.01), (50, 0.6, 0.1, 0.3)]
    rates, found = fit(spark, rows)
    t, p, goal = np.array([r[0] for r in rows], float), np.array([r[1:] for r in rows]), np.array(list(found.target.values()))
    nearest = by_multipliers(rows, goal)
    assert found.met and np.abs(p.T @ (t * nearest) - goal).max() < 5 and min(rates) >= 0
    assert (t * (np.array(rates) - 1) ** 2).sum() <= (t * (nearest - 1) ** 2).sum() * (1 + 2e-2)


def test_rates_of_null_and_repeated_ids_are_rounded_by_their_texts(spark):
    docs = spark.createDataFrame([(None if i % 2 else 7, " ".join(["word"] * (5 + i % 40)) + f" own{i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int")
    rows = mixing.mix(docs, labels, {"clean": 0.5, "low": 0.3, "toxic": 0.2}).withColumn("part", F.col("rate") % 1).filter("part between 0.2 and 0.8").select("copies", "rate").collect()
    whole = [r["copies"] - int(r["rate"]) for r in rows]
    assert not rows or (len(rows) > 20 and 0.1 < sum(whole) / len(whole) < 0.9)


def test_least_squares_without_parted_domains(spark):
    rates, found = fit(spark, [(600, 1 / 3, 1 / 3, 1 / 3), (300, 1 / 3, 1 / 3, 1 / 3)])
    # All domains get the same tokens, which are least wrong at the mean of the targets.
    assert not found.met and found.reached["clean"] == pytest.approx(sum(found.target.values()) / 3, rel=1e-3) and rates[0] == pytest.approx(rates[1])


def test_chosen_keeps_columns_named_like_its_own(spark):
    docs = spark.createDataFrame([(1, "plain words", 7, "mine", 3), (None, None, 8, "yours", 4)], "doc_id long, text string, tokens int, rate string, copies int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, mixing.chosen(docs, labels, queries.WEIGHTS).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)


def test_posteriors_on_held_out_labels(spark):
    """The classifier on labelled documents that it has not counted."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    seen = mixing.mix(docs, labels.filter(~held), queries.WEIGHTS, keep=["doc_id"]).join(labels.filter(held), "doc_id").collect()
    guess = lambda r: max(mixing.DOMAINS, key=lambda d: r[f"p_{d}"])
    truth = lambda r: "toxic" if r["toxic"] else "clean" if r["quality"] else "low"
    for d, least in (("clean", 0.97), ("low", 0.9), ("toxic", 0.6)):
        own = [r for r in seen if truth(r) == d]
        assert sum(guess(r) == d for r in own) >= least * len(own), (d, sum(guess(r) == d for r in own), len(own))
