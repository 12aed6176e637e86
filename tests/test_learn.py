from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from strandline.operators import learn as L


@pytest.fixture
def rows(spark):
    """Rows of a session that has observed a query, as most operators with intermediate tables do."""
    seen = Observation()
    spark.range(3).observe(seen, F.count("*").alias("n")).collect()
    assert seen.get["n"] == 3
    rng = np.random.default_rng(4)
    return spark.createDataFrame([(i % 3, float(x), int(x + rng.normal() > 0)) for i, x in enumerate(rng.normal(size=90))], "dataset int, x double, y int")


def _fit(x, y, c):
    """Weight and intercept of the logistic regression with a penalty of w * w / (2 * c), by Newton's steps."""
    z, w = np.stack([x, np.ones(len(x))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag([1 / c, 0]), z.T @ (p - y) + np.array([w[0] / c, 0]))
    return w


def test_groups_left_out_equal_loops(rows):
    local = np.array([tuple(r) for r in rows.collect()])
    found = {r["dataset"]: r for r in L.leave_one_out(rows, "dataset", ["x"], "y").collect()}
    assert sorted(found) == [0, 1, 2]
    for g in found:
        train, test = local[local[:, 0] != g], local[local[:, 0] == g]
        w = _fit(train[:, 1], train[:, 2], 1.0)
        score, label = test[:, 1] * w[0] + w[1], test[:, 2]
        wins = np.mean([[1.0 if a > b else 0.5 if a == b else 0.0 for b in score[label == 0]] for a in score[label == 1]])
        ranked = label[np.argsort(-score)]
        ap = np.mean((np.cumsum(ranked) / np.arange(1, len(ranked) + 1))[ranked == 1])
        assert found[g]["auc"] == pytest.approx(wins) and found[g]["ap"] == pytest.approx(ap)


def test_probabilities_equal_loops(rows):
    local = np.array([tuple(r) for r in rows.collect()])
    for scale in (False, True):
        scored = [(r["dataset"], r["x"], r["p"]) for r in L.out_of_fold(rows, ["x"], "y", "dataset", 3, 0.1, scale).collect()]
        assert len(scored) == 90
        for g in range(3):
            train = local[local[:, 0] != g]
            mean, std = (train[:, 1].mean(), train[:, 1].std(ddof=1)) if scale else (0.0, 1.0)
            w = _fit((train[:, 1] - mean) / std, train[:, 2], 0.1)
            for dataset, x, p in scored:
                assert dataset != g or p == pytest.approx(1 / (1 + np.exp(-(w[0] * (x - mean) / std + w[1]))), abs=1e-4)


def test_best_c_of_group_folds_equals_loops(rows):
    folded = L.hashed_folds(rows.withColumn("group", F.floor(F.col("x") * 7)), ["group"], 2, 42)
    local = np.array([(r["x"], r["y"], r["fold"]) for r in folded.collect()])
    expected = {}
    for c in (0.001, 10.0):
        hits = []
        for f in range(2):
            train, test = local[local[:, 2] != f], local[local[:, 2] == f]
            mean, std = train[:, 0].mean(), train[:, 0].std(ddof=1)
            w = _fit((train[:, 0] - mean) / std, train[:, 1], c)
            hits.append(np.mean((w[0] * (test[:, 0] - mean) / std + w[1] >= 0) == test[:, 1]))
        expected[c] = np.mean(hits)
    found = L.group_probe(rows.withColumn("group", F.floor(F.col("x") * 7)), "group", ["x"], "y", (0.001, 10.0), 2).first()
    best = max(expected, key=expected.get)  # the first of equals
    assert found["c"] == best and found["accuracy"] == pytest.approx(expected[best])


def test_even_odds_are_class_0(spark):
    of = {r["fold"]: r["group"] for r in L.hashed_folds(spark.range(20).toDF("group"), ["group"], 2, 42).collect()}
    both = [(g, x, y) for g in of.values() for x, y in ((-1.0, 0), (1.0, 1))]
    odds = spark.createDataFrame([*both, (of[1], 0.0, 0)], "group long, x double, y int")  # in the middle of what fold 0 has
    assert L.group_probe(odds, "group", ["x"], "y", (100.0,), 2).first()["accuracy"] == 1.0


@pytest.mark.parametrize("hits", [[(1, 2, 3), (2, 1, 3), (2, 3, 1)], [(2, 1, 3), (2, 3, 1), (1, 2, 3)], [(2, 3, 1), (1, 2, 3), (2, 1, 3)]])
def test_first_c_of_equals_in_any_order_of_folds(rows, monkeypatch, hits):
    """Sums of 0.1, 0.2 and 0.3 differ in the last digit by their order, so the least of them comes first once."""
    tenths = rows.sparkSession.createDataFrame([(f, k, 1) for f in range(3) for k in range(10)], "fold int, k int, y int")

    def scored(folded, features, label, fold, k, c, scale):
        return tenths.withColumn("p", (F.col("k") < F.element_at(F.array(*map(F.lit, hits[int(c)])), F.col("fold") + 1)).cast("double"))

    monkeypatch.setattr(L, "out_of_fold", scored)
    found = L.group_probe(rows, "dataset", ["x"], "y", (0.0, 1.0, 2.0), 3).first()
    assert found["c"] == 0.0 and found["accuracy"] == pytest.approx(0.2)
