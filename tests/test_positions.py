from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import metrics as M
from strandline.operators.learn import hashed_folds
from strandline.operators.perturb import draw_negatives
from strandline.operators.positions import numbered, numbered_values


def test_values_are_numbered_in_order(spark):
    rows = [(f"k{i * 7 % 101:03d}",) for i in range(300)] + [(None,)]
    out = {r["v"]: r["n"] for r in numbered_values(spark.createDataFrame(rows, "v string"), "v", "n").collect()}
    assert out == {v: k for k, v in enumerate(sorted({r[0] for r in rows} - {None}))}
    assert numbered_values(spark.createDataFrame([], "v string"), "v", "n").count() == 0


def test_places_and_running_sums(spark):
    rng = np.random.default_rng(1)
    rows = [("a" if rng.random() < 0.8 else None, int(rng.integers(0, 50)), k, int(rng.integers(0, 3))) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, s int, t int, w int")
    found = {(r["g"], r["t"]): (r["place"], r["so_far"]) for r in numbered(df, ["g"], F.floor(F.col("s") / 7), [F.col("s"), F.col("t")], "place", {"so_far": "w"}).collect()}
    assert len(found) == 400
    for g in ("a", None):
        total = 0
        for place, (_, _, t, w) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:3]), 1):
            total += w
            assert found[(g, t)] == (place, total)


def test_strict_rankings_with_odd_scores(spark):
    """NaN is the highest score and null the lowest, as sorts have it."""
    rows = [(float("nan"), 1, 0), (0.5, 0, 1), (0.5, 1, 2), (-3.0, 0, 3), (None, 1, 4), (float("inf"), 0, 5)]
    df = spark.createDataFrame(rows, "s double, y int, t int")
    order = [1, 0, 0, 1, 0, 1]  # labels by falling score, ties by t
    hits = np.cumsum(order)
    assert M.average_precision_positional(df, [], "s", "y", ["t"]).first()["ap"] == pytest.approx(sum(h / (k + 1) for k, (h, y) in enumerate(zip(hits, order)) if y) / 3)
    up = [1, 0, 0, 1, 0, 1]  # null, -3, 0.5 (t=1), 0.5 (t=2), inf, NaN
    assert M.roc_auc_ordinal(df, [], "s", "y", ["t"]).first()["auc"] == pytest.approx((sum(k + 1 for k, y in enumerate(up) if y) - 6) / 9)


def test_classes_are_dealt_evenly(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    counts = {(r["y"], r["fold"]): r["count"] for r in hashed_folds(df, ["id"], 5, 1, stratify="y").groupBy("y", "fold").count().collect()}
    assert counts == {(y, f): (20 if y else 180) for y in (0, 1) for f in range(5)}


def test_too_few_draws_raise(spark):
    items = spark.range(5).select(F.col("id").alias("item"), F.col("id").alias("place"))
    none = spark.createDataFrame([], "id_a long, id_b long")
    assert draw_negatives(items, none, "item", "place", 5, 100, 1).count() == 5
    with pytest.raises(ValueError):
        draw_negatives(items, none, "item", "place", 50, 20, 1)
