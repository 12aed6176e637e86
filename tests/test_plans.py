from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import metrics as M
from strandline.operators.comparators import score_pairs
from strandline.plans import rules


def _pairs(spark):
    rng = np.random.default_rng(1)
    x = {i: rng.normal(size=(4, 3)).tolist() for i in range(8)}
    return spark.createDataFrame([(i, j, x[i], x[j], int((i + j) % 3 == 0)) for i in range(8) for j in range(i + 1, 8)], "i int, j int, a array<array<double>>, b array<array<double>>, y int")


def test_order_and_rank(spark):
    assert rules.split_by_order(["dtw", "cosine"]) == (["cosine"], ["dtw"])
    name, larger = rules.rank_key("dtw_alpha5")
    scored = score_pairs(_pairs(spark), "a", "b", ["dtw_alpha5", name]).withColumn("r", F.col(name) if larger else -F.col(name))
    assert M.average_precision(scored, [], "r", "y").first()["ap"] == pytest.approx(M.average_precision(scored, [], "dtw_alpha5", "y").first()["ap"])


def test_mirror(spark):
    half = score_pairs(_pairs(spark), "a", "b", ["chamfer"])
    both = rules.mirrored(half, "i", "j", "chamfer")
    assert both.count() == 56 and both.where("i > j").count() == 28
    with pytest.raises(ValueError):
        rules.mirrored(half, "i", "j", "maxsim")


def test_candidates_first(spark):
    out = rules.candidates_first(_pairs(spark), "i", "j", F.col("j") * 1.0, 2, "a", "b", "dtw")
    assert out.count() == 13 and "dtw" in out.columns  # the last two queries have two and one candidates, the very last none
