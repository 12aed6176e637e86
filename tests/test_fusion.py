from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import fusion as U

GRID = [round(0.05 * k, 2) for k in range(21)]
GALLERY = "query_id long, cand_id long, query_cluster int, cand_cluster int, query_kind int, cand_kind int, sim double, dist double, rel int"


def _gallery(spark, sim, dist, cluster, kind):
    rows = [
        (i, j, int(cluster[i]), int(cluster[j]), int(kind[i]), int(kind[j]), float(sim[i][j]), float(dist[i][j]), int(cluster[i] == cluster[j] and kind[i] == kind[j]))
        for i in range(len(cluster))
        for j in range(len(cluster))
        if i != j
    ]
    return spark.createDataFrame(rows, GALLERY)


def test_endpoints_rank_by_one_score(spark):
    rows = spark.createDataFrame([(0, 1, 0.9, 0.8), (0, 2, 0.2, 0.1), (0, 3, 0.5, 0.4)], "query_id int, cand_id int, sim double, dist double")
    order = lambda alpha: [r["cand_id"] for r in U.fuse(rows, "query_id", "sim", "dist", alpha).orderBy(F.desc("fused")).collect()]
    assert order(1.0) == [1, 3, 2]
    assert order(0.0) == [2, 3, 1]
    with pytest.raises(ValueError):
        U.fuse(rows, "query_id", "sim", "dist", 1.5)


def test_equal_scores_standardise_to_zero_and_infinite_ones_fail(spark):
    rows = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.5)], "q int, c int, s double")
    assert [r["z"] for r in U.zscores(rows, "q", "s", "z").collect()] == [0.0, 0.0]
    bad = spark.createDataFrame([(0, 1, float("inf")), (0, 2, 0.5)], "q int, c int, s double")
    with pytest.raises(Exception, match="non-finite"):
        U.zscores(bad, "q", "s", "z").collect()


@pytest.mark.parametrize("which,expected", [("sim", 1.0), ("dist", 0.0)])
def test_held_out_choice_finds_the_better_score(spark, which, expected):
    cluster, kind = [0, 0, 1, 1, 2, 2], [0] * 6
    good = np.array([[1.0 if a == b else 0.1 * ((i * 7 + j) % 5) for j, b in enumerate(cluster)] for i, a in enumerate(cluster)])
    sim, dist = (good, good) if which == "sim" else (-good, -good)
    out = U.held_out_fusion(_gallery(spark, sim, dist, cluster, kind), [0, 1, 2], GRID).collect()
    assert {r["alpha"] for r in out} == {expected}


def test_nothing_leaks_from_the_held_out_cluster(spark):
    rng = np.random.RandomState(7)
    cluster, kind = np.repeat([0, 1, 2], 3), np.zeros(9, int)
    sim, dist = rng.rand(9, 9), rng.rand(9, 9)
    first = {r["fold"]: r["alpha"] for r in U.held_out_fusion(_gallery(spark, sim, dist, cluster, kind), [0, 1, 2], GRID).collect()}
    sim2, dist2 = sim.copy(), dist.copy()
    held = cluster == 0
    for m in (sim2, dist2):
        m[held, :] = rng.rand(held.sum(), 9) * 50
        m[:, held] = rng.rand(9, held.sum()) * 50
    second = {r["fold"]: r["alpha"] for r in U.held_out_fusion(_gallery(spark, sim2, dist2, cluster, kind), [0, 1, 2], GRID).collect()}
    assert first[0] == second[0]


def test_cascade(spark):
    cluster = [0, 0, 0, 1, 1, 1]
    good = np.array([[1.0 if a == b else 0.0 for b in cluster] for a in cluster])
    out = U.cascade(_gallery(spark, good, -good, cluster, [0] * 6), "query_id", "cand_id", "sim", "dist", "rel", (1, 2)).groupBy("k").agg(F.avg("recall").alias("r"), F.avg("ap").alias("a")).collect()
    assert {r["k"]: r["r"] for r in out} == {1: 0.5, 2: 1.0}
    rng = np.random.RandomState(3)
    noise = U.cascade(_gallery(spark, rng.rand(12, 12), rng.rand(12, 12), np.repeat(range(4), 3), [0] * 12), "query_id", "cand_id", "sim", "dist", "rel", (1, 2, 5, 11)).collect()
    assert all(r["ap"] <= r["recall"] + 1e-12 and 0 <= r["ap"] <= 1 for r in noise)


def test_outcomes(spark):
    cluster, kind = [0, 0, 0, 1, 1, 1], [0, 0, 1, 0, 0, 1]
    rng = np.random.RandomState(1)
    out = U.outcome_composition(_gallery(spark, rng.rand(6, 6), rng.rand(6, 6), cluster, kind), "query_id", "cand_id", "sim", (1, 10)).collect()
    assert all(sum((r["relevant"], r["same_cluster_wrong_label"], r["wrong_cluster"])) == pytest.approx(1) for r in out)
    assert {r["k"] for r in out} == {1, 10}  # 10 is cut to the gallery
    sim = rng.rand(6, 6)
    sim[0, 1] = np.inf
    with pytest.raises(Exception, match="non-finite"):
        U.outcome_composition(_gallery(spark, sim, sim, cluster, kind), "query_id", "cand_id", "sim", (1,)).collect()


def test_tied_alphas(spark):
    pick = lambda rows: U.best_alpha(spark.createDataFrame(rows, "alpha double, map double"), []).first()["alpha"]
    assert pick([(0.0, 0.5), (0.5, 0.9), (1.0, 0.9)]) == 1.0
    assert pick([(0.0, 0.9), (0.5, 0.9), (1.0, 0.9)]) == 0.5
    assert pick([(0.2, 0.9), (0.4, 0.9), (0.6, 0.9), (0.8, 0.9), (0.0, 0.1)]) == 0.4
