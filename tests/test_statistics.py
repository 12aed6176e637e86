from __future__ import annotations

import math

import numpy as np
import pytest

from strandline.operators import metrics as M
from strandline.operators import resample as B


def test_truncated_ap(spark):
    rows = spark.createDataFrame([(0, r + 1, rel, 5) for r, rel in enumerate([1, 0, 1, 0])], "q int, rank int, rel int, total int")
    assert M.truncated_ap(rows, ["q"], "rank", "rel", "total").first()["ap"] == pytest.approx((1 + 2 / 3) / 5)
    none = spark.createDataFrame([(0, 1, 0, 0)], "q int, rank int, rel int, total int")
    assert math.isnan(M.truncated_ap(none, ["q"], "rank", "rel", "total").first()["ap"])


def _brute(score, label):
    ap = tp = n = 0
    for s in sorted(set(score), reverse=True):
        hit = [y for x, y in zip(score, label) if x == s]
        n += len(hit)
        tp += sum(hit)
        ap += sum(hit) / sum(label) * tp / n
    return ap


def test_pooled_curve_over_many_buckets(spark):
    rng = np.random.default_rng(2)
    score = np.round(np.concatenate([rng.normal(0, 50, 300), rng.normal(0, 0.01, 300)]), 3)
    label = (rng.random(600) < 0.3).astype(int)
    df = spark.createDataFrame([(float(s), int(y)) for s, y in zip(score, label)] + [(None, 1), (float("nan"), 0)], "s double, y int")
    assert M.average_precision(df, [], "s", "y").first()["ap"] == pytest.approx(_brute(score, label))
    wins = np.mean([[1.0 if a > b else 0.5 if a == b else 0.0 for b in score[label == 0]] for a in score[label == 1]])
    assert M.roc_auc(df, [], "s", "y").first()["auc"] == pytest.approx(wins)
    assert math.isnan(M.roc_auc(df.where("y = 1"), [], "s", "y").first()["auc"])
    # a growing transform changes nothing
    again = df.selectExpr("exp(s / 100) as s", "y")
    assert M.average_precision(again, [], "s", "y").first()["ap"] == pytest.approx(_brute(score, label))


def test_multiplicities_follow_one_generator(spark):
    rng = np.random.RandomState(42)
    expected = [np.bincount(rng.randint(0, 7, size=7), minlength=7) for _ in range(9)]
    rows = B.multiplicities(spark, list(range(7)), 9, 42).collect()
    found = np.zeros((9, 7), int)
    for r in rows:
        found[r["replicate"], r["place"]] = r["times"]
    assert (found == np.array(expected)).all()


@pytest.mark.parametrize("draws", ["generator", "md5"])
def test_cluster_curves_equal_loops(spark, monkeypatch, draws):
    """Ties within and over clusters, scores that are null or NaN, many chunks and small blocks."""
    monkeypatch.setattr(B, "_ROWS", 7)
    rng = np.random.default_rng(5)
    rows = [(f"c{rng.integers(0, 6)}", float(np.round(rng.normal(), 1)), float(rng.normal()), int(rng.random() < 0.4)) for _ in range(400)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0, 1), ("c1", None, float("nan"), 1), ("c1", 0.5, 0.5, None)], "c string, a double, b double, y int")
    found = {(r["replicate"], r["method"]): r["ap"] for r in B.cluster_ap(df, "c", ["a", "b"], "y", 12, 9, draws).collect()}
    assert len(found) == 26
    names = sorted({r[0] for r in rows})
    for r, times in enumerate([np.ones(6, int), *B.drawn_times(6, range(12), 9, draws)]):
        use = [row for row in rows for _ in range(times[names.index(row[0])])]
        for k, m in ((1, "a"), (2, "b")):
            assert found[(r - 1, m)] == pytest.approx(_brute([row[k] for row in use], [row[3] for row in use]))


def test_too_many_clusters_or_replicates_raise(spark, monkeypatch):
    df = spark.createDataFrame([(k, 0.5, k % 2) for k in range(9)], "c int, s double, y int")
    monkeypatch.setattr(B, "MOST_TIMES", 50)
    with pytest.raises(ValueError):
        B.cluster_ap(df, "c", ["s"], "y", 10)
    monkeypatch.setattr(B, "MOST_CLUSTERS", 8)
    with pytest.raises(ValueError):
        B.cluster_mean(df, "c", "s", 10)
    with pytest.raises(ValueError):
        list(B.drawn_times(3, [0], 1, "dice"))


def test_paired_difference_keeps_pairs_together(spark):
    rows = [(c, y, float(y) + 0.1 * k, 1.0 - y + 0.1 * k) for c in range(2) for k, y in enumerate([1, 1, 0, 0])]
    df = spark.createDataFrame(rows, "cluster int, gt int, a double, b double")
    out = B.paired_ap_difference(B.cluster_ap(df, "cluster", ["a", "b"], "gt", 40), "a", "b").first()
    assert out["difference"] > 0 and out["p_greater"] == 1.0


def test_intervals_hold_the_point(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(int(i % 10), float(v)) for i, v in enumerate(rng.normal(size=300))], "c int, v double")
    out = B.cluster_mean(df, "c", "v", 300).first()
    assert out["ci_low"] <= out["point"] <= out["ci_high"] and out["n_clusters"] == 10
    pairs = spark.createDataFrame([(float(v), int(v + rng.normal() > 0)) for v in rng.normal(size=400)], "s double, y int")
    out = B.pair_interval(pairs, "s", "y", "ap", 200).first()
    assert out["ci_low"] < out["point"] < out["ci_high"] and out["n"] == 400


def test_empty_tables(spark):
    assert B.cluster_mean(spark.createDataFrame([], "c int, v double"), "c", "v", 10).first()["n_clusters"] == 0
    assert B.pair_interval(spark.createDataFrame([], "s double, y int"), "s", "y", "ap", 10).first()["n"] == 0
