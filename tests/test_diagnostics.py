from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import diagnostics as G
from strandline.operators import perturb as X
from strandline.operators import sequences as S

SEQ = "seq_id string, emb array<array<double>>"


def _sequences(spark, items):
    return spark.createDataFrame([(k, np.asarray(v, float).tolist()) for k, v in items.items()], SEQ)


def _random(n, t=20, d=16, seed=42):
    rng = np.random.default_rng(seed)
    return {f"s{i}": rng.normal(size=(t, d)) for i in range(n)}


def test_constant_sequences_are_their_own_reversal(spark):
    df = _sequences(spark, {"a": np.ones((10, 16)), "b": np.full((10, 16), 2.0)})
    row = G.reversal_summary(df, "seq_id", "emb", ["ordered_frame"]).first()
    assert row["mean"] == pytest.approx(1.0) and row["std"] == pytest.approx(0.0) and row["n"] == 2


def test_mean_pooling_ignores_order(spark):
    row = G.reversal_summary(_sequences(spark, _random(5)), "seq_id", "emb", ["cosine"]).first()
    assert row["mean"] == pytest.approx(1.0) and row["std"] == pytest.approx(0.0, abs=1e-7)


def test_no_sequences_give_nan(spark):
    row = G.reversal_summary(spark.createDataFrame([], SEQ), "seq_id", "emb", ["cosine"]).first()
    assert math.isnan(row["mean"]) and math.isnan(row["std"]) and row["n"] == 0


def _scrambled(spark, t, k, seed=0, name="a"):
    df = spark.createDataFrame([(name, [[float(i)] for i in range(t)])], SEQ)
    return [int(v[0]) for v in df.select(X.scramble_hashed(F.col("emb"), F.col("seq_id"), F.lit(k), F.lit(seed)).alias("e")).first()["e"]]


def test_scramble_properties(spark):
    assert _scrambled(spark, 10, 1) == list(range(10))
    assert sorted(_scrambled(spark, 30, 16)) == list(range(30))
    assert _scrambled(spark, 30, 16) == _scrambled(spark, 30, 16)
    assert len({tuple(_scrambled(spark, 30, 16, seed=s)) for s in range(5)}) > 1
    assert sorted(_scrambled(spark, 3, 16)) == [0, 1, 2]
    mixed = _scrambled(spark, 30, 16)
    longest, run = 1, 1
    for a, b in zip(mixed, mixed[1:]):
        run = run + 1 if b == a + 1 else 1
        longest = max(longest, run)
    assert longest <= 6  # chunks of one or two steps; neighbours may meet by chance


def test_empty_and_null_sequences_survive_transforms(spark):
    df = spark.createDataFrame([("e", []), ("n", None), ("one", [[1.0, 2.0]])], SEQ)
    for build in (S.derivative, S.smooth_replicate, S.trajectory, S.minmax_time, S.pool_mean, S.pool_max, lambda x: X.change_speed(x, 2.0), lambda x: X.frame_drop(x, F.lit("i"), F.lit(1)), lambda x: X.scramble_tail(x, F.lit("i"), F.lit(4), F.lit(1))):
        assert df.select("seq_id", build(F.col("emb")).alias("y")).count() == 3
        df.select(build(F.col("emb")).alias("y")).collect()


def _pairs(spark, n):
    rows = [(f"s{i}", f"s{i}", 1) for i in range(n)] + [(f"s{i}", f"s{(i + 1) % n}", 0) for i in range(n)]
    return spark.createDataFrame(rows, "id_a string, id_b string, label int")


def test_verdicts(spark):
    df = _sequences(spark, _random(5))
    for method, verdict in (("cosine", "order-invariant"),):
        g = G.scramble_gradient(G.scramble_scores(_pairs(spark, 5), df, df, [1, 4, 16], [method]))
        assert g.count() == 3
        assert G.gradient_verdict(g).first()["verdict"] == verdict
    one = G.scramble_gradient(G.scramble_scores(_pairs(spark, 5), df, df, [1], ["cosine"]))
    assert G.gradient_verdict(one).first()["verdict"] == "inconclusive"


def test_missing_sides_leave_nothing(spark):
    df = _sequences(spark, _random(2))
    pairs = spark.createDataFrame([("x", "y", 1)], "id_a string, id_b string, label int")
    assert G.scramble_scores(pairs, df, df, [1, 4], ["cosine"]).count() == 0


def test_report_and_factorial(spark):
    df = _sequences(spark, _random(4))
    report = G.temporal_report(_pairs(spark, 4), df, df, [1, 4], "ordered_frame").collect()
    assert {r["measure"] for r in report} == {"ap", "drop", "s_rev_mean", "s_rev_std"}
    assert {r["n"] for r in report if r["measure"] == "s_rev_mean"} == {4}
    cells = G.factorial_ap(_pairs(spark, 4), {"a": df, "b": df}, ["cosine", "dtw"]).collect()
    assert len(cells) == 4 and all(c["ap"] == pytest.approx(1.0) and c["n_pairs"] == 8 for c in cells)
    with pytest.raises(ValueError):
        G.factorial_ap(_pairs(spark, 4), {}, ["cosine"])


def test_later_sequences_win_in_a_merge(spark):
    merged = G.merged_sequences(_sequences(spark, {"a": [[1.0]], "b": [[2.0]]}), _sequences(spark, {"a": [[9.0]]}))
    assert {r["seq_id"]: r["emb"] for r in merged.collect()} == {"a": [[9.0]], "b": [[2.0]]}
