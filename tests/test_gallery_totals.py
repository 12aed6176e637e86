from __future__ import annotations

import numpy as np
import pytest

from strandline.catalog.perturbations import QUERIES, forward_and_reversed


def _brute(x: np.ndarray) -> dict:
    """Loops over all pairs: label -> (n, sum of cosines of means, sum of mean step cosines)."""
    cos = lambda a, b: float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
    out = {0: [0, 0.0, 0.0], 1: [0, 0.0, 0.0]}
    for i in range(len(x)):
        for j in range(len(x)):
            y = x[i][::-1] if i == j else x[j]
            row = out[int(i == j)]
            row[0] += 1
            row[1] += cos(x[i].mean(0), y.mean(0))
            row[2] += float(np.mean([cos(a, b) for a, b in zip(x[i], y)]))
    return out


def _check(found, x):
    for label, (n, cosine, ordered) in _brute(x).items():
        assert found[label]["n"] == n
        assert found[label]["cosine"] == pytest.approx(cosine, abs=1e-4)
        assert found[label]["ordered_frame"] == pytest.approx(ordered, abs=1e-4)


def test_every_sequence_meets_all_others(spark):
    x = np.random.default_rng(3).normal(size=(60, 4, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item long, x array<array<double>>")
    _check({r["label"]: r for r in forward_and_reversed(df).collect()}, x)


def test_registered_query_takes_all_items(spark, data):
    n = spark.read.parquet(f"{data}/embeddings.parquet").count()
    found = {r["label"]: r["n"] for r in QUERIES["join_fwd_rev_gallery_all"](spark, data).collect()}
    assert found == {0: n * (n - 1), 1: n}
