from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.operators import comparators as C
from strandline.operators.dtw import dtw_distance


def by_loops(a, b, normalize):
    if normalize:
        stretch = lambda x: x if len(x) < 2 else (x - x.min(0)) / np.maximum(x.max(0) - x.min(0), 1e-8)
        a, b = stretch(a), stretch(b)
    acc = np.full((len(a) + 1, len(b) + 1), np.inf)
    acc[0, 0] = 0
    for i in range(len(a)):
        for j in range(len(b)):
            acc[i + 1, j + 1] = np.linalg.norm(a[i] - b[j]) + min(acc[i, j + 1], acc[i + 1, j], acc[i, j])
    return acc[-1, -1] / (len(a) + len(b))


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.integers(1, 4), st.booleans(), st.integers(0, 9999))
def test_equals_loops(ta, tb, d, normalize, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(3, ta, d)), rng.normal(size=(3, tb, d))
    found = dtw_distance(a, b, normalize)
    assert np.allclose(found, [by_loops(x, y, normalize) for x, y in zip(a, b)], atol=1e-9)


def test_identical_is_zero():
    x = np.random.default_rng(1).normal(size=(2, 30, 16))
    assert np.allclose(dtw_distance(x, x, True), 0)


def test_batches_of_mixed_lengths_nulls_and_empties(spark):
    rng = np.random.default_rng(3)
    rows, expected = [], {}
    for i in range(40):
        a, b = rng.normal(size=(int(rng.integers(1, 9)), 3)), rng.normal(size=(int(rng.integers(1, 9)), 3))
        rows.append((i, a.tolist(), b.tolist(), 1))
        expected[i] = by_loops(a, b, False)
    rows += [(100, None, [[1.0, 2.0, 3.0]], 1), (101, [], [[1.0, 2.0, 3.0]], 1)]
    df = spark.createDataFrame(rows, "id int, a array<array<double>>, b array<array<double>>, dtw int").repartition(3)
    for block in (1, 7, 2048):
        found = {r["id"]: r for r in C.score_pairs(df, "a", "b", ["dtw_distance", "dtw"], block=block).collect()}
        assert all(abs(found[i]["dtw_distance"] - e) < 1e-9 for i, e in expected.items())
        assert found[100]["dtw_distance"] is None and found[100]["dtw_1"] is None  # the input's own dtw column stays
        assert found[101]["dtw_distance"] is None and found[101]["dtw_1"] == 0.0
        assert found[0]["dtw"] == 1


def test_no_pairs(spark):
    df = spark.createDataFrame([], "id int, a array<array<double>>, b array<array<double>>")
    assert C.score_pairs(df, "a", "b", ["cosine"]).collect() == []


def test_unknown_comparator_names_the_known():
    with pytest.raises(ValueError, match="chamfer"):
        C.comparator("nothing")


@pytest.mark.parametrize("name", [n for n in C.comparator_names()])
def test_declared_properties_hold(name):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(6, 7, 4)), rng.normal(size=(6, 7, 4))
    c = C.comparator(name)
    if c.symmetric:
        assert np.allclose(c.kernel(a, b), c.kernel(b, a))
    if c.order_invariant:
        assert np.allclose(c.kernel(a, b), c.kernel(a, b[:, rng.permutation(7)]))


# motion patterns: opposite directions are less alike than a pattern is to itself


def _path(kind, t=60):
    u = np.linspace(0, 1, t)
    paths = {"lr": (u, 0 * u + 0.5), "rl": (1 - u, 0 * u + 0.5), "tb": (0 * u + 0.5, u), "cw": (np.cos(6 * u), -np.sin(6 * u)), "ccw": (np.cos(6 * u), np.sin(6 * u)), "zigzag": (u, np.abs((u * 6) % 2 - 1))}
    return np.stack(paths[kind], axis=1)[None]


@pytest.mark.parametrize("a,b", [("lr", "rl"), ("cw", "ccw"), ("lr", "tb"), ("zigzag", "lr")])
def test_patterns(a, b):
    kernel = C.comparator("dtw").kernel
    assert kernel(_path(a), _path(a))[0] > 0.99
    assert kernel(_path(a), _path(b))[0] < kernel(_path(a), _path(a))[0]
