from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import near
from strandline.operators.cluster import dbscan, least_labels
from strandline.operators.near import chord, near_pairs, on_globe


def _brute(points, radius):
    return {(a[0], b[0]) for a in points for b in points if a[0] < b[0] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= radius**2}


@pytest.mark.parametrize("seed,spread", [(0, 100.0), (1, 3000.0), (2, 5e7)])
def test_equals_brute_force(spark, seed, spread):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-spread, spread, size=(20, 2))
    points = [(i, *map(float, centres[i % 20] + rng.normal(0, 25, 2))) for i in range(300)]
    points += [(1000 + i, 5.0, 5.0) for i in range(20)]  # a place held by many
    df = spark.createDataFrame(points, "id long, x double, y double")
    found = [(r["id_a"], r["id_b"]) for r in near_pairs(df, "id", [F.col("x"), F.col("y")], 30.0).collect()]
    assert len(found) == len(set(found)) and set(found) == _brute(points, 30.0)


@pytest.mark.parametrize("top, crowded", [(8, 512), (2048, 2), (1, 5)])
def test_any_start_and_any_leaf(spark, monkeypatch, top, crowded):
    """From few or many top nodes, with leaves refined by count: an overfull place, equal places, lines at the limit."""
    monkeypatch.setattr(near, "TOP", top)
    monkeypatch.setattr(near, "CROWDED", crowded)
    rng = np.random.default_rng(7)
    points = [(i, *map(float, rng.uniform(-60, 60, 2))) for i in range(150)] + [(200 + i, 7.0, 7.0) for i in range(12)] + [(300 + i, 37.0, 7.0) for i in range(12)]
    points += [(400 + i, 4000.0 + 10.0 * i, -9000.0) for i in range(20)]
    df = spark.createDataFrame(points, "id long, x double, y double")
    found = [(r["id_a"], r["id_b"]) for r in near.near_pairs(df, "id", [F.col("x"), F.col("y")], 30.0).collect()]
    assert len(found) == len(set(found)) and set(found) == _brute(points, 30.0)


def test_an_id_at_several_places(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (1, 5.0, 0.0), (2, 1.0, 0.0), (2, 4.0, 0.0), (3, 900.0, 0.0)], "id long, x double, y double")
    assert [tuple(r) for r in near_pairs(df, "id", [F.col("x"), F.col("y")], 30.0).collect()] == [(1, 2)]


def test_odd_rows(spark):
    rows = [(1, 0.0, 0.0), (1, 0.0, 0.0), (2, 3.0, 4.0), (None, 0.0, 0.0), (3, None, 0.0), (4, float("nan"), 0.0), (5, float("inf"), 0.0), (6, 1e300, 0.0), (7, 1e300, 0.0)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "id long, c double, lo_x double, a_cx string")  # names as used inside
    assert [tuple(r) for r in near_pairs(df, "id", [F.col("c"), F.col("lo_x")], 5.0).collect()] == [(1, 2)]
    assert near_pairs(df.limit(0), "id", [F.col("c"), F.col("lo_x")], 5.0).collect() == []
    with pytest.raises(ValueError):
        near_pairs(df, "id", [F.col("c"), F.col("lo_x")], 0)


def test_poles_and_date_line(spark):
    rows = [(1, 89.99999, 10.0), (2, 89.99999, -170.0), (3, 45.0, 179.99999), (4, 45.0, -179.99999), (5, 45.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, lat double, lng double")
    found = {tuple(r) for r in near_pairs(df, "id", on_globe(F.col("lat"), F.col("lng")), chord(30.0)).collect()}
    assert found == {(1, 2), (3, 4)}


def test_dbscan_against_loops(spark):
    rng = np.random.default_rng(4)
    points = [(i, *map(float, rng.uniform(0, 200, 2))) for i in range(250)]
    near = {i: set() for i, *_ in points}
    for a, b in _brute(points, 10.0):
        near[a].add(b)
        near[b].add(a)
    core = {i for i in near if len(near[i]) + 1 >= 4}
    label, found = {}, 0
    for i in sorted(core):
        if i in label:
            continue
        todo = [i]
        while todo:
            x = todo.pop()
            if x in label:
                continue
            label[x] = found
            if x in core:
                todo += near[x]
        found += 1
    df = spark.createDataFrame(points, "id long, x double, y double")
    assert {r["id"]: r["cluster"] for r in dbscan(df, "id", [F.col("x"), F.col("y")], 10.0, 4).collect()} == label


def test_labels_travel_along_chains(spark):
    nodes = spark.range(200)
    edges = spark.range(199).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["label"] for r in least_labels(nodes, "id", edges).collect()} == {0}
