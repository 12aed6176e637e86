from __future__ import annotations

import numpy as np
import pytest

from strandline.llm.components import connected_components, relationship_links
from strandline.llm.splits import hash_to_min


def _brute(pairs):
    parent = {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        if a is None or b is None or a == b:
            continue
        for x in (a, b):
            parent.setdefault(x, x)
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def _random(seed):
    rng = np.random.default_rng(seed)
    return [(int(a), int(b)) for a, b in rng.integers(0, 300, size=(220, 2))] + [(None, 1), (5, None), (7, 7)]


SHAPES = {
    "random": _random(0),
    "chain": [(k, k + 1) for k in range(120)],
    "reversed chain": [(k + 1, k) for k in range(64, 0, -1)],
    "star round the largest": [(999, k) for k in range(200)],
    "tree": [(k, 2 * k) for k in range(1, 80)] + [(k, 2 * k + 1) for k in range(1, 80)],
    "repeats": [(1, 2), (2, 1), (1, 2)] * 5,
    "none": [],
    "only itself": [(1, 1)],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_equals_union_find(spark, shape):
    df = spark.createDataFrame(SHAPES[shape], "a long, b long")
    found = connected_components(df, "a", "b").collect()
    assert len(found) == len({r["record"] for r in found})
    assert {r["record"]: r["group"] for r in found} == _brute(SHAPES[shape])


@pytest.mark.parametrize("shape", ["random", "chain", "star round the largest", "none"])
def test_hash_to_min_agrees(spark, shape):
    text = [tuple(None if x is None else f"{x:04d}" for x in p) for p in SHAPES[shape]]
    df = spark.createDataFrame(text, "a string, b string")
    found = {r["entity"]: r["component"] for r in hash_to_min(df, "a", "b").collect()}
    expected = _brute(text)
    expected |= {x: x for p in text for x in p if x is not None and x not in expected}
    assert found == expected


def test_every_record_has_a_group(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    records = spark.createDataFrame([(2,), (2,), (7,), (None,)], "a long")
    found = connected_components(pairs, "a", "b", records=records, record="a").collect()
    assert sorted(map(tuple, found)) == [(1, 1), (2, 1), (3, 1), (7, 7)]
    assert connected_components(pairs.limit(0), "a", "b", records=records, record="a").count() == 2


def test_never_cut_off_silently(spark):
    with pytest.raises(RuntimeError):
        connected_components(spark.createDataFrame(SHAPES["chain"], "a long, b long"), "a", "b", max_rounds=1)


def test_readings_of_a_relationship(spark):
    good = ["copy", " Copy ", "COPY & EVENT", "copy+event", "copy_and-event", "copy  and\tevent", "reasoning", "Event", "copy &event"]
    bad = [None, "", "not copy", "copy?", "independent", "copied", "no copy and event", "copy or event", "and"]
    rows = [(1, 2, t) for t in good] + [(3, 4, t) for t in bad] + [(1, 1, "copy"), (1, 99, "copy"), (None, 2, "copy")]
    pairs = spark.createDataFrame(rows, "video1_id long, video2_id long, relationship string")
    videos = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 4, None)], "video_id long")
    assert [tuple(r) for r in relationship_links(pairs, videos).collect()] == [(1, 2)]
    for t in good:
        assert relationship_links(pairs.where(pairs.relationship == t), videos).count() == 1, t
