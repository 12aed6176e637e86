from __future__ import annotations

import math

import numpy as np
import pytest

from strandline.llm.topn import By, top_n_per_group


def _brute(rows, n):
    out = set()
    by = {}
    for g, i, s, t in rows:
        by.setdefault(g, []).append((-s if s is not None else math.inf, t if t is not None else math.inf, -1 if i is None else i, i))
    for g, items in by.items():
        seen = []
        for *_, i in sorted(items, key=lambda x: x[:3]):
            if i not in seen:
                seen.append(i)
        out |= {(g, i, k + 1) for k, i in enumerate(seen[:n])}
    return out


def _run(df, n):
    found = top_n_per_group(df, "g", "i", [By("s", descending=True), By("t")], n).collect()
    rows = [(r["g"], r["i"], r["position"]) for r in found]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed,n,parts,batch", [(0, 3, 1, 10000), (1, 3, 7, 4), (2, 10, 12, 3), (3, 1, 5, 2)])
def test_equals_brute_force(spark, seed, n, parts, batch):
    """Many ties and repeats, groups over several partitions, one group with half of all rows."""
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(600):
        g = 0 if rng.random() < 0.5 else None if rng.random() < 0.1 else int(rng.integers(1, 30))
        rows.append((g, None if rng.random() < 0.02 else int(rng.integers(0, 25)), None if rng.random() < 0.05 else float(rng.integers(0, 6)), None if rng.random() < 0.2 else float(rng.integers(0, 3))))
    rows += rows[:60]
    df = spark.createDataFrame(rows, "g int, i int, s double, t double").repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert _run(df, n) == _brute(rows, n)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)


def test_one_item_repeated_over_all_partitions(spark):
    rows = [(1, 7, float(k), 0.0) for k in range(500)] + [(1, k, -1.0, 0.0) for k in range(100, 104)]
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    try:
        assert _run(spark.createDataFrame(rows, "g int, i int, s double, t double"), 3) == {(1, 7, 1), (1, 100, 2), (1, 101, 3)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_empty_kept_columns_and_clashing_names(spark):
    df = spark.createDataFrame([("a", "x", 1.0, 2.0, "p", 5), ("a", "y", 3.0, 2.0, "q", 6)], "g string, i string, s double, t double, pid string, pos int")
    out = top_n_per_group(df, "g", "i", [By("s", descending=True)], 1, keep=["pid", "pos"]).collect()
    assert [tuple(r) for r in out] == [("a", "y", "q", 6, 1)]
    assert top_n_per_group(df.limit(0), "g", "i", [By("s")], 5).collect() == []
    assert top_n_per_group(df, "g", "i", [By("s")], 0).collect() == []
