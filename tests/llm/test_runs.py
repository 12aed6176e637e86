from __future__ import annotations

import numpy as np
import pytest

from strandline.llm.runs import collapse_runs, prefix_merge


def _brute(rows, gap):
    out, by = [], {}
    for r in set(rows):
        if None not in r and r[3] > r[2]:
            by.setdefault(r[0], []).append(r)
    for seq, events in by.items():
        run = None
        for _, lab, s, e, t in sorted(events, key=lambda r: (r[2], r[3], r[4], r[1])):
            if run and run[0] == lab and s <= run[2] + gap:
                run[2], run[3] = max(run[2], e), run[3] + 1
            else:
                if run:
                    out.append((seq, *run))
                run = [lab, s, e, 1]
        out.append((seq, *run))
    return sorted(out)


def _run(df, gap):
    out = collapse_runs(df, "seq", "lab", "s", "e", "t", gap).collect()
    assert all(r["duration"] == r["e"] - r["s"] for r in out)
    return sorted((r["seq"], r["lab"], r["s"], r["e"], r["n_events"]) for r in out)


@pytest.mark.parametrize("seed", range(6))
def test_equals_brute_force_over_many_borders(spark, seed):
    """Long runs over several chunks, events within others, repeated rows, nulls and inverted events."""
    rng = np.random.default_rng(seed)
    rows = []
    for t in range(500):
        seq = "hot" if rng.random() < 0.6 else f"s{rng.integers(0, 8)}"
        s = int(rng.integers(0, 300 if seed % 2 else 3000))
        rows.append((seq, int(rng.integers(1, 2 + seed % 3)), s, s + int(rng.integers(-1, 40 if rng.random() < 0.9 else 900)), t))
    rows += rows[:50] + [(None, 1, 0, 5, 1), ("s1", None, 0, 5, 1), ("s1", 1, None, 5, 1), ("s1", 1, 0, None, 1), ("s1", 1, 5, 5, 1)]
    df = spark.createDataFrame(rows, "seq string, lab int, s int, e int, t long").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", 1 + 4 * seed)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3 + seed)
    try:
        assert _run(df, 6) == _brute(rows, 6)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([("a", 1, 0, 5, 1, "x", 2)], "seq string, lab int, s int, e int, t long, chunk string, run_id int")
    assert _run(df.limit(0), 6) == []
    assert _run(df, 6) == [("a", 1, 0, 5, 1)]


def test_prefix_merge_is_a_fold():
    for n in range(0, 20):
        items = [chr(97 + k) for k in range(n)]
        assert prefix_merge(items, lambda a, b: a + b) == [None if k == 0 else "".join(items[:k]) for k in range(n)]


@pytest.mark.parametrize("unit, origin", [(1_000_000, 1_700_000_000_000_000), (1_000_000_000, 1_700_000_000_000_000_000), (1_000, -90_000_000), (1, -(2**63) + 1), (1, 2**63 - 20_001)])
def test_times_of_any_unit(spark, unit, origin):
    """Every other event opens a run of its own label, in one batch: epoch micro- and nanoseconds, times before zero, the ends of 64 bits."""
    rng = np.random.default_rng(3)
    rows = [("s", int(rng.integers(1, 3)), origin + 2 * k * unit, origin + (2 * k + int(rng.integers(1, 4))) * unit, k) for k in range(4000)]
    df = spark.createDataFrame(rows, "seq string, lab int, s long, e long, t long")
    assert _run(df, unit) == _brute(rows, unit)


def test_longest_durations_and_refusals(spark):
    df = spark.createDataFrame([("a", 1, -(2**63), 2**63 - 1, 1)], "seq string, lab int, s long, e long, t long")
    assert collapse_runs(df, "seq", "lab", "s", "e", "t", 6).first()["duration"] is None
    with pytest.raises(TypeError):
        collapse_runs(df.withColumn("s", df.s.cast("double")), "seq", "lab", "s", "e", "t", 6)
    with pytest.raises(ValueError):
        collapse_runs(df, "seq", "lab", "s", "e", "t", -1)
