from __future__ import annotations

import numpy as np
import pytest

from strandline.operators import segments as S


def _brute(rows, targets):
    out, by = [], {}
    for k, o, lab in rows:
        by.setdefault(k, []).append((o, lab))
    for k, frames in by.items():
        run = None
        for o, lab in sorted(frames):
            lab = lab if lab in targets else None
            if run and lab == run[0]:
                run[2], run[3] = o + 1, run[3] + 1
            else:
                if run and run[0] is not None:
                    out.append((k, *run))
                run = [lab, o, o + 1, 1]
        if run and run[0] is not None:
            out.append((k, *run))
    return sorted(out)


@pytest.mark.parametrize("bucket", [1, 2, 7, 50, 100_000])
def test_stretches_over_bucket_borders(spark, bucket):
    rng = np.random.default_rng(bucket)
    rows = [(k, o, [None, "a", "a", "a", "b", "c"][rng.integers(0, 6)] if rng.random() < 0.4 else "a") for k in range(4) for o in range(120) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "k int, o int, lab string")
    found = sorted((r["k"], r["lab"], r["start"], r["end"], r["n"]) for r in S.gaps_and_islands(df, ["k"], "o", "lab", ["a", "b"], bucket).collect())
    assert found == _brute(rows, {"a", "b"})


def test_no_frames(spark):
    assert S.gaps_and_islands(spark.createDataFrame([], "k int, o int, lab string"), ["k"], "o", "lab").collect() == []
