"""Packing, pooling and per-sequence transforms.

Packed sequences are array<array<double>> columns, one inner array per time step.  All transforms are column
expressions, evaluated in the scan's own tasks without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators import arrays as A


def pack(long: DataFrame, keys: Sequence[str], pos: str, vec: str, out: str = "x") -> DataFrame:
    """One row per key with its vectors in the order of ``pos``; rows with a null position or vector are left out."""
    kept = long.where(F.col(pos).isNotNull() & F.col(vec).isNotNull())
    return kept.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(vec).alias("v")))), lambda s: s["v"]).alias(out))


def unpack(packed: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """(keys, pos, dim, val); null and empty sequences have no rows."""
    steps = packed.select(*keys, F.posexplode(x).alias("pos", "vec"))
    return steps.select(*keys, F.col("pos").cast("bigint").alias("pos"), F.posexplode("vec").alias("dim", "val")).withColumn("dim", F.col("dim").cast("bigint"))


# pooling


def pool_mean(x: Column) -> Column:
    return A.l2(A.mean_rows(x))


def pool_max(x: Column) -> Column:
    return A.l2(A.fold_rows(x, lambda a, b: F.greatest(a, b)))


def pool_attention(x: Column) -> Column:
    """Rows weighted by the softmax of their product with the mean row."""
    logits = A.let(A.mean_rows(x), lambda m: F.transform(x, lambda v: A.dot(v, m)))
    raw = A.let(logits, lambda s: A.let(F.array_max(s), lambda top: F.transform(s, lambda z: F.exp(z - top))))
    weighted = A.let(raw, lambda w: A.let(A.total(w), lambda t: F.zip_with(x, w, lambda v, z: A.scale(v, z / t))))
    return A.l2(A.let(weighted, lambda y: A.fold_rows(y, lambda a, b: a + b)))


def pool_first(x: Column) -> Column:
    return F.element_at(x, 1)


def pool_last(x: Column) -> Column:
    return F.element_at(x, -1)


def pool_last_unit(x: Column) -> Column:
    return A.l2(F.element_at(x, -1))


def pool_first_last(x: Column) -> Column:
    return F.concat(F.element_at(x, 1), F.element_at(x, -1))


def pool_masked_mean(x: Column, mask: Column, least: int = 1) -> Column:
    """The mean of the rows whose mask is true; null where there are fewer than ``least`` of them."""
    kept = F.filter(x, lambda v, i: F.element_at(mask, i + 1))
    return A.let(kept, lambda k: F.when(F.size(k) >= least, A.mean_rows(k)))


def pool_temporal_stats(x: Column) -> Column:
    """Mean, standard deviation (n - 1), maximum and minimum over time, joined and brought to length 1."""
    std = A.each_dimension(x, A.sample_std)
    return A.l2(F.concat(A.mean_rows(x), std, A.fold_rows(x, lambda a, b: F.greatest(a, b)), A.fold_rows(x, lambda a, b: F.least(a, b))))


POOLING: dict[str, Callable[[Column], Column]] = {
    "mean": pool_mean,
    "max": pool_max,
    "attention": pool_attention,
    "first": pool_first,
    "last": pool_last,
    "last_unit": pool_last_unit,
    "first_last": pool_first_last,
    "temporal_stats": pool_temporal_stats,
}

# derivatives and trajectories


def derivative(x: Column, order: int = 1, window: int = 1, unit_rows: bool = False) -> Column:
    """``order`` times: x[t + window] - x[t].  Once no more than ``window`` rows are left, it stops there."""
    y = x
    for _ in range(order):
        step = A.let(y, lambda m: F.when(F.size(m) > window, F.zip_with(F.slice(m, window + 1, F.greatest(F.size(m) - window, F.lit(0))), F.slice(m, 1, F.greatest(F.size(m) - window, F.lit(0))), lambda a, b: F.zip_with(a, b, lambda p, q: p - q))).otherwise(m))
        y = step
    return A.rows_l2(y) if unit_rows else y


def smooth_replicate(x: Column, window: int = 3) -> Column:
    """Moving average with the edge rows repeated beyond the ends; sequences shorter than the window stay as they are."""
    if window <= 1:
        return x
    half = window // 2

    def at(i: Column) -> Column:
        near = [F.element_at(x, (F.greatest(F.lit(0), F.least(F.size(x) - 1, i + o)) + 1).cast("int")) for o in range(-half, window - half)]
        summed = near[0]
        for v in near[1:]:
            summed = A.add(summed, v)
        return F.transform(summed, lambda s: s / float(window))

    return F.when(F.size(x) < window, x).otherwise(F.transform(A.range0(F.size(x)), at))


def trajectory(x: Column, window: int = 3, velocity: bool = True) -> Column:
    """Smoothed positions from the second step on, each joined with its step's velocity; a single step stays alone."""
    smooth = smooth_replicate(x, window)
    if not velocity:
        return smooth

    def joined(s: Column) -> Column:
        later, earlier = F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))
        return F.when(F.size(s) > 1, F.zip_with(later, earlier, lambda a, b: F.concat(a, F.zip_with(a, b, lambda p, q: p - q)))).otherwise(s)

    return A.let(smooth, joined)


def minmax_time(x: Column) -> Column:
    """Every dimension stretched to 0..1 over time (range at least 1e-8); fewer than two steps stay as they are."""
    low, high = A.fold_rows(x, lambda a, b: F.least(a, b)), A.fold_rows(x, lambda a, b: F.greatest(a, b))
    spread = A.let(low, lambda lo: A.let(F.zip_with(high, lo, lambda h, m: F.greatest(h - m, F.lit(1e-8))), lambda r: F.transform(x, lambda v: F.zip_with(F.zip_with(v, lo, lambda p, q: p - q), r, lambda p, q: p / q))))
    return F.when(F.size(x) < 2, x).otherwise(spread)


def motion_proxy(values: Column) -> Column:
    """Mean absolute step of a series; null below three values."""
    steps = F.zip_with(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))), lambda a, b: F.abs(a - b))
    return F.when(F.size(values) >= 3, A.let(steps, lambda s: A.total(s) / F.size(s)))


def sign_flip(x: Column) -> Column:
    """Mean cosine between the steps of a sequence and those of its reversal, place by place."""
    forward, backward = derivative(x), derivative(F.reverse(x))
    each = F.zip_with(forward, backward, lambda a, b: A.dot(A.l2(a, 1e-8), A.l2(b, 1e-8)))
    return F.when(F.size(x) > 1, A.let(each, lambda s: A.total(s) / F.size(s)))


def attention_centroid(grid: Column) -> Column:
    """Centre (x, y) of an attention grid (rows of columns) in 0..1; the weights are divided by their sum + 1e-8."""
    flat = F.flatten(grid)
    height, width = F.size(grid), F.size(grid[0])
    weight = A.let(A.total(flat) + 1e-8, lambda s: F.transform(flat, lambda w: w / s))
    return F.struct(
        A.let(weight, lambda p: A.total(F.transform(p, lambda w, i: w * (i % width) / width))).alias("cx"),
        A.let(weight, lambda p: A.total(F.transform(p, lambda w, i: w * F.floor(i / width) / height))).alias("cy"),
    )


def patch_statistics(patches: Column) -> Column:
    """Mean over dimensions of the variance (n - 1) between patches, and entropy of the softmax of their lengths."""
    variance = A.each_dimension(patches, lambda v: F.pow(A.sample_std(v), 2))
    lengths = F.transform(patches, lambda v: A.norm(v))
    soft = A.let(lengths, lambda n: A.let(F.array_max(n), lambda top: F.transform(n, lambda z: F.exp(z - top))))
    share = A.let(soft, lambda e: A.let(A.total(e), lambda t: F.transform(e, lambda z: z / t)))
    return F.struct(
        A.let(variance, lambda s: A.total(s) / F.size(s)).alias("spread"),
        A.let(share, lambda p: -A.total(F.transform(p, lambda z: z * F.log(z + 1e-8)))).alias("entropy"),
    )


def temporal_residual(predicted: Column, actual: Column) -> Column:
    """Per step the mean over places of prediction minus truth: both are array (steps) of array (places) of vectors."""
    return F.zip_with(predicted, actual, lambda p, a: A.mean_rows(F.zip_with(p, a, lambda u, w: F.zip_with(u, w, lambda s, t: s - t))))


# by name, for ablations over poolings of a packed sequence to one vector
_POOLINGS: dict[str, Callable[[Column], Column]] = {"mean": pool_mean, "max": pool_max, "attention_weighted": pool_attention, "first": pool_first, "last": pool_last, "temporal_stats": pool_temporal_stats}


def register_pooling(name: str, build: Callable[[Column], Column]) -> None:
    """Make ``build`` known by ``name``; a known name is replaced."""
    _POOLINGS[name] = build


def pooling(name: str) -> Callable[[Column], Column]:
    if name not in _POOLINGS:
        raise ValueError(f"unknown pooling {name!r}; known: {', '.join(pooling_names())}")
    return _POOLINGS[name]


def pooling_names() -> list[str]:
    return sorted(_POOLINGS)
