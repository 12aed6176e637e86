"""Frame-index arithmetic of clips, without decoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.operators.arrays import let, range0
from strandline.operators.perturb import linspace_index


def sample_linspace(n: Column, k: int) -> Column:
    """Indices of at most k of n frames, evenly spread; all of them where there are no more than k."""
    return F.when(n <= k, range0(n)).otherwise(linspace_index(n, F.lit(k)))


def sample_stride(n: Column, fps: Column, target: Column) -> Column:
    """Frames taken as the running count reaches a mark that moves on by fps / target with each frame taken."""
    step = fps / target
    start = F.struct(F.lit(0.0).alias("mark"), F.array().cast("array<int>").alias("taken"))

    def visit(state: Column, i: Column) -> Column:
        take = i >= state["mark"]
        return F.struct(F.when(take, state["mark"] + step).otherwise(state["mark"]).alias("mark"), F.when(take, F.concat(state["taken"], F.array(i))).otherwise(state["taken"]).alias("taken"))

    return F.aggregate(range0(n), start, visit, lambda s: s["taken"])


def sample_nearest(times: Column, start: Column, stop: Column, k: int) -> Column:
    """For k even target times the index of the nearest time; of equally near ones the earlier."""

    def nearest(target: Column) -> Column:
        gaps = F.transform(times, lambda t, i: F.struct(F.abs(t - target).alias("gap"), i.alias("i")))
        return F.array_min(gaps)["i"]

    return F.transform(range0(F.lit(k)), lambda i: nearest(start + i / float(max(k - 1, 1)) * (stop - start)))


def pad_or_cut(frames: Column, k: int = 64) -> Column:
    """Exactly k frames: the last repeated, or the rest cut off; an empty list stays empty."""
    missing = F.greatest(F.lit(k) - F.size(frames), F.lit(0))
    return F.when(F.size(frames) > 0, F.slice(F.concat(frames, F.array_repeat(F.element_at(frames, -1), missing)), 1, k)).otherwise(frames)


def pad_stats(taken: Column, duration: Column, k: int = 64) -> Column:
    """Struct of unique frames, share of doubles (at least 0) and effective rate; a duration that isn't positive counts as 1."""
    length = F.when(duration > 0, duration).otherwise(F.lit(1.0))
    return F.struct(taken.alias("unique_frames"), F.greatest(F.lit(0.0), 1 - taken / k).alias("dup_ratio"), (taken / length).alias("fps_eff"))


def target_fps(duration: Column, k: int = 64) -> Column:
    """The rate that gives k frames; without limit for a clip of no length, where a plain division raises."""
    return F.coalesce(F.try_divide(F.lit(float(k)), duration), k * F.pow(duration, F.lit(-1.0)))


def capped_unique(duration: Column, cap: float | None, k: int = 64) -> Column:
    """Frames left at a capped rate: max(1, min(k, whole(rate * duration))), where the rate aims at k frames."""
    rate = target_fps(duration, k)
    if cap is not None:
        rate = F.least(rate, F.lit(cap))
    return F.greatest(F.lit(1), F.floor(F.least(F.lit(float(k)), rate * duration))).cast("int")


def effective_fps(times: Column) -> Column:
    """(n - 1) / (last - first); 1 with fewer than two times or no time between them."""
    span = F.element_at(times, -1) - F.element_at(times, 1)
    return F.when((F.size(times) >= 2) & (span > 0), (F.size(times) - 1) / span).otherwise(F.lit(1.0))


def temporal_masks(context_steps: Column, steps: int, places: int) -> Column:
    """Struct of the positions (steps x places, row by row) before and from ``context_steps`` on."""
    cut = (context_steps * places).cast("int")
    everything = range0(F.lit(steps * places))
    return let(everything, lambda a: F.struct(F.slice(a, F.lit(1), cut).alias("context"), F.slice(a, cut + 1, F.lit(steps * places)).alias("target")))
