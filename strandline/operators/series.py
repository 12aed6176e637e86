"""Operators on long-form series: (keys, order, values)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def smooth_same(df: DataFrame, keys: Sequence[str], order: str, value: str, width: int, out: str = "smooth") -> DataFrame:
    """Centred moving sum over a constant width: beyond the ends there are zeros, as in a 'same' convolution."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(width // 2), width - width // 2 - 1)
    return df.withColumn(out, F.sum(value).over(w) / float(width))


def block_mean(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], width: int) -> DataFrame:
    """(keys, block, values): means of successive blocks of ``width`` rows; an incomplete last block is dropped."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    blocks = df.select(*keys, *values, F.floor(place / width).alias("block"))
    return blocks.groupBy(*keys, "block").agg(F.count("*").alias("rows__"), *(F.avg(v).alias(v) for v in values)).where(F.col("rows__") == width).drop("rows__")


def clock_offset(df: DataFrame, keys: Sequence[str], utc_ms: str, device_s: str) -> DataFrame:
    """(keys, offset): exact median of UTC minus device seconds over rows with UTC > 0 and device time > 1 s."""
    kept = df.where((F.col(utc_ms) > 0) & (F.col(device_s) > 1))
    return kept.groupBy(*keys).agg(F.median(F.col(utc_ms) / 1000 - F.col(device_s)).alias("offset"))


def _shares(binned: DataFrame, keys: Sequence[str], bins: Sequence[str]) -> DataFrame:
    counts = binned.groupBy(*keys, *bins).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def magnitude_histogram(flow: DataFrame, key: str, dx: str, dy: str, bins: int = 32, top: float = 50.0) -> DataFrame:
    """Shares by magnitude; the last bin has its upper edge, larger magnitudes are left out."""
    size = F.sqrt(F.col(dx) * F.col(dx) + F.col(dy) * F.col(dy))
    bin_no = F.least(F.floor(size / (top / bins)), F.lit(bins - 1)).cast("int")
    return _shares(flow.select(key, size.alias("size__"), bin_no.alias("bin")).where(F.col("size__") <= top), [key], ["bin"])


def direction_histogram(flow: DataFrame, key: str, dx: str, dy: str, angles: int = 8, magnitudes: int = 4, top: float = 50.0) -> DataFrame:
    """Shares by direction and magnitude; values beyond the outer edges count in the outer bins."""
    size = F.sqrt(F.col(dx) * F.col(dx) + F.col(dy) * F.col(dy))
    turn = (F.atan2(F.col(dy), F.col(dx)) + math.pi) / (2 * math.pi)
    clipped = lambda c, n: F.least(F.greatest(F.floor(c), F.lit(0)), F.lit(n - 1)).cast("int")
    return _shares(flow.select(key, clipped(turn * angles, angles).alias("angle_bin"), clipped(size / (top / magnitudes), magnitudes).alias("mag_bin")), [key], ["angle_bin", "mag_bin"])
