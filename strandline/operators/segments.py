"""Segments of label streams, thresholds on signals, slots and sliding windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gaps_and_islands(frames: DataFrame, keys: Sequence[str], order: str, label: str, targets: Sequence | None = None, bucket: int = 100_000) -> DataFrame:
    """(keys, label, start, end, n): stretches of equal labels as [start, end); only labels in ``targets``.

    Any other label, and a null one, ends a stretch; rows with a null place take no part.  ``end`` is the place after the
    stretch's last.  Stretches are found within buckets of ``bucket`` places, so a key of any length is many tasks; then
    the first and last stretch of each bucket, at most two rows, are joined with those of its neighbours.
    """
    shown = F.col(label) if targets is None else F.when(F.col(label).isin(list(targets)), F.col(label))
    rows = frames.where(F.col(order).isNotNull()).select(*keys, F.col(order).alias("o__"), shown.alias("l__"), F.floor(F.col(order) / bucket).alias("b__"))
    local = Window.partitionBy(*keys, "b__").orderBy("o__")
    rows = rows.withColumn("new__", (F.row_number().over(local) == 1) | ~F.col("l__").eqNullSafe(F.lag("l__").over(local)))
    rows = rows.withColumn("run__", F.sum(F.col("new__").cast("int")).over(local.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max("run__").over(Window.partitionBy(*keys, "b__"))
    runs = rows.groupBy(*keys, "b__", "run__").agg(F.first("l__").alias("l__"), F.min("o__").alias("start"), F.max("o__").alias("stop__"), F.count("*").alias("n")).withColumn("last__", F.col("run__") == last)
    first = F.col("run__") == 1
    inner = runs.where(~first & ~F.col("last__")).select(*keys, "l__", "start", "stop__", "n")
    border = runs.where(first | F.col("last__"))
    along = Window.partitionBy(*keys).orderBy("start")
    goes_on = first & F.lag("last__").over(along) & F.col("l__").eqNullSafe(F.lag("l__").over(along)) & F.lag("b__").over(along).isNotNull()
    border = border.withColumn("opens__", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("whole__", F.sum("opens__").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    joined = border.groupBy(*keys, "whole__").agg(F.first("l__").alias("l__"), F.min("start").alias("start"), F.max("stop__").alias("stop__"), F.sum("n").alias("n")).drop("whole__")
    out = inner.unionByName(joined.select(inner.columns)).where(F.col("l__").isNotNull())
    return out.select(*keys, F.col("l__").alias(label), "start", (F.col("stop__") + 1).alias("end"), "n")


def count_run_starts(frames: DataFrame, keys: Sequence[str], order: str, label: str, nothing) -> DataFrame:
    """(keys, label, n): how many stretches of each label other than ``nothing`` there are; a null label is a stretch's end."""
    runs = gaps_and_islands(frames, keys, order, label).where(F.col(label) != F.lit(nothing))
    return runs.groupBy(*keys, label).agg(F.count("*").alias("n"))


def midpoint_seconds(start: Column, end: Column, origin: Column, fps: float = 3.0) -> Column:
    return origin + F.floor((start + end) / 2) / fps


def turn_label(speed: Column, yaw: Column, steer: Column) -> Column:
    """0 standing, 2 left, 3 right, 1 anything else."""
    return F.when(speed < 0.5, 0).when((yaw > 0.02) & (steer > 0.5), 2).when((yaw < -0.02) & (steer < -0.5), 3).otherwise(1)


def uniform_slots(clips: DataFrame, duration: str, slots: int = 20, length: float = 10.0, margin: float = 30.0) -> DataFrame:
    """``clips`` times slot (0-based) with start and stop: even spacing between the margins; too short ones have none."""
    room = F.col(duration) - 2 * margin - length
    step = room / (slots - 1) if slots > 1 else F.lit(0.0)
    slot = F.explode(F.sequence(F.lit(0), F.lit(max(slots, 1) - 1))).alias("slot")
    placed = clips.where(room >= 0).select("*", slot)
    start = F.lit(margin) + F.col("slot") * step
    return placed.withColumn("start", start).withColumn("stop", start + length)


def sliding_windows(rows: DataFrame, group: Sequence[str], start: str, stop: str, id: str, sizes: Sequence[int] = (2, 3), least: float = 6.0, most: float = 15.0) -> DataFrame:
    """(group, start, stop, duration, size, ids): windows of successive rows lasting least..most seconds.

    Of windows of a group with the same start the one of most rows stays.  Rows go by start, then id.
    """
    w = Window.partitionBy(*group).orderBy(start, id)
    made = None
    base = rows.select(*group, start, stop, id)
    for size in sizes:
        part = base.withColumn("stop__", F.lead(stop, size - 1).over(w)).withColumn("ids", F.collect_list(id).over(w.rowsBetween(0, size - 1))).withColumn("place__", F.row_number().over(w))
        part = part.where(F.col("stop__").isNotNull()).select(*group, F.col(start).alias("start"), F.col("stop__").alias("stop"), (F.col("stop__") - F.col(start)).alias("duration"), F.lit(size).alias("size"), "ids", "place__")
        made = part if made is None else made.unionByName(part)
    fit = made.where(F.col("duration").between(least, most))
    best = F.row_number().over(Window.partitionBy(*group, "start").orderBy(F.desc("size"), "place__"))
    return fit.withColumn("best__", best).where("best__ = 1").drop("best__", "place__")


def sample_per_group(rows: DataFrame, group: str, id: str, n: int, seed: int) -> DataFrame:
    """``n`` rows of each group, those of the smallest md5 keys of (group, id, seed)."""
    key = F.md5(F.concat_ws("|", F.col(group).cast("string"), F.col(id).cast("string"), F.lit(str(seed))))
    place = F.row_number().over(Window.partitionBy(group).orderBy("key__", id))
    return rows.withColumn("key__", key).withColumn("place__", place).where(F.col("place__") <= n).drop("key__", "place__")
