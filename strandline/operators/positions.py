"""Places in an order, without one task seeing the whole of it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.scratch import Scratch


def numbered_values(values: DataFrame, value: str, out: str) -> DataFrame:
    """(value, out): distinct non-null values with their 0-based places in rising order (int).

    A range-partitioned sort numbers each partition's values; the partitions' sizes (one row each) are summed before it.
    """
    spark = values.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = values.select(value).dropna().distinct().repartitionByRange(parts, value).sortWithinPartitions(value)
    local = Scratch(spark, "places").table(ordered.withColumn("at__", F.monotonically_increasing_id()))
    part = F.shiftright("at__", 33)  # the partition's number, as that function packs it
    offsets, before = [], 0
    for p, n in sorted(tuple(r) for r in local.groupBy(part.alias("p")).count().collect()):
        offsets.append((p, before))
        before += n
    starts = F.broadcast(spark.createDataFrame(offsets, "p__ long, before__ long"))  # a row a partition
    return local.withColumn("p__", part).join(starts, "p__").select(value, (F.col("before__") + F.col("at__") - F.shiftleft("p__", 33)).cast("int").alias(out))


def numbered(rows: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], out: str, sums: Mapping[str, str] | None = None) -> DataFrame:
    """``rows`` with the 1-based place of each within ``keys`` in the order of ``order``, and running sums: name -> column.

    ``bucket`` must rise with the order and must not be null; places are counted within buckets, and the buckets' totals are
    summed before them, so a key with a third of all rows is as many tasks as it has buckets.
    """
    sums = dict(sums or {})
    b = "bucket__"
    held = rows.withColumn(b, bucket)
    inside = Window.partitionBy(*keys, b).orderBy(*order)
    held = held.withColumn(out, F.row_number().over(inside))
    for name, column in sums.items():
        held = held.withColumn(name, F.sum(column).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    totals = rows.withColumn(b, bucket).groupBy(*keys, b).agg(F.count(F.lit(1)).alias("n__"), *(F.sum(c).alias(f"{name}__") for name, c in sums.items()))
    earlier = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    totals = totals.select(*keys, b, *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"before_{c}") for c in ("n__", *(f"{name}__" for name in sums))))
    condition = F.lit(True)
    for k in (*keys, b):
        condition = condition & F.col(f"h.{k}").eqNullSafe(F.col(f"t.{k}"))
    joined = held.alias("h").join(totals.alias("t"), condition)
    added = {out: F.col(f"h.{out}") + F.col("before_n__"), **{name: F.col(f"h.{name}") + F.col(f"before_{name}__") for name in sums}}
    return joined.select(*(F.col(f"h.{c}") for c in rows.columns if c not in added), *(c.alias(name) for name, c in added.items()))
