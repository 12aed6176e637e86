"""As-of, interpolating and interval joins on time.

Rows are put into time buckets.  Nearest rows are found within (key, bucket); what lies beyond a bucket's edge comes
from one summary row per bucket.  So a key that holds a third of all rows is as many tasks as it has
buckets, and no join multiplies rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.names import free_name


def with_neighbours(left: DataFrame, right: DataFrame, keys: Sequence[str], t: str, ts: str, values: Sequence[str], bucket: float, strict_before: bool = False) -> DataFrame:
    """``left`` with ``prev`` and ``next``: structs (ts, values) of the right rows around ``t``.

    prev is the last with ts <= t (< t if ``strict_before``), next the first with ts >= t; of equal times the
    greatest (prev) and smallest (next) by values.  Missing neighbours are null.  Left rows with a null time or key keep
    null neighbours; right rows with a null time or key play no part.
    """
    prev, nxt = (free_name(n, left.columns) for n in ("prev", "next"))
    entry = F.struct(F.col(ts).alias("ts"), *(F.col(v).alias(v) for v in values))
    r = right.where(F.col(ts).isNotNull()).select(*(F.col(k).alias(f"k{i}__") for i, k in enumerate(keys)), F.col(ts).alias("at__"), entry.alias("r__"))
    left_entry = F.struct(*(F.col(c) for c in left.columns))
    l_rows = left.select(*(F.col(k).alias(f"k{i}__") for i, k in enumerate(keys)), F.col(t).alias("at__"), left_entry.alias("l__"))
    names = [f"k{i}__" for i in range(len(keys))]
    both = l_rows.withColumn("r__", F.lit(None).cast(r.schema["r__"].dataType)).unionByName(r.withColumn("l__", F.lit(None).cast(l_rows.schema["l__"].dataType)))
    both = both.withColumn("b__", F.floor(F.col("at__") / bucket)).withColumn("is_left__", F.col("r__").isNull().cast("int"))
    part = Window.partitionBy(*names, "b__")
    up = part.orderBy(F.col("at__"), F.desc("is_left__") if strict_before else F.col("is_left__"), F.col("r__")).rowsBetween(Window.unboundedPreceding, 0)
    down = part.orderBy(F.desc("at__"), F.col("is_left__"), F.desc("r__")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("p__", F.last("r__", True).over(up)).withColumn("n__", F.last("r__", True).over(down))
    ends = r.withColumn("b__", F.floor(F.col("at__") / bucket)).groupBy(*names, "b__").agg(F.max("r__").alias("hi__"), F.min("r__").alias("lo__"))
    marks = both.where("is_left__ = 1").select(*names, "b__").distinct().join(ends, [*names, "b__"], "full")
    over = Window.partitionBy(*names).orderBy("b__")
    marks = marks.withColumn("hi__", F.last("hi__", True).over(over.rowsBetween(Window.unboundedPreceding, -1))).withColumn("lo__", F.first("lo__", True).over(over.rowsBetween(1, Window.unboundedFollowing)))
    done = both.where("is_left__ = 1").join(marks, [*names, "b__"], "left")
    return done.select("l__.*", F.coalesce("p__", "hi__").alias(prev), F.coalesce("n__", "lo__").alias(nxt))


def asof_forward_clamp(left: DataFrame, right: DataFrame, keys: Sequence[str], t: str, ts: str, values: Sequence[str], bucket: float) -> DataFrame:
    """``left`` with ``match``: the first right row at or after t, or the last one where there is none."""
    rows = with_neighbours(left, right, keys, t, ts, values, bucket)
    return rows.select(*left.columns, F.coalesce(rows.columns[-1], rows.columns[-2]).alias(free_name("match", left.columns)))


def asof_nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], t: str, ts: str, values: Sequence[str], bucket: float, tie_later: bool = True) -> DataFrame:
    """``left`` with ``match``: the right row nearest in time; at equal distance the later (or earlier) one."""
    rows = with_neighbours(left, right, keys, t, ts, values, bucket)
    p, n = rows.columns[-2], rows.columns[-1]
    before, after = F.col(t) - F.col(f"{p}.ts"), F.col(f"{n}.ts") - F.col(t)
    earlier = before < after if tie_later else before <= after
    return rows.select(*left.columns, F.when(F.col(n).isNull() | earlier, F.coalesce(p, n)).otherwise(F.col(n)).alias(free_name("match", left.columns)))


def asof_interpolate(left: DataFrame, right: DataFrame, keys: Sequence[str], t: str, ts: str, value: str, bucket: float, out: str = "value_at") -> DataFrame:
    """``left`` with the right value interpolated linearly at t; outside its range the outermost value."""
    rows = with_neighbours(left, right, keys, t, ts, [value], bucket)
    p, n = rows.columns[-2], rows.columns[-1]
    pt, pv, nt, nv = F.col(f"{p}.ts"), F.col(f"{p}.{value}"), F.col(f"{n}.ts"), F.col(f"{n}.{value}")
    between = F.when(nt == pt, pv).otherwise(pv + (nv - pv) * (F.col(t) - pt) / (nt - pt))
    return rows.select(*left.columns, F.coalesce(between, pv, nv).alias(out))


def _bucket_span(start: Column, end: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(end / width)))


def interval_contains(intervals: DataFrame, points: DataFrame, keys: Sequence[str], start: str, end: str, ts: str, values: Sequence[str], width: float, id: str, out: str = "inside") -> DataFrame:
    """Every interval with the ordered list (ts, values) of the points in [start, end], both ends included.

    An interval without points, with a null end or turned round has an empty list.  Intervals are spread
    over buckets of ``width``, and joined with points by key and bucket.
    """
    spans = intervals.where(F.col(start) <= F.col(end)).select(*keys, id, F.col(start).alias("s__"), F.col(end).alias("e__"), _bucket_span(F.col(start), F.col(end), width).alias("b__"))
    placed = points.where(F.col(ts).isNotNull()).select(*keys, F.struct(F.col(ts).alias("ts"), *(F.col(v) for v in values)).alias("p__"), F.floor(F.col(ts) / width).alias("b__"))
    hits = spans.join(placed, [*keys, "b__"]).where((F.col("p__.ts") >= F.col("s__")) & (F.col("p__.ts") <= F.col("e__")))
    lists = hits.groupBy(id).agg(F.array_sort(F.collect_list("p__")).alias(out))
    joined = intervals.join(lists, id, "left")
    return joined.withColumn(out, F.coalesce(out, F.array().cast(lists.schema[out].dataType)))


def interval_overlaps(a: DataFrame, b: DataFrame, keys: Sequence[str], start: str, end: str, id: str, width: float) -> DataFrame:
    """(id_a, id_b, overlap) of all intervals of like key that overlap by more than nothing.

    A pair is found in the one bucket that holds the later start, so it comes up once.
    """
    x = a.where(F.col(start) < F.col(end)).select(*keys, F.col(id).alias("id_a"), F.col(start).alias("sa"), F.col(end).alias("ea"), _bucket_span(F.col(start), F.col(end), width).alias("b__"))
    y = b.where(F.col(start) < F.col(end)).select(*keys, F.col(id).alias("id_b"), F.col(start).alias("sb"), F.col(end).alias("eb"), _bucket_span(F.col(start), F.col(end), width).alias("b__"))
    pairs = x.join(y, [*keys, "b__"]).where((F.col("sa") < F.col("eb")) & (F.col("sb") < F.col("ea")) & (F.floor(F.greatest("sa", "sb") / width) == F.col("b__")))
    return pairs.select("id_a", "id_b", overlap(F.col("sa"), F.col("ea"), F.col("sb"), F.col("eb")).alias("overlap"))


def overlap(sa: Column, ea: Column, sb: Column, eb: Column) -> Column:
    """max(0, least end - greatest start)."""
    return F.greatest(F.lit(0.0), F.least(ea, eb) - F.greatest(sa, sb))
