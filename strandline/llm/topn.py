"""The N best items of every group, by one global range-partitioned sort.

Plan: project to (group, item, sort keys) -> range partition on (group, keys, item) -> sort inside partitions
-> an Arrow kernel numbers the distinct items of each group as it streams through a partition and keeps at
most N of each -> the few groups that lie across partition borders get exact positions from a prefix sum of
the per-partition counts.  A group of any size is spread over as many partitions as its rows fill; no task
ever holds more than N rows of a group, and the only shuffle of the whole input is the sort's.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.scratch import Scratch


class By:
    """A sort key: an expression with its direction."""

    def __init__(self, expr: Column | str, descending: bool = False, nulls_last: bool = True):
        self.expr = F.col(expr) if isinstance(expr, str) else expr
        self.method = ("desc" if descending else "asc") + ("_nulls_last" if nulls_last else "_nulls_first")


def _key(key: By, j: int) -> Column:
    return key.expr.alias(f"s{j}__")


def _direction(key: By, name: str) -> Column:
    return getattr(F.col(name), key.method)()


def _number(group: str, item: str, n: int):
    """Kernel: sorted batches in, the first ``n`` distinct items of every group out, with local positions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid = TaskContext.get().partitionId()
        held: pd.DataFrame | None = None  # kept rows (at most n) of the group that the last batch ended in
        first_code: list = []

        def mark(rows: pd.DataFrame, last: bool) -> pd.DataFrame:
            same = rows[group].isna() if pd.isna(first_code[0]) else rows[group].eq(first_code[0])
            return rows.assign(edge=same.fillna(False).astype(bool) | last)

        for batch in batches:
            if batch.empty:
                continue
            if not first_code:
                first_code.append(batch[group].iloc[0])
            if held is not None:
                batch = pd.concat([held[batch.columns], batch], ignore_index=True)
            codes = pd.factorize(batch[group], use_na_sentinel=False)[0]
            items = pd.factorize(batch[item], use_na_sentinel=False)[0]
            # sorted input: equal groups are adjacent, so codes rise by one at each border
            fresh = ~pd.Series(codes.astype(np.int64) * (items.max() + 1) + items).duplicated().to_numpy()
            batch, codes = batch[fresh], codes[fresh]
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            pos = np.arange(len(codes)) - np.repeat(starts, np.diff(np.r_[starts, len(codes)])) + 1
            keep = pos <= n
            batch = batch[keep].assign(pid=np.int32(pid), pos=pos[keep].astype(np.int32))
            tail = codes[keep] == codes[-1]
            held = batch[tail].drop(columns=["pid", "pos"])
            done = batch[~tail]
            if len(done):
                yield mark(done, False)
        if held is not None and len(held):
            yield mark(held.assign(pid=np.int32(pid), pos=np.arange(1, len(held) + 1, dtype=np.int32)), True)

    return run


def top_n_per_group(df: DataFrame, group: str, item: str, order: Sequence[By], n: int, keep: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` distinct ``item`` of each ``group`` in the order of ``order``, then ``item`` rising.

    Result: ``group``, ``item``, the columns ``keep`` (of the item's first row) and ``position`` (1-based).
    ``order`` holds ``By`` keys; ties in all of them fall to ``item``, so the
    result is one definite set.  An item that comes up repeatedly counts once, by its first row.  A null group
    is a group of its own and a null item an item like any other (sorted first).  An empty input, or ``n`` < 1,
    gives no rows.  Other columns of ``df``, whatever they are called, play no part.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "topn")
    keep = [c for c in keep if c not in (group, item)]
    g, i = "g__", "i__"
    kept = [f"k{j}__" for j in range(len(keep))]
    ranked = df.select(F.col(group).alias(g), F.col(item).alias(i), *(F.col(c).alias(k) for c, k in zip(keep, kept)), *(_key(o, j) for j, o in enumerate(order)))
    keys = [F.col(g).asc_nulls_first(), *(_direction(o, f"s{j}__") for j, o in enumerate(order)), F.col(i).asc_nulls_first()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    payload = [g, i, *kept]
    kernel_schema = T.StructType([ranked.schema[c] for c in payload] + [T.StructField("pid", T.IntegerType()), T.StructField("pos", T.IntegerType()), T.StructField("edge", T.BooleanType())])
    local = ranked.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select(*payload).mapInPandas(_number(g, i, max(n, 0)), kernel_schema)
    local = scratch.table(local)

    # Groups that reach over a partition border: at most 2 * n rows of each partition take part.
    edge = local.where("edge")
    once = edge.groupBy(g, i).agg(F.min_by(F.struct("pid", "pos", *kept), F.struct("pid", "pos")).alias("at")).select(g, i, "at.*")
    once = once.withColumn("local_rank", F.row_number().over(Window.partitionBy(g, "pid").orderBy("pos")))
    counts = edge_offsets(once, g)
    null_safe = F.col(f"c.{g}").eqNullSafe(F.col(f"o.{g}")) & (F.col("c.pid") == F.col("o.pid"))
    placed = once.alias("c").join(counts.alias("o"), null_safe).select(*(F.col(f"c.{c}") for c in payload), (F.col("o.before") + F.col("c.local_rank")).cast("int").alias("position"))
    inner = local.where("not edge").select(*payload, F.col("pos").alias("position"))
    out = inner.unionByName(placed.where(F.col("position") <= n))
    return out.select(F.col(g).alias(group), F.col(i).alias(item), *(F.col(k).alias(c) for c, k in zip(keep, kept)), "position")


def edge_offsets(rows: DataFrame, group: str) -> DataFrame:
    """Exclusive prefix sum over partitions of the number of a group's items: (group, pid, before)."""
    counts = rows.groupBy(group, "pid").agg(F.count("*").alias("n"))
    before = Window.partitionBy(group).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(group, "pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
