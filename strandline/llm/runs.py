"""Collapse runs of repeated consecutive events: associative run summaries over range-sorted chunks.

Every range-sorted chunk encodes its runs locally.  A chunk is then described by one small, fixed-size
summary; summaries combine associatively, so a tree-shaped prefix merge tells each chunk which run is still
open where it begins.  Rows of the chunk's leading runs that continue the open run take its id, and one
aggregation over those border runs (with map-side combine) joins the pieces.  A sequence of any length is
spread over as many chunks as its rows fill.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from typing import TypeVar

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.scratch import Scratch

S = TypeVar("S")


def prefix_merge(items: Sequence[S], merge: Callable[[S, S], S]) -> list[S | None]:
    """Exclusive prefix combination of ``items`` by an associative ``merge``, by up- and down-sweep of a tree."""
    if not items:
        return []
    if len(items) == 1:
        return [None]
    paired = [merge(a, b) for a, b in zip(items[::2], items[1::2])]
    above = prefix_merge(paired if len(items) % 2 == 0 else [*paired, items[-1]], merge)
    out: list[S | None] = []
    for k, item in enumerate(items):
        before = above[k // 2]
        out.append(before if k % 2 == 0 else items[k - 1] if before is None else merge(before, items[k - 1]))
    return out


@dataclass(frozen=True)
class ChunkEdge:
    """What a chunk tells the chunks after it: its outer keys, and the run open at its end."""

    first_key: tuple
    last_key: tuple
    one_stretch: bool  # all rows share one (sequence, label)
    reach: int  # furthest end within the last stretch
    open_start: int  # the run open at the end
    open_id: int


def merge_edges(a: ChunkEdge, b: ChunkEdge, gap: int) -> ChunkEdge:
    if not b.one_stretch or a.last_key != b.first_key:
        return replace(b, first_key=a.first_key, one_stretch=False)
    joined = replace(b, first_key=a.first_key, one_stretch=a.one_stretch, reach=max(a.reach, b.reach))
    if b.open_start <= a.reach + gap:
        joined = replace(joined, open_start=a.open_start, open_id=a.open_id)
    return joined


_RUN = T.StructType(
    [
        T.StructField("run_id", T.LongType()),
        T.StructField("chunk", T.IntegerType()),
        T.StructField("sequence", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("leading", T.BooleanType()),
        T.StructField("last", T.BooleanType()),
    ]
)


def _encode(gap: int):
    """Kernel: a chunk's sorted events in, its runs out; like rows count once.  Only the open run and the last row are
    carried between batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk = TaskContext.get().partitionId()
        carry: dict | None = None  # the open run, with the furthest end of its stretch
        in_first = True  # still in the chunk's first stretch
        made = 0
        last: tuple | None = None
        for b in batches:
            if b.empty:
                continue
            # like rows are neighbours, and in one chunk, for the chunks are ranges of whole rows
            again = np.ones(len(b), bool)
            for c in b.columns:
                values = b[c].to_numpy()
                again[1:] &= values[1:] == values[:-1]
            now = tuple(b.iloc[0])
            again[0] = last is not None and now == last
            last = tuple(b.iloc[-1])
            b = b[~again]
            if b.empty:
                continue
            seq, label = b["sequence"].to_numpy(), b["label"].to_numpy()
            start, end = b["start"].to_numpy(np.int64), b["end"].to_numpy(np.int64)
            border = np.r_[True, (seq[1:] != seq[:-1]) | (label[1:] != label[:-1])]
            goes_on = carry is not None and (seq[0], label[0]) == (carry["sequence"], carry["label"])
            in_first = in_first and (carry is None or goes_on)
            stretch = np.cumsum(border)
            # furthest end so far within each stretch: the ends' ranks, which are small whatever the ends, are lifted by
            # stretch so that one running maximum serves all
            ends, rank = np.unique(end, return_inverse=True)
            lift = stretch * len(ends)
            reach = ends[np.maximum.accumulate(rank + lift) - lift]
            if goes_on:
                own = stretch == 1
                reach[own] = np.maximum(reach[own], carry["reach"])
            before = np.r_[np.int64(carry["reach"] if goes_on else 0), reach[:-1]]
            # the distance is below 2 ** 64 and taken without a sign, so it is right for any start and end
            beyond = (start > before) & (start.view(np.uint64) - before.view(np.uint64) > np.uint64(gap))
            opens = (border & ~np.r_[goes_on, np.zeros(len(b) - 1, bool)]) | beyond
            heads = np.flatnonzero(opens)
            bounds = np.r_[heads, len(b)]
            if bounds[0] > 0:  # the carried run grows first
                carry["n"] += int(bounds[0])
                carry["end"] = max(carry["end"], int(end[: bounds[0]].max()))
                carry["reach"] = int(reach[bounds[0] - 1])
            if len(heads) == 0:
                continue  # one stretch only, so in_first stays as it is
            runs = pd.DataFrame({"sequence": seq[heads], "label": label[heads], "start": start[heads], "end": np.maximum.reduceat(end, heads), "n": np.diff(bounds), "reach": reach[bounds[1:] - 1]})
            runs["leading"] = in_first & (stretch[heads] == 1)
            if carry is not None:
                runs = pd.concat([pd.DataFrame([carry])[[*runs.columns]], runs], ignore_index=True)
            in_first = in_first and bool(stretch[-1] == 1)
            carry = runs.iloc[-1].to_dict()
            done = runs.iloc[:-1]
            if len(done):
                yield _rows(done, chunk, made, False)
                made += len(done)
        if carry is not None:
            yield _rows(pd.DataFrame([carry]), chunk, made, True)

    def _rows(runs: pd.DataFrame, chunk: int, made: int, last: bool) -> pd.DataFrame:
        return runs.assign(run_id=(np.int64(chunk) << 40) + made + np.arange(len(runs)), chunk=np.int32(chunk), last=last)[[f.name for f in _RUN.fields]]

    return run


def collapse_runs(events: DataFrame, sequence: str, label: str, start: str, end: str, tie: str, gap: int) -> DataFrame:
    """Each run of like consecutive events once: (sequence, label, start, end, n_events, duration).

    Within a sequence events are ordered by ``start``, ``end``, ``tie``.  An event continues the run of the
    one before it if it has the same label and starts at most ``gap`` after the furthest end of the run so
    far; the run's end is that furthest end, its duration end - start.  Events with a null in any of the
    columns, or whose end isn't after their start, take no part.  Rows alike in all five columns count once.
    ``sequence`` and ``label`` come back with their own types.  An empty input gives no rows.
    ``start`` and ``end`` are whole numbers up to 64 bits (frames, or times in any unit, before or after zero);
    other types raise.  A duration beyond 64 bits is null.
    """
    spark = events.sparkSession
    if gap < 0:
        raise ValueError("gap must not be negative")
    for c in (start, end):
        if not isinstance(events.schema[c].dataType, T.IntegralType):
            raise TypeError(f"{c} must be a whole number; cast times to a unit of your own first")
    scratch = Scratch(spark, "runs")
    types = {c: events.schema[c].dataType for c in (sequence, label)}
    use = events.select(F.col(sequence).cast("string").alias("sequence"), F.col(label).cast("string").alias("label"), F.col(start).cast("long").alias("start"), F.col(end).cast("long").alias("end"), F.col(tie).alias("tie"))
    use = use.dropna().where(F.col("end") > F.col("start"))
    keys = ["sequence", "start", "end", "tie", "label"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = use.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    runs = scratch.table(chunks.mapInPandas(_encode(gap), _RUN))

    # One summary row per chunk (there are as many chunks as shuffle partitions, whatever the data).
    # A chunk's last run is opened only beyond the reach of those before it, so its end is the chunk's reach.
    summary = runs.groupBy("chunk").agg(
        F.min_by(F.struct("sequence", "label"), "run_id").alias("first_key"),
        F.max_by(F.struct("sequence", "label"), "run_id").alias("last_key"),
        F.min("leading").alias("one_stretch"),
        F.max_by("end", "run_id").alias("reach"),
        F.max_by("start", "run_id").alias("open_start"),
        F.max("run_id").alias("open_id"),
    )
    rows = sorted(summary.collect())
    items = [ChunkEdge(tuple(r.first_key), tuple(r.last_key), r.one_stretch, r.reach, r.open_start, r.open_id) for r in rows]
    carried = prefix_merge(items, lambda a, b: merge_edges(a, b, gap))
    carry_rows = [(r.chunk, c.reach, c.open_id) for r, i, c in zip(rows, items, carried) if c is not None and c.last_key == i.first_key]
    open_at = spark.createDataFrame(carry_rows, "chunk int, open_reach long, open_run long")

    # open_at has at most one row per chunk, so it may be broadcast
    joined = runs.join(F.broadcast(open_at), "chunk", "left")
    near = (F.col("start") <= F.col("open_reach")) | (F.col("start").cast("decimal(20,0)") - F.col("open_reach").cast("decimal(20,0)") <= gap)
    goes_on = F.coalesce(F.col("leading") & near, F.lit(False))
    joined = joined.withColumn("whole", F.when(goes_on, F.col("open_run")).otherwise(F.col("run_id"))).withColumn("border", goes_on | F.col("last"))
    inner = joined.where("not border").select("sequence", "label", "start", "end", "n")
    border = joined.where("border").groupBy("whole").agg(F.first("sequence").alias("sequence"), F.first("label").alias("label"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("whole")
    out = inner.unionByName(border)
    return out.select(F.col("sequence").cast(types[sequence]).alias(sequence), F.col("label").cast(types[label]).alias(label), F.col("start").cast(events.schema[start].dataType).alias(start), F.col("end").cast(events.schema[end].dataType).alias(end), F.col("n").alias("n_events"), F.try_subtract("end", "start").alias("duration"))
