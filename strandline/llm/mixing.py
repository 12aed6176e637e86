"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

The total is cut into blocks of equally many tokens.  Blocks go to the sources, and a source's blocks to its
shards, by highest quotient (weight / (2 * blocks so far + 1)), which gives whole quotas nearest to the
weights.  Each shard then takes every document as often as its quota covers the whole shard, and fills the
rest from a seeded order of its documents, the last of which may go over a block's end.

A source has a power of two of shards, at most ``SHARDS``, whatever the corpus; below that one for every
``SHARD_DOCUMENTS`` documents, so shards split in two when a source doubles, and small sources stay whole.  A source with a
third of all rows is as many tasks as it has shards.  The driver sees one row per listed source; quotas of shards are made
where the shard sizes are, one source a task.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.scratch import Scratch

SHARDS = 4096  # of a source, at most
SHARD_DOCUMENTS = 50_000  # of a source's documents to a shard, at least, where it has more than one
SOURCES = 100_000  # listed sources, at most: they are rows of a table of goals, and more raise


def sainte_lague(weights: Sequence[float], seats: int, caps: Sequence[int]) -> list[int]:
    """Whole numbers of seats by highest quotients w / (2 s + 1), none above its cap; ties go to the earlier.

    Fewer than ``seats`` are given out only where all caps (or weights) are used up.
    """
    w = np.array([x if x > 0 and c > 0 else 0.0 for x, c in zip(weights, caps)], float)
    cap = np.maximum(np.array(caps, float), 0.0)

    def above(quotient: float) -> np.ndarray:
        """Seats whose quotient lies above the given one: those with 2 s + 1 < w / quotient."""
        return np.where(w > 0, np.minimum(cap, np.maximum(np.ceil((w / quotient - 1) / 2), 0.0)), 0.0)

    given = np.zeros(len(w))
    if w.any() and seats > 0:
        # the seats above a quotient that leaves enough for them are given out whatever the order of the rest
        low, high = 0.0, float(w.max())
        for _ in range(200):
            middle = (low + high) / 2
            if middle in (low, high):
                break
            if above(middle).sum() > seats:
                low = middle
            else:
                high = middle
        given = np.maximum(above(high) - 2, 0.0)  # 2: rounding of the division can't reach further
    out = [int(x) for x in given]
    heap = [(-weights[i] / (2 * out[i] + 1), i) for i in np.flatnonzero(w).tolist() if out[i] < caps[i]]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * out[i] + 1), i))
    return out


def source_name(source: Column) -> Column:
    """A source's name without regard to case, outer white space, and blanks or hyphens written for ``_``."""
    return F.regexp_replace(F.regexp_replace(F.lower(source), r"(?U)^\s+|\s+$", ""), r"(?U)[\s_-]+", "_")


class Mix:
    """The outcome: ``selection`` (doc, source, n_tokens, times) and ``shares`` (one row per listed source)."""

    def __init__(self, selection: DataFrame, shares: DataFrame):
        self.selection, self.shares = selection, shares


def mix_sources(documents: DataFrame, doc: str, source: str, tokens: str, targets: DataFrame, block_tokens: int = 256, total_tokens: int | None = None, seed: int = 0) -> Mix:
    """Combine documents so that each source of ``targets`` (source, target_share, max_repeats) has its share of the tokens.

    ``total_tokens``: the size of the mixture.  By default the largest at which every listed source that has
    tokens can reach its share without any document being taken more than ``max_repeats`` times; where a
    listed source has none, the others keep their proportions.  With a larger total, sources at their cap fall
    short, the rest is given to the others, and ``shares`` tells what was reached.
    Sources that aren't listed, null sources and documents without tokens are never taken.  A ``doc`` that comes
    up repeatedly counts once, under the first of its listed sources by name, with its least size; rows with a null ``doc`` that
    are alike are one document.  A null or negative target, or a cap below 1, takes nothing.  Ties in the
    seeded order (md5 of seed and ``doc``) fall to ``doc``.  Shares are met to within a block and, per shard, half of its last document.
    ``limiting`` marks in ``shares`` the source that sets the default size, which is never below one block.
    """
    if block_tokens < 1:
        raise ValueError("block_tokens must be at least 1")
    spark = documents.sparkSession
    scratch = Scratch(spark, "mixing")
    listed = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").dropna(subset=["source"]).distinct().sort("source", "target_share", "max_repeats").limit(SOURCES + 1).collect()
    if len(listed) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    goals = {r[0]: (max(r[1] or 0.0, 0.0), max(r[2] or 0, 0)) for r in listed}
    named = spark.createDataFrame([(s,) for s in goals], "source string")
    counted = documents.select(F.col(doc).alias("doc"), source_name(F.col(source)).alias("source"), F.col(tokens).cast("bigint").alias("n_tokens")).where(F.col("n_tokens") > 0)
    counted = counted.join(F.broadcast(named), "source", "left_semi")  # at most SOURCES names
    once = F.struct("source", "n_tokens")
    counted = counted.groupBy("doc", F.when(F.col("doc").isNull(), once).alias("unnamed")).agg(F.min(once).alias("row")).select("doc", "row.*")
    counted = scratch.table(counted)

    sizes = {r[0]: (r[1], r[2]) for r in counted.groupBy("source").agg(F.sum("n_tokens"), F.count("*")).collect()}  # listed sources only
    names = sorted(goals)
    have = {s: sizes.get(s, (0, 0))[0] for s in names}
    share = {s: goals[s][0] if goals[s][1] > 0 and have[s] > 0 else 0.0 for s in names}
    whole = sum(share.values())
    reach = {s: have[s] * goals[s][1] * whole / share[s] for s in names if share[s] > 0}  # the largest mixture a source has enough for
    limiting = min(reach, key=lambda s: (reach[s], s), default=None) if total_tokens is None else None
    if total_tokens is None:
        total_tokens = max(reach[limiting], block_tokens) if reach else 0
    blocks = sainte_lague([share[s] for s in names], int(total_tokens // block_tokens), [-(-have[s] * goals[s][1] // block_tokens) for s in names])
    shards = {s: min(SHARDS, 1 << ((sizes.get(s, (0, 0))[1] // SHARD_DOCUMENTS) or 1).bit_length() - 1) for s in names}
    plan = spark.createDataFrame([(s, b, shards[s], goals[s][1]) for s, b in zip(names, blocks)], "source string, blocks long, shards int, most int")

    def apportion(rows: pd.DataFrame) -> pd.DataFrame:
        """A source's blocks to its shards (at most SHARDS rows)."""
        rows = rows.sort_values("shard")
        most = int(rows["most"].iloc[0])
        held = [int(t) for t in rows["held"]]
        given = sainte_lague(held, int(rows["blocks"].iloc[0]), [-(-t * most // block_tokens) for t in held])
        wanted = [min(q * block_tokens, t * most) for q, t in zip(given, held)]
        return pd.DataFrame({"source": rows["source"], "shard": rows["shard"], "whole_times": [x // t for x, t in zip(wanted, held)], "rest": [x % t for x, t in zip(wanted, held)], "most": most})

    place = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc").cast("string")))
    sharded = counted.join(F.broadcast(plan.select("source", "shards")), "source").withColumn("place", place)
    sharded = sharded.withColumn("shard", F.pmod(F.conv(F.substring("place", 1, 8), 16, 10).cast("bigint"), F.col("shards")).cast("int")).drop("shards")
    held = sharded.groupBy("source", "shard").agg(F.sum("n_tokens").alias("held")).join(F.broadcast(plan.drop("shards")), "source")
    quotas = held.groupBy("source").applyInPandas(apportion, "source string, shard int, whole_times long, rest long, most int")

    before = F.sum("n_tokens").over(Window.partitionBy("source", "shard").orderBy("place", "doc").rowsBetween(Window.unboundedPreceding, -1))
    placed = sharded.withColumn("before", F.coalesce(before, F.lit(0))).join(quotas, ["source", "shard"])
    extra = (F.col("rest") > 0) & (F.col("before") + F.col("n_tokens") / 2 <= F.col("rest"))
    times = F.least(F.col("whole_times") + F.when(extra, 1).otherwise(0), F.col("most")).cast("int")
    selection = placed.select("doc", "source", "n_tokens", times.alias("times")).where("times > 0")

    goal_rows = [(s, goals[s][0], goals[s][1], have[s], s == limiting) for s in names]
    goal = spark.createDataFrame(goal_rows, "source string, target_share double, max_repeats int, tokens_available long, limiting boolean")
    taken = selection.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum(F.col("n_tokens") * F.col("times")).alias("tokens_taken"))
    shares = goal.join(taken, "source", "left").fillna(0, ["n_documents", "tokens_taken"])
    total = F.sum("tokens_taken").over(Window.partitionBy())  # a row a listed source
    shares = shares.withColumn("actual_share", F.when(total > 0, F.col("tokens_taken") / total).otherwise(0.0))
    return Mix(selection.withColumnRenamed("doc", doc), shares)
