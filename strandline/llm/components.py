"""Connected components of pair links by alternating large-star and small-star rewrites.

An edge list is kept as (u, v) with v < u.  Large-star links every larger neighbour of a node to the node's
smallest neighbour, small-star links all smaller neighbours and the node itself to the smallest one.  Both keep
connectivity and never add edges; alternating them ends in stars around each component's smallest record.
Every rewrite is an aggregation (with map-side combine) and an equi-join with one row per key on one side, so
a hub holding a third of all edges is streamed and split by AQE's skew join, never gathered.  Each
round is written to the shared folder; nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.scratch import Scratch


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    bigger = both.where("v > u")
    return bigger.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    rewritten = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rewritten.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _state() -> dict[str, Column]:
    """Taken while a round is written, so a round costs one job."""
    return {"n": F.count(F.lit(1)), "hash": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}


def connected_components(pairs: DataFrame, a: str, b: str, max_rounds: int = 60, records: DataFrame | None = None, record: str | None = None) -> DataFrame:
    """(record, group) for every record with at least one link: ``group`` is its component's smallest record.

    ``pairs`` links column ``a`` with column ``b`` (of one orderable type).  Direction and repetition make no
    difference; pairs with a null end and pairs of a record with itself link nothing.  No pairs, no rows.
    With ``records``, every non-null value of its column ``record`` comes out as well, once; one without a link is
    a group of its own.  Rounds go on until a round changes nothing; needing more than ``max_rounds`` raises, it never
    cuts off.
    """
    scratch = Scratch(pairs.sparkSession, "components")
    clean = pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).dropna().where("x <> y")
    edges = scratch.table(clean.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), **_state())
    for _ in range(max_rounds):
        if not edges.measured["n"]:
            break
        after = scratch.table(_small_star(_large_star(edges)), **_state())
        scratch.drop(edges)
        settled = after.measured == edges.measured
        edges = after
        if settled:
            break
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    members = edges.select(F.col("u").alias("record"), F.col("v").alias("group"))
    heads = edges.select(F.col("v").alias("record"), F.col("v").alias("group")).distinct()
    grouped = members.unionAll(heads)
    if records is None:
        return grouped
    every = records.select(F.col(record).alias("record")).dropna().unionAll(grouped.select("record")).distinct()
    return every.join(grouped, "record", "left").select("record", F.coalesce("group", "record").alias("group"))


def relationship_links(relationships: DataFrame, videos: DataFrame) -> DataFrame:
    """The pairs of two different known videos whose relationship says that they belong together.

    A relationship is read without regard to case, surrounding or repeated white space, ``_`` or ``-`` for a
    blank, and ``&`` or ``+`` for "and"; null and anything else (remarks, negations) links nothing.
    """
    word = F.lower(F.col("relationship"))
    word = F.regexp_replace(word, r"[&+]", " and ")
    word = F.regexp_replace(word, r"(?U)[\s_-]+", " ")
    word = F.regexp_replace(word, r"^ | $", "")
    known = videos.select("video_id").dropna().distinct()
    linked = relationships.where(word.isin("copy", "event", "copy and event", "reasoning") & (F.col("video1_id") != F.col("video2_id")))
    linked = linked.select("video1_id", "video2_id").distinct()
    linked = linked.join(known.withColumnRenamed("video_id", "video1_id"), "video1_id", "left_semi")
    return linked.join(known.withColumnRenamed("video_id", "video2_id"), "video2_id", "left_semi").select("video1_id", "video2_id")
