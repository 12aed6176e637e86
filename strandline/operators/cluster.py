"""Density clusters of points: a near-pair join, then least labels over core points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.near import near_pairs
from strandline.operators.positions import numbered_values
from strandline.scratch import Scratch


def least_labels(nodes: DataFrame, node: str, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, label): the smallest node reachable by ``edges`` (a, b), each node itself included.

    Every round takes the least label among neighbours and then that label's own label, so labels travel ever further;
    rounds are written to the shared folder.
    """
    scratch = Scratch(nodes.sparkSession, "labels")
    both = scratch.table(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch.table(nodes.select(F.col(node).alias("node"), F.col(node).alias("label")).distinct())
    for _ in range(max_rounds):
        heard = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        stepped = labels.join(heard, "node", "left").select("node", "label", F.least("label", F.coalesce("heard", "label")).alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        moved = stepped.join(jump, "near", "left").select("node", F.col("label").alias("old"), F.least("near", F.coalesce("far", "near")).alias("label"))
        after = scratch.table(moved, changed=F.count_if(F.col("old") != F.col("label")))
        changed = after.measured["changed"]
        scratch.drop(labels)
        labels = after.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("node", node)
    raise RuntimeError(f"labels still change after {max_rounds} rounds")


def dbscan(points: DataFrame, id: str, at: Sequence[Column], eps: float, min_samples: int) -> DataFrame:
    """(id, cluster): points with at least ``min_samples`` within ``eps`` (themselves included) are cores; cores near
    each other share a cluster, other points near a core join the cluster whose first core comes first by id.
    Clusters are numbered from 0 in that order; noise has no row.
    """
    scratch = Scratch(points.sparkSession, "dbscan")
    pairs = scratch.table(near_pairs(points, id, at, eps))
    both = pairs.unionAll(pairs.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b")))
    # a point without neighbours is a core only if it suffices by itself
    degree = both.groupBy("id_a").agg(F.count("*").alias("n"))
    if min_samples <= 1:
        cores = points.select(F.col(id).alias("core")).dropna().distinct()
    else:
        cores = degree.where(F.col("n") + 1 >= min_samples).select(F.col("id_a").alias("core"))
    cores = scratch.table(cores)
    linked = pairs.join(cores.select(F.col("core").alias("id_a")), "id_a", "left_semi").join(cores.select(F.col("core").alias("id_b")), "id_b", "left_semi")
    labels = least_labels(cores, "core", linked.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))
    border = both.join(cores.select(F.col("core").alias("id_a")), "id_a", "left_anti").join(labels.select(F.col("core").alias("id_b"), "label"), "id_b").groupBy(F.col("id_a").alias("core")).agg(F.min("label").alias("label"))
    members = scratch.table(labels.unionByName(border))
    return members.join(numbered_values(members, "label", "cluster"), "label").select(F.col("core").alias(id), "cluster")
