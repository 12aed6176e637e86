"""Aggregations over answers, manifests, sessions and folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.metrics import midranks


def relationship_buckets(pairs: DataFrame, relationship: str, negative: str, types: Sequence[str]) -> DataFrame:
    """``pairs`` with bucket and label: positives in their own type's bucket and _all, negatives in every bucket."""
    own = F.array(F.lit("_all"), F.col(relationship))
    every = F.array(F.lit("_all"), *(F.lit(t) for t in types))
    known = pairs.where(F.col(relationship).isin(negative, *types))
    buckets = F.when(F.col(relationship) == negative, every).otherwise(own)
    return known.withColumn("bucket", F.explode(buckets)).withColumn("label", (F.col(relationship) != negative).cast("int"))


def balanced_accuracy(answers: DataFrame, prompt: str, condition: str, answer: str) -> DataFrame:
    """(prompt, fwd_acc, rev_acc, balanced): answers that say nothing don't count, denominators are at least 1."""

    def accuracy(cond: str, right: str):
        mine = (F.col(condition) == cond) & F.col(answer).isNotNull()
        return F.sum((mine & (F.col(answer) == right)).cast("int")) / F.greatest(F.sum(mine.cast("int")), F.lit(1))

    out = answers.groupBy(prompt).agg(accuracy("forward", "FORWARD").alias("fwd_acc"), accuracy("reverse", "REVERSE").alias("rev_acc"))
    return out.withColumn("balanced", (F.col("fwd_acc") + F.col("rev_acc")) / 2)


def integrity_consistency(answers: DataFrame, clip: str, condition: str, answer: str) -> DataFrame:
    """(condition, acc): per condition, and as 'consistency' the share of clips without a wrong answer (no answer isn't wrong)."""
    right = F.when(F.col(condition) == "forward", F.col(answer) == "INTACT").otherwise(F.col(answer) == "TAMPERED")
    rows = answers.withColumn("right__", right)
    by_condition = rows.groupBy(condition).agg((F.sum(F.coalesce(F.col("right__").cast("int"), F.lit(0))) / F.greatest(F.count("right__"), F.lit(1))).alias("acc"))
    clips = rows.groupBy(clip).agg(F.bool_and(F.coalesce("right__", F.lit(True))).alias("all__"))
    whole = clips.agg(F.lit("consistency").alias(condition), F.coalesce(F.avg(F.col("all__").cast("double")), F.lit(0.0)).alias("acc"))
    return by_condition.unionByName(whole)


def share_of(answers: DataFrame, answer: str, word: str) -> DataFrame:
    """(share): of the answers that say something."""
    return answers.agg((F.sum(F.coalesce((F.col(answer) == word).cast("int"), F.lit(0))) / F.greatest(F.count(answer), F.lit(1))).alias("share"))


def group_stats(rows: DataFrame, group: str, video: str) -> DataFrame:
    """(group, n, n_videos, place): by falling count, then group."""
    stats = rows.groupBy(group).agg(F.count("*").alias("n"), F.count_distinct(video).alias("n_videos"))
    # one row per group is ranked
    return stats.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), group)))


def top_groups(rows: DataFrame, group: str, k: int) -> DataFrame:
    counts = rows.groupBy(group).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), group).limit(k)


def cumulative_distinct(rows: DataFrame, group: str, item: str) -> DataFrame:
    """(place, group, n_so_far, items_so_far): distinct items over the largest groups down to each."""
    stats = group_stats(rows, group, item)
    first = rows.select(group, item).distinct().join(stats.select(group, "place"), group).groupBy(item).agg(F.min("place").alias("place")).groupBy("place").agg(F.count("*").alias("new"))
    w = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return stats.join(first, "place", "left").select("place", group, F.sum("n").over(w).alias("n_so_far"), F.sum(F.coalesce("new", F.lit(0))).over(w).alias("items_so_far"))


def duration_bins(rows: DataFrame, duration: str, edges: Sequence[float]) -> DataFrame:
    """(bin, n) of half-open bins between the edges; bins without rows are there with 0."""
    spark = rows.sparkSession
    inside = None
    for k in range(len(edges) - 1):
        inside = F.when((F.col(duration) >= edges[k]) & (F.col(duration) < edges[k + 1]), k) if inside is None else inside.when((F.col(duration) >= edges[k]) & (F.col(duration) < edges[k + 1]), k)
    counts = rows.select(inside.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    bins = spark.createDataFrame([(k,) for k in range(len(edges) - 1)], "bin int")
    return bins.join(counts, "bin", "left").fillna(0, ["n"])


def completeness(needed: DataFrame, available: DataFrame, id: str) -> DataFrame:
    """(prefix, n_missing, n_present) by the part of the id before the first ``_``."""
    have = available.select(F.col(id).alias("have__")).distinct()
    rows = needed.select(id).distinct().join(have, F.col(id) == F.col("have__"), "left")
    return rows.groupBy(F.split(F.col(id).cast("string"), "_")[0].alias("prefix")).agg(F.sum(F.col("have__").isNull().cast("long")).alias("n_missing"), F.count("have__").alias("n_present"))


def fold_curve(folds: DataFrame, values: str, steps: int) -> DataFrame:
    """(alpha, mean): mean over folds at each place of an even grid from 0 to 1."""
    return folds.select(F.posexplode(values).alias("place", "v")).groupBy("place").agg(F.avg("v").alias("mean")).select((F.col("place") / float(steps - 1)).alias("alpha"), "mean")


def pearson(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.agg(F.corr(x, y).alias("r"))


def spearman(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """(keys, r): correlation of average ranks."""
    ranked = midranks(midranks(rows, keys, x, "rx__"), keys, y, "ry__")
    return ranked.groupBy(*keys).agg(F.corr("rx__", "ry__").alias("r"))


def session_stats(rows: DataFrame, session: str, label: str, labels: Sequence, duration: str) -> DataFrame:
    """(session, duration, one count per label): sessions, and a TOTAL row of all."""
    counts = [F.sum((F.col(label) == x).cast("long")).alias(f"n_{x}") for x in labels]
    return rows.rollup(session).agg(F.sum(duration).alias("duration"), *counts, F.grouping(session).alias("g__")).select(F.when(F.col("g__") == 1, F.lit("TOTAL")).otherwise(F.col(session)).alias(session), "duration", *(f"n_{x}" for x in labels))
