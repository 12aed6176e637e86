"""Retrieval and classification metrics as aggregations.

Pooled curves need totals over all rows above a score.  A single window over one key would put all of its
distinct scores in one task, so running totals are taken in two levels: within buckets of a monotone function of
the score, and over the (at most 2,048) bucket totals of a key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.positions import numbered

_BUCKETS = 2048


def _on(keys: Sequence[str], left: str, right: str) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return condition


def score_curve(df: DataFrame, keys: Sequence[str], score: str, label: str, weight: str | None = None) -> DataFrame:
    """One row per key and distinct score: pos, neg, and tp, fp = the totals down to and including it.

    Rows with a null or NaN score, or a null label, take no part; label 1 is positive, anything else negative.
    """
    w = F.col(weight) if weight else F.lit(1)
    use = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull())
    s = F.col(score).cast("double")
    rows = use.groupBy(*keys, (s + 0.0).alias("s__")).agg(F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 1, 0).otherwise(w)).alias("neg"))
    rows = rows.withColumn("b__", F.floor(F.atan("s__") / math.pi * _BUCKETS))
    below = Window.partitionBy(*keys, "b__").orderBy(F.desc("s__")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("tp__", F.sum("pos").over(below)).withColumn("fp__", F.sum("neg").over(below))
    earlier = Window.partitionBy(*keys).orderBy(F.desc("b__")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = rows.groupBy(*keys, "b__").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    everything = Window.partitionBy(*keys)
    buckets = buckets.select(*keys, "b__", F.coalesce(F.sum("bp").over(earlier), F.lit(0)).alias("tp0"), F.coalesce(F.sum("bn").over(earlier), F.lit(0)).alias("fp0"), F.sum("bp").over(everything).alias("p"), F.sum("bn").over(everything).alias("n"))
    joined = rows.alias("r").join(buckets.alias("t"), _on([*keys, "b__"], "r", "t"))
    return joined.select(*(F.col(f"r.{k}").alias(k) for k in keys), F.col("r.s__").alias("score"), "pos", "neg", (F.col("tp__") + F.col("tp0")).alias("tp"), (F.col("fp__") + F.col("fp0")).alias("fp"), "p", "n")


def average_precision(df: DataFrame, keys: Sequence[str], score: str, label: str, weight: str | None = None) -> DataFrame:
    """(keys, ap): sum over distinct scores of recall gained times precision; equal scores count together.  NaN without positives."""
    curve = score_curve(df, keys, score, label, weight)
    gain = F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))
    summed = curve.groupBy(*keys).agg(F.sum(F.when(F.col("pos") > 0, gain)).alias("g"), F.max("p").alias("p"))
    return summed.select(*keys, F.when(F.col("p") > 0, F.col("g") / F.col("p")).otherwise(F.lit(float("nan"))).alias("ap"))


def roc_auc(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """(keys, auc): probability that a positive beats a negative, ties half.  NaN with a single class."""
    curve = score_curve(df, keys, score, label)
    wins = F.col("pos") * (F.col("n") - F.col("fp") + F.col("neg") / 2)
    summed = curve.groupBy(*keys).agg(F.sum(wins).alias("w"), F.max("p").alias("p"), F.max("n").alias("n"))
    both = (F.col("p") > 0) & (F.col("n") > 0)
    return summed.select(*keys, F.when(both, F.col("w") / (F.col("p") * F.col("n"))).otherwise(F.lit(float("nan"))).alias("auc"))


def _score_bucket(score: str, sign: int) -> Column:
    """A whole number that rises with ``sign`` * score; null and NaN stand where Spark sorts them."""
    s = F.col(score).cast("double")
    inside = (F.floor(F.atan(s) / math.pi * _BUCKETS) * sign).cast("int")
    return F.when(s.isNull(), sign * -_BUCKETS).when(F.isnan(s), sign * _BUCKETS).otherwise(inside)


def average_precision_positional(df: DataFrame, keys: Sequence[str], score: str, label: str, ties: Sequence[str]) -> DataFrame:
    """(keys, ap) of the strict ranking by falling score, then ``ties``."""
    rows = df.select(*keys, score, *ties, (F.col(label) == 1).cast("int").alias("rel"))
    ranked = numbered(rows, keys, _score_bucket(score, -1), [F.desc(score), *map(F.col, ties)], "r", {"tp": "rel"})
    out = ranked.groupBy(*keys).agg(F.sum(F.when(F.col("rel") == 1, F.col("tp") / F.col("r"))).alias("g"), F.sum("rel").alias("p"))
    return out.select(*keys, F.when(F.col("p") > 0, F.col("g") / F.col("p")).otherwise(F.lit(float("nan"))).alias("ap"))


def roc_auc_ordinal(df: DataFrame, keys: Sequence[str], score: str, label: str, ties: Sequence[str]) -> DataFrame:
    """(keys, auc) by ordinal ranks: equal scores are ranked by ``ties``."""
    rows = df.select(*keys, score, *ties, (F.col(label) == 1).cast("long").alias("rel"))
    ranked = numbered(rows, keys, _score_bucket(score, 1), [F.asc(score), *map(F.col, ties)], "r")
    out = ranked.groupBy(*keys).agg(F.sum(F.col("r") * F.col("rel")).alias("s"), F.sum("rel").alias("p"), F.count("*").alias("n"))
    neg = F.col("n") - F.col("p")
    return out.select(*keys, F.when((F.col("p") > 0) & (neg > 0), (F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * neg)).otherwise(F.lit(float("nan"))).alias("auc"))


def ranked(gallery: DataFrame, query: str, score: str, cand: str, descending: bool = True) -> DataFrame:
    """``gallery`` with the 1-based rank of each candidate; equal scores go by candidate."""
    key = F.col(score).desc_nulls_last() if descending else F.col(score).asc_nulls_last()
    return gallery.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(key, cand)))


def with_hits(rows: DataFrame, query: str, rel: str = "rel") -> DataFrame:
    """Ranked rows with ``hits``, the relevant ones so far, and ``total_rel`` of the query."""
    w = Window.partitionBy(query)
    return rows.withColumn("hits", F.sum(rel).over(w.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total_rel", F.sum(rel).over(w))


def truncated_ap(rows: DataFrame, keys: Sequence[str], rank: str, rel: str, total: str) -> DataFrame:
    """(keys, ap) over a finite ranking, divided by the total of relevant items; NaN if that isn't positive, 0 without hits."""
    hits = F.sum(rel).over(Window.partitionBy(*keys).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(rank))
    out = rows.select(*keys, rel, total, hits.alias("h"), place.alias("r")).groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col(rel) == 1, F.col("h") / F.col("r"))), F.lit(0.0)).alias("g"), F.max(total).alias("t"))
    return out.select(*keys, F.when(F.col("t") > 0, F.col("g") / F.col("t")).otherwise(F.lit(float("nan"))).alias("ap"))


def query_metrics(gallery: DataFrame, query: str, cand: str, score: str, rel: str = "rel", ks: Sequence[int] = (), descending: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    """Per query: ap, rr, n_rel, and ap/recall/ndcg at each k, over the ranking by score (ties by candidate).

    Queries with nothing relevant have null metrics.  ``keys`` name further columns that set rankings apart.
    """
    part = [*keys, query]
    order = F.col(score).desc_nulls_last() if descending else F.col(score).asc_nulls_last()
    w = Window.partitionBy(*part).orderBy(order, cand)
    rows = gallery.select(*part, F.col(rel).cast("long").alias("rel"), F.row_number().over(w).alias("r"), F.sum(F.col(rel).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("h"))
    return metrics_of_ranks(rows.where("rel = 1"), part, "r", ks, "h")


def metrics_of_ranks(hit: DataFrame, keys: Sequence[str], rank: str, ks: Sequence[int] = (), hits: str | None = None) -> DataFrame:
    """The same metrics from the relevant rows alone, with their ``rank`` among all; ``hits``: relevant ones so far, if known."""
    so_far = F.col(hits) if hits else F.row_number().over(Window.partitionBy(*keys).orderBy(rank))
    hit = hit.select(*keys, F.col(rank).alias("r"), so_far.alias("h"))
    aggs = [F.count("*").alias("n_rel"), F.sum(F.col("h") / F.col("r")).alias("g"), F.min("r").alias("first")]
    for k in ks:
        within = F.col("r") <= k
        aggs += [F.sum(F.when(within, F.col("h") / F.col("r")).otherwise(0.0)).alias(f"g{k}"), F.sum(within.cast("int")).alias(f"h{k}"), F.sum(F.when(within, 1 / F.log2(F.col("r") + 1)).otherwise(0.0)).alias(f"d{k}")]
    stats = hit.groupBy(*keys).agg(*aggs)
    out = [*keys, (F.col("g") / F.col("n_rel")).alias("ap"), (1 / F.col("first")).alias("rr"), "n_rel"]
    for k in ks:
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_rel").cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
        out += [(F.col(f"g{k}") / F.col("n_rel")).alias(f"ap_{k}"), (F.col(f"h{k}") / F.col("n_rel")).alias(f"recall_{k}"), (F.col(f"d{k}") / ideal).alias(f"ndcg_{k}")]
    return stats.select(*out)


def separation(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """(keys, n_pos, n_neg, same_mean, diff_mean, gap); with a single class the means and gap are NaN."""
    pos, neg = F.col(label) == 1, F.col(label) != 1
    out = df.where(F.col(label).isNotNull()).groupBy(*keys).agg(F.sum(pos.cast("long")).alias("n_pos"), F.sum(neg.cast("long")).alias("n_neg"), F.avg(F.when(pos, F.col(score))).alias("a"), F.avg(F.when(neg, F.col(score))).alias("b"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    nan = F.lit(float("nan"))
    return out.select(*keys, "n_pos", "n_neg", F.when(both, F.col("a")).otherwise(nan).alias("same_mean"), F.when(both, F.col("b")).otherwise(nan).alias("diff_mean"), F.when(both, F.col("a") - F.col("b")).otherwise(nan).alias("gap"))


def midranks(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Average ranks: equal values share the mean of their places."""
    first = F.rank().over(Window.partitionBy(*keys).orderBy(value))
    ties = F.count("*").over(Window.partitionBy(*keys, value))
    return df.withColumn(out, first + (ties - 1) / 2)
