"""Score fusion, held-out parameter selection, cascades and outcome composition over long score tables.

All steps of one query share the partitioning by query, so standardising, fusing and ranking cost one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.metrics import query_metrics


def _finite_or_fail(c: Column, what: str) -> Column:
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, F.raise_error(F.lit(f"non-finite {what}"))).otherwise(c)


def zscores(rows: DataFrame, query: Sequence[str] | str, score: str, out: str, negate: bool = False) -> DataFrame:
    """Per query (score - mean) / population deviation; 0 where all scores are equal.  A non-finite score fails."""
    w = Window.partitionBy(*([query] if isinstance(query, str) else query))
    s = _finite_or_fail(-F.col(score) if negate else F.col(score), "gallery score")
    std = F.stddev_pop(s).over(w)
    return rows.withColumn(out, F.when(std > 0, (s - F.avg(s).over(w)) / std).otherwise(F.lit(0.0)))


def fuse(rows: DataFrame, query: str, sim: str, dist: str, alpha: float, out: str = "fused") -> DataFrame:
    """alpha * z(sim) + (1 - alpha) * z(-dist), standardised per query."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be in [0, 1]")
    z = zscores(zscores(rows, query, sim, "zs__"), query, dist, "zd__", negate=True)
    return z.withColumn(out, alpha * F.col("zs__") + (1 - alpha) * F.col("zd__")).drop("zs__", "zd__")


def best_alpha(curve: DataFrame, keys: Sequence[str], alpha: str = "alpha", value: str = "map", tolerance: float = 1e-12) -> DataFrame:
    """(keys, alpha, map): the alpha of the highest value.  Of several within ``tolerance`` the only endpoint (0 or 1)
    among them wins, else the lower of the middle ones."""
    top = F.max(value).over(Window.partitionBy(*keys))
    tied = curve.withColumn("top__", top).where(F.col(value) >= F.col("top__") - tolerance)
    sets = tied.groupBy(*keys).agg(F.sort_array(F.collect_list(alpha)).alias("a__"), F.max("top__").alias("map"))
    ends = F.filter("a__", lambda x: (x == 0.0) | (x == 1.0))
    middle = F.element_at("a__", (F.floor((F.size("a__") - 1) / 2) + 1).cast("int"))
    return sets.select(*keys, F.when(F.size(ends) == 1, ends[0]).otherwise(middle).alias("alpha"), "map")


def leave_one_cluster_out(gallery: DataFrame, folds: Sequence[int], grid: Sequence[float]) -> DataFrame:
    """(fold, query_id, query_cluster, alpha, ap, rr, held_out) over (query_id, query_cluster, cand_id, cand_cluster, sim, dist, rel).

    For a query outside the fold's cluster: metrics of the fused ranking without the cluster's candidates (training).
    For a query of the cluster: metrics over the full gallery (held_out).  Scores are standardised anew for each
    reduced gallery.  The kernel holds one query's gallery at a time, and all folds and weights reuse it.
    """
    weights = np.asarray(grid, dtype=float)

    def metrics(sim: np.ndarray, dist: np.ndarray, rel: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def z(x: np.ndarray) -> np.ndarray:
            s = x.std()
            return (x - x.mean()) / s if s > 0 else np.zeros(len(x))

        fused = weights[:, None] * z(sim)[None, :] + (1 - weights)[:, None] * z(-dist)[None, :]
        # ties in the fused score go by candidate: rows come sorted by it and the sort is stable
        order = np.argsort(-np.round(fused, 9), axis=1, kind="stable")
        hit = rel[order].astype(float)
        place = np.arange(1, len(rel) + 1)
        ap = (hit * np.cumsum(hit, axis=1) / place).sum(axis=1) / rel.sum()
        return ap, 1.0 / (hit.argmax(axis=1) + 1)

    def one_query(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cand_id", kind="stable")
        own, q = int(rows["query_cluster"].iloc[0]), int(rows["query_id"].iloc[0])
        sim, dist, rel, cluster = (rows[c].to_numpy() for c in ("sim", "dist", "rel", "cand_cluster"))
        if not (np.isfinite(sim).all() and np.isfinite(dist).all()):
            raise ValueError("non-finite gallery score")
        parts = []
        for fold in folds:
            kept = np.ones(len(rows), bool) if fold == own else cluster != fold
            if rel[kept].sum() == 0:
                continue
            ap, rr = metrics(sim[kept], dist[kept], rel[kept])
            parts.append(pd.DataFrame({"fold": fold, "query_id": q, "query_cluster": own, "alpha": weights, "ap": ap, "rr": rr, "held_out": fold == own}))
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=["fold", "query_id", "query_cluster", "alpha", "ap", "rr", "held_out"])

    use = gallery.select("query_id", "query_cluster", "cand_id", "cand_cluster", "sim", "dist", "rel")
    return use.groupBy("query_id").applyInPandas(one_query, "fold int, query_id long, query_cluster int, alpha double, ap double, rr double, held_out boolean")


def held_out_fusion(gallery: DataFrame, folds: Sequence[int], grid: Sequence[float]) -> DataFrame:
    """(fold, alpha, training_map, test_map, n_test): alpha chosen on the other clusters, applied to the held-out one."""
    all_rows = leave_one_cluster_out(gallery, folds, grid)
    curve = all_rows.where("not held_out").groupBy("fold", "alpha").agg(F.avg("ap").alias("map"))
    chosen = best_alpha(curve, ["fold"]).withColumnRenamed("map", "training_map")
    tested = all_rows.where("held_out").groupBy("fold", "alpha").agg(F.avg("ap").alias("test_map"), F.count("*").alias("n_test"))
    return chosen.join(tested, ["fold", "alpha"], "left").fillna(0, ["n_test"])


def cascade(gallery: DataFrame, query: str, cand: str, sim: str, dist: str, rel: str, ks: Sequence[int], total: str | None = None) -> DataFrame:
    """(query, k, ap, recall, rr): the k most similar candidates, put in order of rising distance.

    AP and recall are over all relevant items of the query; queries without any are left out.  With ``total``, the number of
    these, the gallery need only hold each query's best candidates.
    """
    w = Window.partitionBy(query)
    rows = gallery.withColumn("first__", F.row_number().over(w.orderBy(F.desc(sim), cand))).withColumn("total__", F.col(total) if total else F.sum(rel).over(w)).where(F.col("total__") > 0)
    cut = rows.where(F.col("first__") <= max(ks)).withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks)))).where(F.col("first__") <= F.col("k"))
    order = Window.partitionBy(query, "k").orderBy(dist, cand)
    placed = cut.select(query, "k", rel, "total__", F.row_number().over(order).alias("r"), F.sum(rel).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("h"))
    out = placed.groupBy(query, "k").agg(F.coalesce(F.sum(F.when(F.col(rel) == 1, F.col("h") / F.col("r"))), F.lit(0.0)).alias("g"), F.sum(rel).alias("hits"), F.min(F.when(F.col(rel) == 1, F.col("r"))).alias("first"), F.max("total__").alias("t"))
    return out.select(query, "k", (F.col("g") / F.col("t")).alias("ap"), (F.col("hits") / F.col("t")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"))


def outcome_rows(gallery: DataFrame, query: str, cand: str, score: str, ks: Sequence[int]) -> DataFrame:
    """(query, k, outcome) of the k best candidates; k beyond the gallery is cut to it, a non-finite score fails."""
    rows = gallery.withColumn("s__", _finite_or_fail(F.col(score), "gallery score"))
    placed = rows.withColumn("r__", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("s__"), cand)))
    cut = placed.where(F.col("r__") <= max(ks)).withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks)))).where(F.col("r__") <= F.col("k"))
    same = F.col("query_cluster") == F.col("cand_cluster")
    outcome = F.when(same & (F.col("query_kind") == F.col("cand_kind")), "relevant").when(same, "same_cluster_wrong_label").otherwise("wrong_cluster")
    return cut.select(query, "k", outcome.alias("outcome"))


def outcome_composition(gallery: DataFrame, query: str, cand: str, score: str, ks: Sequence[int]) -> DataFrame:
    """(k, relevant, same_cluster_wrong_label, wrong_cluster): mean over queries of each share among the k best."""
    rows = outcome_rows(gallery, query, cand, score, ks)
    kinds = ("relevant", "same_cluster_wrong_label", "wrong_cluster")
    per_query = rows.groupBy("k", query).agg(*(F.avg((F.col("outcome") == x).cast("double")).alias(x) for x in kinds))
    return per_query.groupBy("k").agg(*(F.avg(x).alias(x) for x in kinds))


def fused_metrics(gallery: DataFrame, query: str, cand: str, sim: str, dist: str, alpha: float, excluded_cluster: int | None = None) -> DataFrame:
    """Per query ap and rr of the fused ranking; ``excluded_cluster`` leaves queries and candidates alike."""
    rows = gallery
    if excluded_cluster is not None:
        rows = rows.where((F.col("query_cluster") != excluded_cluster) & (F.col("cand_cluster") != excluded_cluster))
    fused = fuse(rows, query, sim, dist, alpha).withColumn("fused", F.round("fused", 9))
    return query_metrics(fused, query, cand, "fused")


def rerank_top_pairs(pairs: DataFrame, sim: str, second: str, top: int, ties: Sequence[str], out: str = "reranked") -> DataFrame:
    """The ``top`` pairs by ``sim`` get their second score, all others minus infinity."""
    best = pairs.orderBy(F.desc(sim), *ties).limit(top).select(*ties, F.col(second).alias(out))
    return pairs.join(best, list(ties), "left").withColumn(out, F.coalesce(out, F.lit(float("-inf"))))


def prefilter_sweep(pairs: DataFrame, score: str, label: str, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, recall, n_candidates) of keeping the pairs that reach a threshold.

    One aggregation with two conditional sums per threshold; the rows are not multiplied.
    """
    aggs = [F.sum((F.col(label) == 1).cast("long")).alias("p")]
    for k, t in enumerate(thresholds):
        aggs += [F.sum(((F.col(label) == 1) & (F.col(score) >= t)).cast("long")).alias(f"h{k}"), F.sum((F.col(score) >= t).cast("long")).alias(f"c{k}")]
    rows = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), (F.col(f"h{k}") / F.greatest(F.col("p"), F.lit(1))).alias("recall"), F.col(f"c{k}").alias("n_candidates")) for k, t in enumerate(thresholds)))
    return pairs.agg(*aggs).select(F.explode(rows).alias("e")).select("e.*")


def pick_threshold(sweep: DataFrame, recall: float = 0.99, default: float = 0.5) -> DataFrame:
    """(threshold): the highest whose recall reaches ``recall``, else ``default``."""
    return sweep.agg(F.coalesce(F.max(F.when(F.col("recall") >= recall, F.col("threshold"))), F.lit(default)).alias("threshold"))


def mean_of_available(*scores: Column) -> Column:
    """The mean of the scores that are there; null if none is."""
    n = sum((s.isNotNull().cast("int") for s in scores), F.lit(0))
    total = sum((F.coalesce(s, F.lit(0.0)) for s in scores), F.lit(0.0))
    return F.when(n > 0, total / n)


def attack_rejection(pairs: DataFrame, score: str, is_positive: Column, is_attack: Column, quantile: float = 0.05) -> DataFrame:
    """(threshold, rejection_rate): the share of attacked pairs strictly below the exact quantile of true positives.

    Without positives the threshold is null and nothing is rejected.
    """
    threshold = pairs.where(is_positive).agg(F.percentile(F.col(score), F.lit(quantile)).alias("threshold"))
    attacked = pairs.where(is_attack).select(F.col(score).alias("s__"))
    joined = threshold.join(attacked, F.lit(True), "left")  # one row against all
    below = F.sum(F.coalesce((F.col("s__") < F.col("threshold")).cast("long"), F.lit(0)))
    return joined.groupBy("threshold").agg((below / F.greatest(F.count("s__"), F.lit(1))).alias("rejection_rate"))
