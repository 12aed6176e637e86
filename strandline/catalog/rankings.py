"""Metrics over pairs and galleries, fusion, cascades."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.catalog.base import ITEMS, items, r6
from strandline.functions.maps import merged, score_map
from strandline.operators import fusion as U
from strandline.operators import metrics as M
from strandline.operators import pairs as P
from strandline.operators.comparators import score_pairs
from strandline.operators.gallery import gallery_best, gallery_ranks, gallery_scores

QUERIES: dict = {}
SQL: dict[str, str] = {}

# pairs of a cluster with two scores: product of the vectors, and distance of their first 16 dimensions


def pair_scores(s: SparkSession, d: str) -> DataFrame:
    pairs = P.within_group_pairs(items(s, d).withColumn("x", F.array("v")), "cluster", "item", "kind", ["x"])
    kernels = {"sim": lambda a, b: (a[:, 0] * b[:, 0]).sum(axis=1), "dist": lambda a, b: np.sqrt(((a[:, 0, :16] - b[:, 0, :16]) ** 2).sum(axis=1))}
    scored = score_pairs(pairs.select("cluster", "item_a", "item_b", "gt", "x_a", "x_b"), "x_a", "x_b", kernels)
    return scored.withColumn("sim", F.round("sim", 6)).withColumn("dist", F.round("dist", 6))


DOT = "round(list_sum(list_transform(range(1, 65), lambda k: {a}.v[k] * {b}.v[k])), 6)"
DIST = "round(sqrt(list_sum(list_transform(range(1, 17), lambda k: ({a}.v[k] - {b}.v[k]) * ({a}.v[k] - {b}.v[k])))), 6)"
PS = f"""ps AS (SELECT a.cluster, a.item AS item_a, b.item AS item_b, CAST(a.kind = b.kind AS INTEGER) AS gt, {DOT.format(a='a', b='b')} AS sim, {DIST.format(a='a', b='b')} AS dist
  FROM items a JOIN items b ON a.cluster = b.cluster AND a.item < b.item)"""
WITH = f"WITH {ITEMS}, {PS}"

QUERIES["join_within_group_pairs"] = lambda s, d: pair_scores(s, d)
SQL["join_within_group_pairs"] = f"{WITH} SELECT * FROM ps"
QUERIES["join_pair_features"] = lambda s, d: P.attach_features(pair_scores(s, d).select(F.col("item_a").alias("id_a"), F.col("item_b").alias("id_b")), items(s, d).select("item", "kind"), "item", ["kind"]).groupBy("kind_a", "kind_b").agg(F.count("*").alias("n"))
SQL["join_pair_features"] = f"{WITH} SELECT a.kind AS kind_a, b.kind AS kind_b, count(*) AS n FROM ps JOIN items a ON a.item = item_a JOIN items b ON b.item = item_b GROUP BY ALL"

_AP = """c AS (SELECT {k}, sim, sum(gt) AS pos, count(*) AS n FROM ps GROUP BY {k}, sim),
t AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM c WINDOW w AS (PARTITION BY {k} ORDER BY sim DESC))
SELECT {k}, round(sum(pos * tp / CAST(seen AS DOUBLE)) / sum(pos), 6) + 0.0 AS ap FROM t GROUP BY {k}"""
QUERIES["per_cluster_ap"] = lambda s, d: M.average_precision(pair_scores(s, d), ["cluster"], "sim", "gt").select("cluster", r6("ap").alias("ap"))
SQL["per_cluster_ap"] = f"{WITH}, {_AP.format(k='cluster')}"
QUERIES["ap_pooled"] = lambda s, d: M.average_precision(pair_scores(s, d), [], "sim", "gt").select(r6("ap").alias("ap"))
SQL["ap_pooled"] = f"{WITH}, c AS (SELECT sim, sum(gt) AS pos, count(*) AS n FROM ps GROUP BY sim), t AS (SELECT *, sum(pos) OVER (ORDER BY sim DESC) AS tp, sum(n) OVER (ORDER BY sim DESC) AS seen FROM c) SELECT round(sum(pos * tp / CAST(seen AS DOUBLE)) / sum(pos), 6) + 0.0 AS ap FROM t"
QUERIES["ap_positional"] = lambda s, d: M.average_precision_positional(pair_scores(s, d), ["cluster"], "sim", "gt", ["item_a", "item_b"]).select("cluster", r6("ap").alias("ap"))
SQL["ap_positional"] = f"{WITH}, r AS (SELECT cluster, gt, row_number() OVER w AS r, sum(gt) OVER w AS tp FROM ps WINDOW w AS (PARTITION BY cluster ORDER BY sim DESC, item_a, item_b)) SELECT cluster, round(sum(gt * tp / CAST(r AS DOUBLE)) / sum(gt), 6) + 0.0 AS ap FROM r GROUP BY cluster"
QUERIES["auc_roc"] = lambda s, d: M.roc_auc(pair_scores(s, d), ["cluster"], "sim", "gt").select("cluster", r6("auc").alias("auc"))
SQL["auc_roc"] = f"""{WITH}, r AS (SELECT cluster, gt, rank() OVER (PARTITION BY cluster ORDER BY sim) + (count(*) OVER (PARTITION BY cluster, sim) - 1) / 2.0 AS r FROM ps)
SELECT cluster, round((sum(r) FILTER (gt = 1) - sum(gt) * (sum(gt) + 1) / 2.0) / CAST(sum(gt) * sum(1 - gt) AS DOUBLE), 6) + 0.0 AS auc FROM r GROUP BY cluster"""
QUERIES["auc_rank_noties"] = lambda s, d: M.roc_auc_ordinal(pair_scores(s, d), ["cluster"], "sim", "gt", ["item_a", "item_b"]).select("cluster", r6("auc").alias("auc"))
SQL["auc_rank_noties"] = f"""{WITH}, r AS (SELECT cluster, gt, row_number() OVER (PARTITION BY cluster ORDER BY sim, item_a, item_b) AS r FROM ps)
SELECT cluster, round((sum(r) FILTER (gt = 1) - sum(gt) * (sum(gt) + 1) / 2.0) / CAST(sum(gt) * sum(1 - gt) AS DOUBLE), 6) + 0.0 AS auc FROM r GROUP BY cluster"""
QUERIES["sep_stats"] = lambda s, d: M.separation(pair_scores(s, d), ["cluster"], "sim", "gt").select("cluster", "n_pos", "n_neg", *(r6(c).alias(c) for c in ("same_mean", "diff_mean", "gap")))
SQL["sep_stats"] = f"""{WITH} SELECT cluster, CAST(sum(gt) AS BIGINT) AS n_pos, CAST(sum(1 - gt) AS BIGINT) AS n_neg, round(avg(sim) FILTER (gt = 1), 6) + 0.0 AS same_mean, round(avg(sim) FILTER (gt = 0), 6) + 0.0 AS diff_mean,
round(avg(sim) FILTER (gt = 1) - avg(sim) FILTER (gt = 0), 6) + 0.0 AS gap FROM ps GROUP BY cluster"""
QUERIES["oracle_max"] = lambda s, d: M.average_precision(pair_scores(s, d).withColumn("best", F.greatest("sim", 1 - F.col("dist"))), ["cluster"], "best", "gt").select("cluster", r6("ap").alias("ap"))
SQL["oracle_max"] = f"WITH {ITEMS}, {PS.replace('ps AS', 'raw AS')}, ps AS (SELECT cluster, gt, greatest(sim, 1 - dist) AS sim FROM raw), {_AP.format(k='cluster')}"
QUERIES["alpha_sweep"] = lambda s, d: M.average_precision(pair_scores(s, d).withColumn("alpha", F.explode(F.array(*(F.lit(a) for a in (0.5, 1.0, 2.0, 5.0))))).withColumn("score", F.round(F.exp(-F.col("alpha") * F.col("dist")), 9)), ["alpha"], "score", "gt").select("alpha", r6("ap").alias("ap"))
SQL["alpha_sweep"] = f"WITH {ITEMS}, {PS.replace('ps AS', 'raw AS')}, ps AS (SELECT alpha, gt, round(exp(-alpha * dist), 9) AS sim FROM raw CROSS JOIN (SELECT unnest([0.5::DOUBLE, 1.0, 2.0, 5.0]) AS alpha)), {_AP.format(k='alpha')}"
QUERIES["rerank_pairs"] = lambda s, d: M.average_precision(U.rerank_top_pairs(pair_scores(s, d).withColumn("near", -F.col("dist")), "sim", "near", 500, ["item_a", "item_b"]), [], "reranked", "gt").select(r6("ap").alias("ap"))
SQL["rerank_pairs"] = f"""{WITH}, q AS (SELECT gt, CASE WHEN row_number() OVER (ORDER BY sim DESC, item_a, item_b) <= 500 THEN -dist ELSE CAST('-inf' AS DOUBLE) END AS sim FROM ps),
c AS (SELECT sim, sum(gt) AS pos, count(*) AS n FROM q GROUP BY sim), t AS (SELECT *, sum(pos) OVER (ORDER BY sim DESC) AS tp, sum(n) OVER (ORDER BY sim DESC) AS seen FROM c) SELECT round(sum(pos * tp / CAST(seen AS DOUBLE)) / sum(pos), 6) + 0.0 AS ap FROM t"""
THRESHOLDS = [round(0.05 * k - 0.2, 2) for k in range(10)]
QUERIES["prefilter_sweep"] = lambda s, d: U.prefilter_sweep(pair_scores(s, d), "sim", "gt", THRESHOLDS).select("threshold", r6("recall").alias("recall"), "n_candidates")
SQL["prefilter_sweep"] = f"""{WITH}, t AS (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in THRESHOLDS)}]) AS threshold)
SELECT threshold, round(CAST(sum(gt) FILTER (sim >= threshold) AS DOUBLE) / sum(gt), 6) + 0.0 AS recall, count(*) FILTER (sim >= threshold) AS n_candidates FROM ps CROSS JOIN t GROUP BY threshold"""
QUERIES["prefilter_choice"] = lambda s, d: U.pick_threshold(U.prefilter_sweep(pair_scores(s, d), "sim", "gt", THRESHOLDS), 0.95)
SQL["prefilter_choice"] = f"SELECT coalesce(max(threshold) FILTER (recall >= 0.95), 0.5) AS threshold FROM ({SQL['prefilter_sweep'].replace('round(CAST(sum(gt) FILTER (sim >= threshold) AS DOUBLE) / sum(gt), 6) + 0.0', 'CAST(sum(gt) FILTER (sim >= threshold) AS DOUBLE) / sum(gt)')})"
QUERIES["join_threshold_candidates"] = lambda s, d: P.threshold_candidates(pair_scores(s, d), "sim", 0.2, pair_scores(s, d).where("gt = 1 and item_a % 7 = 0"), ["item_a", "item_b"])
SQL["join_threshold_candidates"] = f"{WITH} SELECT item_a, item_b FROM ps WHERE sim >= 0.2 OR (gt = 1 AND item_a % 7 = 0)"
QUERIES["fusion_equal_mean"] = lambda s, d: pair_scores(s, d).select("item_a", "item_b", F.round(U.mean_of_available(F.when(F.col("gt") == 1, F.col("sim")), 1 - F.col("dist")), 9).alias("fused"))
SQL["fusion_equal_mean"] = f"{WITH} SELECT item_a, item_b, round(CASE WHEN gt = 1 THEN (sim + (1 - dist)) / 2 ELSE 1 - dist END, 9) + 0.0 AS fused FROM ps"
QUERIES["attack_rejection_rate"] = lambda s, d: U.attack_rejection(pair_scores(s, d), "sim", F.col("gt") == 1, F.col("gt") == 0).select(r6("threshold").alias("threshold"), r6("rejection_rate").alias("rejection_rate"))
SQL["attack_rejection_rate"] = f"""{WITH}, t AS (SELECT quantile_cont(sim, 0.05) AS threshold FROM ps WHERE gt = 1)
SELECT round(threshold, 6) + 0.0 AS threshold, round(count(*) FILTER (sim < threshold) / CAST(count(*) AS DOUBLE), 6) + 0.0 AS rejection_rate FROM ps CROSS JOIN t WHERE gt = 0 GROUP BY threshold"""
QUERIES["join_all_pairs"] = lambda s, d: P.all_pairs(items(s, d), "item", ["kind"]).groupBy((F.col("kind_a") == F.col("kind_b")).cast("int").alias("same")).agg(F.count("*").alias("n"))
SQL["join_all_pairs"] = f"WITH {ITEMS} SELECT CAST(a.kind = b.kind AS INTEGER) AS same, count(*) AS n FROM items a JOIN items b ON a.item < b.item GROUP BY 1"

# maps of scores by name: a second map overrides the first


def _score_maps(s, d):
    first = score_map({"sim": F.col("sim"), "dist": F.when(F.col("gt") == 1, F.col("dist"))})
    both = pair_scores(s, d).withColumn("m", merged(first, score_map({"sim": F.when(F.col("dist") > 1, -F.col("sim")), "near": -F.col("dist")})))
    return both.select("item_a", "item_b", F.size("m").alias("n"), F.concat_ws(",", F.array_sort(F.map_keys("m"))).alias("names"), *(F.element_at("m", F.lit(k)).alias(k) for k in ("sim", "dist", "near")))


QUERIES["prj_score_map"] = _score_maps
SQL["prj_score_map"] = f"""{WITH} SELECT item_a, item_b, CAST(2 + gt AS INTEGER) AS n, CASE WHEN gt = 1 THEN 'dist,near,sim' ELSE 'near,sim' END AS names,
CASE WHEN dist > 1 THEN -sim ELSE sim END AS sim, CASE WHEN gt = 1 THEN dist END AS dist, -dist AS near FROM ps"""

# directed galleries


def gallery(s: SparkSession, d: str) -> DataFrame:
    it = items(s, d)
    scores = gallery_scores(it, it, "item", "v", 16).withColumn("sim", F.round("sim", 6)).withColumn("dist", F.round("dist", 6))
    for side in ("query", "cand"):
        scores = scores.join(it.select(F.col("item").alias(f"{side}_id"), F.col("cluster").alias(f"{side}_cluster"), F.col("kind").alias(f"{side}_kind")), f"{side}_id")
    return P.with_relevance(scores, "cluster", "kind")


def both_ways(s: SparkSession, d: str) -> DataFrame:
    """(query_id, cand_id, sim, dist, rel) of all pairs of a cluster, in either direction."""
    ps = pair_scores(s, d)
    rest = ("sim", "dist", F.col("gt").alias("rel"))
    return ps.select(F.col("item_a").alias("query_id"), F.col("item_b").alias("cand_id"), *rest).unionByName(ps.select(F.col("item_b").alias("query_id"), F.col("item_a").alias("cand_id"), *rest))


def relevant_ranks(s: SparkSession, d: str) -> DataFrame:
    """(query_id, cand_id, sim, rank) of every relevant candidate among all items."""
    it = items(s, d)
    return gallery_ranks(it, it, both_ways(s, d).where("rel = 1").select("query_id", "cand_id", "sim"), "item", "v")


def best(s: SparkSession, d: str, k: int) -> DataFrame:
    """The k best candidates of every query, with clusters, kinds and relevance."""
    it = items(s, d)
    scores = gallery_best(it, it, "item", "v", k, 16).drop("rank").withColumn("dist", F.round("dist", 6))
    for side in ("query", "cand"):
        scores = scores.join(it.select(F.col("item").alias(f"{side}_id"), F.col("cluster").alias(f"{side}_cluster"), F.col("kind").alias(f"{side}_kind")), f"{side}_id")
    return P.with_relevance(scores, "cluster", "kind")


GALLERY = f"""g AS (SELECT a.item AS query_id, b.item AS cand_id, {DOT.format(a='a', b='b')} AS sim, {DIST.format(a='a', b='b')} AS dist,
  a.cluster AS query_cluster, b.cluster AS cand_cluster, a.kind AS query_kind, b.kind AS cand_kind, CAST(a.cluster = b.cluster AND a.kind = b.kind AS INTEGER) AS rel
  FROM items a JOIN items b ON a.item <> b.item)"""
GW = f"WITH {ITEMS}, {GALLERY}"
_TOTALS = "(SELECT query_id, cand_id, sim, dist, rel FROM g)"
QUERIES["join_directed_gallery"] = lambda s, d: gallery(s, d).groupBy("query_id").agg(F.count("*").alias("n"), F.sum("rel").alias("n_rel"), r6(F.sum("sim")).alias("total"), r6(F.sum("dist")).alias("total_dist"))
SQL["join_directed_gallery"] = f"{GW} SELECT query_id, count(*) AS n, CAST(sum(rel) AS BIGINT) AS n_rel, round(sum(sim), 6) + 0.0 AS total, round(sum(dist), 6) + 0.0 AS total_dist FROM g GROUP BY query_id"
QUERIES["join_relevance"] = lambda s, d: both_ways(s, d).where("rel = 1").select("query_id", "cand_id")
SQL["join_relevance"] = f"{GW} SELECT query_id, cand_id FROM g WHERE rel = 1"
_METRICS = ("ap", "rr", "ap_5", "recall_5", "ndcg_5", "ap_20", "recall_20", "ndcg_20")
QUERIES["rank_metrics"] = lambda s, d: M.metrics_of_ranks(relevant_ranks(s, d), ["query_id"], "rank", (5, 20)).select("query_id", "n_rel", *(r6(c).alias(c) for c in _METRICS))
_AT = "round(coalesce(sum(h / CAST(r AS DOUBLE)) FILTER (r <= {k}), 0) / count(*), 6) + 0.0 AS ap_{k}, round(count(*) FILTER (r <= {k}) / CAST(count(*) AS DOUBLE), 6) + 0.0 AS recall_{k}, round(coalesce(sum(1 / log2(r + 1)) FILTER (r <= {k}), 0) / list_sum(list_transform(range(1, least({k}, count(*)) + 1), lambda i: 1 / log2(i + 1))), 6) + 0.0 AS ndcg_{k}"
RANKED = "r AS (SELECT query_id, rel, row_number() OVER w AS r, sum(rel) OVER w AS h FROM g WINDOW w AS (PARTITION BY query_id ORDER BY {by}, cand_id))"
SQL["rank_metrics"] = f"{GW}, {RANKED.format(by='sim DESC')} SELECT query_id, count(*) AS n_rel, round(sum(h / CAST(r AS DOUBLE)) / count(*), 6) + 0.0 AS ap, round(1.0 / min(r), 6) + 0.0 AS rr, {_AT.format(k=5)}, {_AT.format(k=20)} FROM r WHERE rel = 1 GROUP BY query_id"
RANK_METRICS_EXACT = SQL["rank_metrics"].replace(", 6) + 0.0", ", 15) + 0.0")
for _name, _column in (("ap_at_k", "ap_5"), ("recall_at_k", "recall_5"), ("ndcg_at_k", "ndcg_5"), ("mrr", "rr")):
    QUERIES[_name] = lambda s, d, c=_column: M.metrics_of_ranks(relevant_ranks(s, d), ["query_id"], "rank", (5,)).agg(r6(F.avg(c)).alias("mean"))
    SQL[_name] = f"WITH m AS ({SQL['rank_metrics'].replace(', 6) + 0.0', ', 15) + 0.0')}) SELECT round(avg({_column}), 6) + 0.0 AS mean FROM m"


QUERIES["ap_truncated"] = lambda s, d: M.metrics_of_ranks(relevant_ranks(s, d), ["query_id"], "rank", (25,)).select("query_id", r6("ap_25").alias("ap"))
SQL["ap_truncated"] = f"{GW}, {RANKED.format(by='sim DESC')} SELECT query_id, round(coalesce(sum(h / CAST(r AS DOUBLE)) FILTER (rel = 1 AND r <= 25), 0) / sum(rel), 6) + 0.0 AS ap FROM r GROUP BY query_id HAVING sum(rel) > 0"
QUERIES["retrieval_cluster_local"] = lambda s, d: M.query_metrics(both_ways(s, d), "query_id", "cand_id", "sim").select("query_id", r6("ap").alias("ap"), r6("rr").alias("rr"))
SQL["retrieval_cluster_local"] = f"{GW.replace('ON a.item <> b.item', 'ON a.item <> b.item AND a.cluster = b.cluster')}, {RANKED.format(by='sim DESC')} SELECT query_id, round(sum(h / CAST(r AS DOUBLE)) / count(*), 6) + 0.0 AS ap, round(1.0 / min(r), 6) + 0.0 AS rr FROM r WHERE rel = 1 GROUP BY query_id"
QUERIES["outcome_composition"] = lambda s, d: U.outcome_composition(best(s, d, 10), "query_id", "cand_id", "sim", (1, 10)).select("k", *(r6(c).alias(c) for c in ("relevant", "same_cluster_wrong_label", "wrong_cluster")))
_TOP = "t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, cand_id) AS r FROM g), u AS (SELECT t.*, k FROM t JOIN (VALUES (1), (10)) AS ks(k) ON r <= k), o AS (SELECT query_id, k, CASE WHEN rel = 1 THEN 'relevant' WHEN query_cluster = cand_cluster THEN 'same_cluster_wrong_label' ELSE 'wrong_cluster' END AS outcome FROM u)"
SQL["outcome_composition"] = f"""{GW}, {_TOP}, q AS (SELECT query_id, k, avg(CAST(outcome = 'relevant' AS INTEGER)) AS a, avg(CAST(outcome = 'same_cluster_wrong_label' AS INTEGER)) AS b, avg(CAST(outcome = 'wrong_cluster' AS INTEGER)) AS c FROM o GROUP BY query_id, k)
SELECT k, round(avg(a), 6) + 0.0 AS relevant, round(avg(b), 6) + 0.0 AS same_cluster_wrong_label, round(avg(c), 6) + 0.0 AS wrong_cluster FROM q GROUP BY k"""
QUERIES["join_outcome_class"] = lambda s, d: U.outcome_rows(best(s, d, 10), "query_id", "cand_id", "sim", (1, 10)).groupBy("query_id", "k", "outcome").agg(F.count("*").alias("n"))
SQL["join_outcome_class"] = f"{GW}, {_TOP} SELECT query_id, k, outcome, count(*) AS n FROM o GROUP BY ALL"
QUERIES["zscore_row"] = lambda s, d: U.zscores(gallery(s, d), "query_id", "sim", "z").groupBy("query_id").agg(r6(F.max("z")).alias("top"), r6(F.min("z")).alias("low"), r6(F.stddev_pop("z")).alias("std"))
SQL["zscore_row"] = f"{GW}, z AS (SELECT query_id, (sim - avg(sim) OVER w) / stddev_pop(sim) OVER w AS z FROM g WINDOW w AS (PARTITION BY query_id)) SELECT query_id, round(max(z), 6) + 0.0 AS top, round(min(z), 6) + 0.0 AS low, round(stddev_pop(z), 6) + 0.0 AS std FROM z GROUP BY query_id"
_FUSED = "z AS (SELECT *, (sim - avg(sim) OVER w) / stddev_pop(sim) OVER w AS zs, (-dist - avg(-dist) OVER w) / stddev_pop(-dist) OVER w AS zd FROM {g} WINDOW w AS (PARTITION BY query_id)), f AS (SELECT query_id, cand_id, rel, {a} * zs + (1 - {a}) * zd AS raw, round(raw, 9) AS fused FROM z)"
QUERIES["fuse_alpha"] = lambda s, d: U.fuse(gallery(s, d), "query_id", "sim", "dist", 0.3).groupBy("query_id").agg(F.round(F.max("fused"), 5).alias("top"), F.round(F.min("fused"), 5).alias("low"))
SQL["fuse_alpha"] = f"{GW}, {_FUSED.format(g='g', a=0.3)} SELECT query_id, round(max(raw), 5) + 0.0 AS top, round(min(raw), 5) + 0.0 AS low FROM f GROUP BY query_id"
QUERIES["eval_fused_queries"] = lambda s, d: U.fused_metrics(gallery(s, d), "query_id", "cand_id", "sim", "dist", 0.7, excluded_cluster=3).select("query_id", r6("ap").alias("ap"), r6("rr").alias("rr"))
SQL["eval_fused_queries"] = f"{GW}, h AS (SELECT * FROM g WHERE query_cluster <> 3 AND cand_cluster <> 3), {_FUSED.format(g='h', a=0.7)}, r AS (SELECT query_id, rel, row_number() OVER w AS r, sum(rel) OVER w AS h FROM f WINDOW w AS (PARTITION BY query_id ORDER BY fused DESC, cand_id)) SELECT query_id, round(sum(h / CAST(r AS DOUBLE)) / count(*), 6) + 0.0 AS ap, round(1.0 / min(r), 6) + 0.0 AS rr FROM r WHERE rel = 1 GROUP BY query_id"


def _cascade(s, d):
    totals = both_ways(s, d).groupBy("query_id").agg(F.sum("rel").alias("n_rel"))
    return U.cascade(best(s, d, 25).join(totals, "query_id"), "query_id", "cand_id", "sim", "dist", "rel", (5, 25), "n_rel")


QUERIES["cascade_rerank"] = lambda s, d: _cascade(s, d).groupBy("k").agg(r6(F.avg("ap")).alias("ap"), r6(F.avg("recall")).alias("recall"), r6(F.avg("rr")).alias("rr"))
SQL["cascade_rerank"] = f"""{GW}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, cand_id) AS fst, sum(rel) OVER (PARTITION BY query_id) AS total FROM g),
c AS (SELECT p.*, k FROM p JOIN (VALUES (5), (25)) AS ks(k) ON fst <= k WHERE total > 0),
r AS (SELECT query_id, k, rel, total, row_number() OVER w AS r, sum(rel) OVER w AS h FROM c WINDOW w AS (PARTITION BY query_id, k ORDER BY dist, cand_id)),
q AS (SELECT query_id, k, coalesce(sum(h / CAST(r AS DOUBLE)) FILTER (rel = 1), 0) / any_value(total) AS ap, sum(rel) / CAST(any_value(total) AS DOUBLE) AS recall, coalesce(1.0 / min(r) FILTER (rel = 1), 0) AS rr FROM r GROUP BY query_id, k)
SELECT k, round(avg(ap), 6) + 0.0 AS ap, round(avg(recall), 6) + 0.0 AS recall, round(avg(rr), 6) + 0.0 AS rr FROM q GROUP BY k"""
GRID5 = [0.0, 0.25, 0.5, 0.75, 1.0]
GRID21 = [round(0.05 * k, 2) for k in range(21)]
CLUSTERS = list(range(10))


def _loco_rows(s, d, grid):
    return U.held_out_fusion(gallery(s, d), CLUSTERS, grid).select("fold", "alpha", r6("training_map").alias("training_map"), r6("test_map").alias("test_map"), "n_test")


QUERIES["loco_alpha"] = lambda s, d: _loco_rows(s, d, GRID5)
_LOCO = f"""{GW}, folds AS (SELECT CAST(unnest(range(0, 10)) AS INTEGER) AS fold),
gf AS (SELECT fold, g.* FROM g JOIN folds ON fold = query_cluster OR fold <> cand_cluster),
z AS (SELECT fold, query_id, cand_id, query_cluster, rel, (sim - avg(sim) OVER w) / stddev_pop(sim) OVER w AS zs, (-dist - avg(-dist) OVER w) / stddev_pop(-dist) OVER w AS zd FROM gf WINDOW w AS (PARTITION BY fold, query_id)),
f AS (SELECT fold, alpha, query_id, cand_id, query_cluster, rel, round(alpha * zs + (1 - alpha) * zd, 9) AS s FROM z CROSS JOIN (SELECT unnest([{{grid}}]) AS alpha)),
r AS (SELECT fold, alpha, query_id, query_cluster, rel, row_number() OVER w AS r, sum(rel) OVER w AS h FROM f WINDOW w AS (PARTITION BY fold, alpha, query_id ORDER BY s DESC, cand_id)),
q AS (SELECT fold, alpha, query_id, query_cluster, sum(h / CAST(r AS DOUBLE)) / count(*) AS ap FROM r WHERE rel = 1 GROUP BY ALL),
c AS (SELECT fold, alpha, avg(ap) FILTER (query_cluster <> fold) AS map, avg(ap) FILTER (query_cluster = fold) AS test_map, count(*) FILTER (query_cluster = fold) AS n_test FROM q GROUP BY fold, alpha),
b AS (SELECT fold, max(map) AS top FROM c GROUP BY fold),
t AS (SELECT fold, list(alpha ORDER BY alpha) AS a FROM c JOIN b USING (fold) WHERE map >= top - 1e-12 GROUP BY fold),
p AS (SELECT fold, CASE WHEN len(list_filter(a, lambda x: x IN (0, 1))) = 1 THEN list_filter(a, lambda x: x IN (0, 1))[1] ELSE a[(len(a) - 1) // 2 + 1] END AS alpha FROM t)
SELECT fold, alpha, round(map, 6) + 0.0 AS training_map, round(test_map, 6) + 0.0 AS test_map, n_test FROM p JOIN c USING (fold, alpha)"""
SQL["loco_alpha"] = _LOCO.replace("{grid}", ", ".join(f"{a}::DOUBLE" for a in GRID5))
QUERIES["loco_alpha_21"] = lambda s, d: _loco_rows(s, d, GRID21)
SQL["loco_alpha_21"] = _LOCO.replace("{grid}", ", ".join(f"{a}::DOUBLE" for a in GRID21))


def _select_alpha(s, d):
    curve = s.range(1).select(F.explode(F.array(*(F.lit(a) for a in GRID21))).alias("alpha")).crossJoin(items(s, d).select("cluster").distinct()).withColumn("map", F.round(F.sin(F.col("cluster") + 1.0) * F.round(F.col("alpha") * 4) / 4, 3) + F.lit(0.0))
    return U.best_alpha(curve, ["cluster"]).select("cluster", "alpha", "map")


QUERIES["select_alpha"] = _select_alpha
SQL["select_alpha"] = f"""WITH {ITEMS}, c AS (SELECT cluster, alpha, round(sin(cluster + 1.0) * round(alpha * 4) / 4, 3) + 0.0 AS map FROM (SELECT DISTINCT cluster FROM items) CROSS JOIN (SELECT unnest([{', '.join(f'{a}::DOUBLE' for a in GRID21)}]) AS alpha)),
b AS (SELECT cluster, max(map) AS top FROM c GROUP BY cluster),
t AS (SELECT cluster, list(alpha ORDER BY alpha) AS a, any_value(top) AS map FROM c JOIN b USING (cluster) WHERE map >= top - 1e-12 GROUP BY cluster)
SELECT cluster, CASE WHEN len(list_filter(a, lambda x: x IN (0, 1))) = 1 THEN list_filter(a, lambda x: x IN (0, 1))[1] ELSE a[(len(a) - 1) // 2 + 1] END AS alpha, map FROM t"""
