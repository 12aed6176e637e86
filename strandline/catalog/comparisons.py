"""Comparators over within-cluster pairs, reversal sensitivity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.catalog.base import CELLS, ITEMS, T, r6, seqs
from strandline.operators import diagnostics as G
from strandline.operators.comparators import score_pairs
from strandline.operators.pairs import within_group_pairs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def cluster_pairs(spark: SparkSession, d: str, extra: tuple[str, ...] = ("x",)) -> DataFrame:
    return within_group_pairs(seqs(spark, d), "cluster", "item", "kind", extra)


def scored(spark: SparkSession, d: str, names: list[str]) -> DataFrame:
    pairs = cluster_pairs(spark, d).select("item_a", "item_b", "cluster", "gt", "x_a", "x_b")
    return score_pairs(pairs, "x_a", "x_b", names)


PAIRS = "pairs AS (SELECT a.item AS item_a, b.item AS item_b, a.cluster, CAST(a.kind = b.kind AS INTEGER) AS gt FROM items a JOIN items b ON a.cluster = b.cluster AND a.item < b.item)"
UNITS = "units AS (SELECT item, pos, dim, val / greatest(sqrt(sum(val * val) OVER (PARTITION BY item, pos)), 1e-12) AS val FROM cells)"
MEANS = "means AS (SELECT item, dim, avg(val) AS val FROM cells GROUP BY item, dim)"


def frames(source: str) -> str:
    """Products of all step pairs of all pairs."""
    return f"""st AS (SELECT item, pos, list(val ORDER BY dim) AS vec FROM {source} GROUP BY item, pos),
f AS (SELECT p.item_a, p.item_b, a.pos AS i, b.pos AS j, list_dot_product(a.vec, b.vec) AS s
  FROM pairs p JOIN st a ON a.item = p.item_a JOIN st b ON b.item = p.item_b)"""


BEST = "m AS (SELECT item_a, item_b, i, max(s) AS best, arg_min(j, (-s, j)) AS spot FROM f GROUP BY ALL), w AS (SELECT item_a, item_b, j, max(s) AS best, arg_min(i, (-s, i)) AS spot FROM f GROUP BY ALL)"
WITH = f"WITH {ITEMS}, {CELLS}, {PAIRS}"


def _score(name: str, sql: str, comparator: str | None = None) -> None:
    """``sql``: text that ends in item_a, item_b, score."""
    QUERIES[name] = lambda s, d: scored(s, d, [comparator or name]).select("item_a", "item_b", r6(comparator or name).alias("score"))
    SQL[name] = f"{WITH}, {sql}"


_PAIR_MEANS = "FROM pairs p JOIN means a ON a.item = p.item_a JOIN means b ON b.item = p.item_b AND b.dim = a.dim GROUP BY item_a, item_b"
_COS = "sum(a.val * b.val) / (greatest(sqrt(sum(a.val * a.val)), 1e-12) * greatest(sqrt(sum(b.val * b.val)), 1e-12))"
_score("sim_cosine_pooled", f"{MEANS} SELECT item_a, item_b, round({_COS}, 6) + 0.0 AS score {_PAIR_MEANS}", "cosine")
_score("sim_dot_pre_normalised", f"{MEANS} SELECT item_a, item_b, round(sum(a.val * b.val), 6) + 0.0 AS score {_PAIR_MEANS}", "dot")
_score("sim_cosine_eps", f"{MEANS} SELECT item_a, item_b, round(CASE WHEN sqrt(sum(a.val * a.val)) < 1e-8 OR sqrt(sum(b.val * b.val)) < 1e-8 THEN 0 ELSE {_COS} END, 6) + 0.0 AS score {_PAIR_MEANS}", "cosine_guarded")
_PAIR_CELLS = "FROM pairs p JOIN {c} a ON a.item = p.item_a JOIN {c} b ON b.item = p.item_b AND b.dim = a.dim AND b.pos = a.pos"
_score("sim_flat_cosine", f"z AS (SELECT 1) SELECT item_a, item_b, round({_COS}, 6) + 0.0 AS score {_PAIR_CELLS.format(c='cells')} GROUP BY item_a, item_b", "flat_cosine")
_score("sim_ordered_frame", f"{UNITS} SELECT item_a, item_b, round(sum(a.val * b.val) / {T}.0, 6) + 0.0 AS score {_PAIR_CELLS.format(c='units')} GROUP BY item_a, item_b", "ordered_frame")
_JOIN_BEST = "FROM (SELECT item_a, item_b, avg(best) AS x FROM m GROUP BY ALL) JOIN (SELECT item_a, item_b, avg(best) AS y FROM w GROUP BY ALL) USING (item_a, item_b)"
_score("sim_chamfer_norm", f"{UNITS}, {frames('units')}, {BEST} SELECT item_a, item_b, round((x + y) / 2, 6) + 0.0 AS score {_JOIN_BEST}", "chamfer")
_score("sim_chamfer_raw", f"{frames('cells')}, {BEST} SELECT item_a, item_b, round((x + y) / 2, 6) + 0.0 AS score {_JOIN_BEST}", "chamfer_raw")
_GAPS = """sg AS (SELECT item, pos, list(val ORDER BY dim) AS vec FROM {c} GROUP BY item, pos),
g AS (SELECT p.item_a, p.item_b, a.pos AS i, b.pos AS j, list_distance(a.vec, b.vec) AS s
  FROM pairs p JOIN sg a ON a.item = p.item_a JOIN sg b ON b.item = p.item_b)"""
_score(
    "sim_chamfer_euclid",
    f"""{_GAPS.format(c='cells')}, m AS (SELECT item_a, item_b, i, min(s) AS best FROM g GROUP BY ALL), w AS (SELECT item_a, item_b, j, min(s) AS best FROM g GROUP BY ALL)
    SELECT item_a, item_b, round(exp(-(x + y) / 2), 6) + 0.0 AS score {_JOIN_BEST}""",
    "chamfer_euclid",
)
_score("sim_maxsim", f"{frames('cells')}, {BEST} SELECT item_a, item_b, round(avg(best), 6) + 0.0 AS score FROM m GROUP BY item_a, item_b", "maxsim")
_FALLS = """, dm AS (SELECT item_a, item_b, avg(best) AS sim, CAST(count(*) FILTER (spot < before) AS DOUBLE) AS falls FROM (SELECT *, lag(spot) OVER (PARTITION BY item_a, item_b ORDER BY i) AS before FROM m) GROUP BY ALL),
dw AS (SELECT item_a, item_b, avg(best) AS sim, CAST(count(*) FILTER (spot < before) AS DOUBLE) AS falls FROM (SELECT *, lag(spot) OVER (PARTITION BY item_a, item_b ORDER BY j) AS before FROM w) GROUP BY ALL)"""
for _penalty in (0.0, 0.05, 0.1, 0.2, 0.5):
    _score(
        f"sim_oms_soft_{round(_penalty * 100):02d}",
        f"{frames('cells')}, {BEST}{_FALLS} SELECT item_a, item_b, round((dm.sim - {_penalty} * dm.falls / {T}.0 + dw.sim - {_penalty} * dw.falls / {T}.0) / 2, 6) + 0.0 AS score FROM dm JOIN dw USING (item_a, item_b)",
        f"oms_soft_{round(_penalty * 100):02d}",
    )
_score("monotonic_violations", f"{frames('cells')}, {BEST}{_FALLS} SELECT item_a, item_b, round((dm.falls + dw.falls) / 2, 6) + 0.0 AS score FROM dm JOIN dw USING (item_a, item_b)", "violations")
QUERIES["label_transition_hist"] = lambda s, d: G.violation_histogram(scored(s, d, ["violations", "violation_fraction"]), "violations", "gt").select("gt", "bucket", "n", r6("share").alias("share"))
SQL["label_transition_hist"] = f"""{WITH}, {frames('cells')}, {BEST}{_FALLS},
v AS (SELECT p.gt, (dm.falls + dw.falls) / 2 AS n FROM dm JOIN dw USING (item_a, item_b) JOIN pairs p USING (item_a, item_b)),
b AS (SELECT gt, CASE WHEN n < 1 THEN '0' WHEN n < 2 THEN '1' WHEN n < 5 THEN '2-4' WHEN n < 10 THEN '5-9' WHEN n < 20 THEN '10-19' WHEN n < 50 THEN '20-49' WHEN n < 100 THEN '50-99' ELSE '100+' END AS bucket FROM v)
SELECT gt, bucket, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY gt) AS DOUBLE), 6) + 0.0 AS share FROM b GROUP BY gt, bucket"""
_HARD = """h(item_a, item_b, {k}, floor, total) AS (
  SELECT item_a, item_b, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS DOUBLE) FROM pairs
  UNION ALL
  SELECT h.item_a, h.item_b, h.{k} + 1, arg_min(f.{o}, (-f.s, f.{o})), any_value(h.total) + max(f.s)
  FROM h JOIN f ON f.item_a = h.item_a AND f.item_b = h.item_b AND f.{k} = h.{k} + 1 AND f.{o} >= h.floor GROUP BY h.item_a, h.item_b, h.{k})"""
_score(
    "sim_oms_hard",
    f"""{frames('cells')}, h AS (WITH RECURSIVE {_HARD.format(k='i', o='j')} SELECT item_a, item_b, total / {T}.0 AS x FROM h WHERE i = {T - 1}),
    g AS (WITH RECURSIVE {_HARD.format(k='j', o='i')} SELECT item_a, item_b, total / {T}.0 AS y FROM h WHERE j = {T - 1})
    SELECT item_a, item_b, round((x + y) / 2, 6) + 0.0 AS score FROM h JOIN g USING (item_a, item_b)""",
    "oms_hard",
)
_score(
    "sim_neg_absdiff",
    f"""mv AS (SELECT item, avg(abs(step)) AS mv FROM (SELECT item, val - lag(val) OVER (PARTITION BY item, dim ORDER BY pos) AS step FROM cells) GROUP BY item)
    SELECT item_a, item_b, round(-abs(a.mv - b.mv), 6) + 0.0 AS score FROM pairs JOIN mv a ON a.item = item_a JOIN mv b ON b.item = item_b""",
    "motion_gap",
)

# dynamic time warping: rows of the cost matrix are folded one by one
STRETCHED = "stretched AS (SELECT item, pos, dim, (val - min(val) OVER w) / greatest(max(val) OVER w - min(val) OVER w, 1e-8) AS val FROM cells WINDOW w AS (PARTITION BY item, dim))"


def warped(source: str) -> str:
    return f"""{_GAPS.format(c=source)},
r AS (SELECT item_a, item_b, i, list(s ORDER BY j) AS cost FROM g GROUP BY item_a, item_b, i),
dist AS (WITH RECURSIVE p(item_a, item_b, i, acc) AS (
  SELECT item_a, item_b, CAST(-1 AS BIGINT), list_concat([CAST(0 AS DOUBLE)], list_transform(range(0, {T}), lambda k: CAST('inf' AS DOUBLE))) FROM pairs
  UNION ALL
  SELECT p.item_a, p.item_b, p.i + 1, list_reduce(list_transform(range(1, {T + 1}), lambda k: [r.cost[k], least(p.acc[k], p.acc[k + 1])]),
    lambda a, x: list_append(a, x[1] + least(x[2], a[len(a)])), [CAST('inf' AS DOUBLE)])
  FROM p JOIN r ON r.item_a = p.item_a AND r.item_b = p.item_b AND r.i = p.i + 1)
  SELECT item_a, item_b, acc[{T + 1}] / {2 * T}.0 AS dist FROM p WHERE i = {T - 1})"""


_score("dtw_distance", f"{warped('cells')} SELECT item_a, item_b, round(dist, 6) + 0.0 AS score FROM dist")
_score("dtw_batch", f"{STRETCHED}, {warped('stretched')} SELECT item_a, item_b, round(dist, 6) + 0.0 AS score FROM dist", "dtw_distance_normalized")
_score("sim_dtw_exp", f"{warped('cells')} SELECT item_a, item_b, round(exp(-dist), 6) + 0.0 AS score FROM dist", "dtw")
_score("sim_dtw_exp5", f"{STRETCHED}, {warped('stretched')} SELECT item_a, item_b, round(exp(-5 * dist), 6) + 0.0 AS score FROM dist", "dtw_alpha5")
_score("sim_dtw_recip", f"{STRETCHED}, {warped('stretched')} SELECT item_a, item_b, round(1 / (1 + dist), 6) + 0.0 AS score FROM dist", "dtw_reciprocal")


def derivative_multiscale(spark: SparkSession, d: str) -> DataFrame:
    pairs = cluster_pairs(spark, d).select("item_a", "item_b", "x_a", "x_b")
    return G.multiscale_similarity(pairs, "x_a", "x_b", (1, 5, 15)).select("item_a", "item_b", r6("score").alias("score"))


QUERIES["derivative_multiscale"] = derivative_multiscale


def _scale_sql(w: int) -> str:
    t = T - w
    return f"""(WITH steps AS (SELECT item, pos, dim, val FROM (SELECT item, pos, dim, lead(val, {w}) OVER (PARTITION BY item, dim ORDER BY pos) - val AS val FROM cells) WHERE val IS NOT NULL),
su AS (SELECT item, pos, dim, val / greatest(sqrt(sum(val * val) OVER (PARTITION BY item, pos)), 1e-12) AS val FROM steps),
{_GAPS.format(c='su')},
r AS (SELECT item_a, item_b, i, list(s ORDER BY j) AS cost FROM g GROUP BY item_a, item_b, i),
d AS (WITH RECURSIVE p(item_a, item_b, i, acc) AS (
  SELECT item_a, item_b, CAST(-1 AS BIGINT), list_concat([CAST(0 AS DOUBLE)], list_transform(range(0, {t}), lambda k: CAST('inf' AS DOUBLE))) FROM pairs
  UNION ALL
  SELECT p.item_a, p.item_b, p.i + 1, list_reduce(list_transform(range(1, {t + 1}), lambda k: [r.cost[k], least(p.acc[k], p.acc[k + 1])]),
    lambda a, x: list_append(a, x[1] + least(x[2], a[len(a)])), [CAST('inf' AS DOUBLE)])
  FROM p JOIN r ON r.item_a = p.item_a AND r.item_b = p.item_b AND r.i = p.i + 1)
  SELECT item_a, item_b, exp(-acc[{t + 1}] / {2 * t}.0) AS sim FROM p WHERE i = {t - 1}) SELECT item_a, item_b, sim FROM d)"""


SQL["derivative_multiscale"] = f"{WITH} SELECT item_a, item_b, round(avg(sim), 6) + 0.0 AS score FROM (SELECT * FROM {_scale_sql(1)} UNION ALL SELECT * FROM {_scale_sql(5)}) GROUP BY item_a, item_b"

# reversal sensitivity

QUERIES["s_rev"] = lambda s, d: G.reversal_summary(seqs(s, d), "item", "x", ["ordered_frame"]).select("method", r6("mean").alias("mean"), r6("std").alias("std"), "n")
SQL["s_rev"] = f"""WITH {ITEMS}, {CELLS}, {UNITS}, v AS (SELECT a.item, sum(a.val * b.val) / {T}.0 AS s FROM units a JOIN units b ON b.item = a.item AND b.dim = a.dim AND b.pos = {T - 1} - a.pos GROUP BY a.item)
SELECT 'ordered_frame' AS method, round(avg(s), 6) + 0.0 AS mean, round(stddev_pop(s), 6) + 0.0 AS std, count(*) AS n FROM v"""
QUERIES["s_rev_multi"] = lambda s, d: G.reversal_summary(seqs(s, d), "item", "x", ["cosine", "chamfer", "flat_cosine", "ordered_frame"]).select("method", r6("mean").alias("mean"), r6("std").alias("std"), "n")
SQL["s_rev_multi"] = f"""WITH {ITEMS}, {CELLS}, {UNITS},
v AS (SELECT 'ordered_frame' AS method, a.item, sum(a.val * b.val) / {T}.0 AS s FROM units a JOIN units b ON b.item = a.item AND b.dim = a.dim AND b.pos = {T - 1} - a.pos GROUP BY a.item
  UNION ALL SELECT 'flat_cosine', a.item, sum(a.val * b.val) / sum(a.val * a.val) FROM cells a JOIN cells b ON b.item = a.item AND b.dim = a.dim AND b.pos = {T - 1} - a.pos GROUP BY a.item
  UNION ALL SELECT 'cosine', item, 1.0 FROM items
  UNION ALL SELECT 'chamfer', item, 1.0 FROM items)
SELECT method, round(avg(s), 6) + 0.0 AS mean, round(stddev_pop(s), 6) + 0.0 AS std, count(*) AS n FROM v GROUP BY method"""
QUERIES["s_rev_ratio"] = lambda s, d: G.reversal_ratio(seqs(s, d), "item", "x", "flat_cosine").select("item", r6("ratio").alias("ratio"))
SQL["s_rev_ratio"] = f"""WITH {ITEMS}, {CELLS}
SELECT a.item, round(sum(a.val * b.val) / sum(a.val * a.val), 6) + 0.0 AS ratio FROM cells a JOIN cells b ON b.item = a.item AND b.dim = a.dim AND b.pos = {T - 1} - a.pos GROUP BY a.item"""
