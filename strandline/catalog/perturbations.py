"""Scrambles, attacks, negative sampling, gradients, factorials and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.catalog.base import CELLS, ITEMS, D, T, items, matrix_rows, r6, seqs
from strandline.catalog.comparisons import PAIRS, UNITS, cluster_pairs
from strandline.operators import diagnostics as G
from strandline.operators import fusion as U
from strandline.operators import metrics as M
from strandline.operators import pairs as P
from strandline.operators import perturb as X
from strandline.operators.comparators import score_pairs
from strandline.operators.gallery import gallery_totals

QUERIES: dict = {}
SQL: dict[str, str] = {}
WITH = f"WITH {ITEMS}, {CELLS}"


def _moved(name: str, build, moves: str, steps: int = T, source: str = "cells") -> None:
    """``moves``: SQL of (item, pos, old): the step that comes to stand at pos."""
    QUERIES[name] = lambda s, d: matrix_rows(seqs(s, d, steps, 64 // steps).withColumn("y", build(F.col("x"), F.col("item"))), ["item"], "y")
    cells = CELLS if steps == T else CELLS.replace(f"i // {D}", f"i // {64 // steps}").replace(f"i % {D}", f"i % {64 // steps}")
    SQL[name] = f"WITH {ITEMS}, {cells}, mv AS ({moves}) SELECT mv.item, CAST(mv.pos AS BIGINT) AS pos, c.dim, round(c.val, 6) + 0.0 AS val FROM mv JOIN cells c ON c.item = mv.item AND c.pos = mv.old"


def chunked(k: int, seed: int, start: str, length: str, t: int = T) -> str:
    """Chunks in the order of md5(item|k|seed|chunk); start and length are SQL in c."""
    return f"""SELECT item, row_number() OVER (PARTITION BY item ORDER BY h, c, p) - 1 AS pos, p AS old FROM (
      SELECT item, c, md5(item || '|{k}|{seed}|' || c) AS h, unnest(range({start}, {start} + {length})) AS p FROM items, (SELECT unnest(range(0, {min(k, t)})) AS c))"""


_moved("scramble_balanced", lambda x, i: X.scramble_hashed(x, i, F.lit(3), F.lit(7)), chunked(3, 7, f"c * {T // 3} + least(c, {T % 3})", f"({T // 3} + CAST(c < {T % 3} AS INTEGER))"))
_moved("scramble_array_split", lambda x, i: X.scramble_hashed(x, i, F.lit(99), F.lit(7)), f"""SELECT item, row_number() OVER (PARTITION BY item ORDER BY md5(item || '|99|7|' || c), c) - 1 AS pos, c AS old FROM items, (SELECT unnest(range(0, {T})) AS c)""")
_moved("scramble_floor_tail", lambda x, i: X.scramble_tail(x, i, F.lit(3), F.lit(7)), chunked(3, 7, f"c * {T // 3}", f"(CASE WHEN c = 2 THEN {T - 2 * (T // 3)} ELSE {T // 3} END)"))
_moved("scramble_frames_list", lambda x, i: X.scramble_tail(x, i, F.lit(20), F.lit(7), short_stays=True), f"SELECT item, p AS pos, p AS old FROM items, (SELECT unnest(range(0, {T})) AS p)")
_moved("atk_reversal", lambda x, i: F.reverse(x), f"SELECT item, p AS pos, {T - 1} - p AS old FROM items, (SELECT unnest(range(0, {T})) AS p)")
_S = "(('0x' || substr(md5(item || '|7'), 25, 8))::BIGINT % 2147483648)"
_moved("atk_local_reversal", lambda x, i: X.local_reversal(x, i, F.lit(7)), f"SELECT item, p AS pos, CASE WHEN p >= s AND p < s + {T // 4} THEN s + (s + {T // 4} - 1 - p) ELSE p END AS old FROM (SELECT item, {_S} % {T - T // 4 + 1} AS s, unnest(range(0, {T})) AS p FROM items)")
_moved(
    "atk_frame_drop",
    lambda x, i: X.frame_drop(x, i, F.lit(7)),
    f"""WITH o AS (SELECT item, p, row_number() OVER (PARTITION BY item ORDER BY md5(item || '|7|' || p), p) - 1 AS r FROM items, (SELECT unnest(range(0, 16)) AS p)),
    k AS (SELECT item, p, r - 3 AS r FROM o WHERE r >= 3), a AS (SELECT item, p FROM k UNION ALL SELECT item, p FROM k WHERE r < 3)
    SELECT item, row_number() OVER (PARTITION BY item ORDER BY p) - 1 AS pos, p AS old FROM a""",
    steps=16,
)
_moved("atk_cut_paste", lambda x, i: X.cut_paste(x, i, F.lit(7)), chunked(4, 7, "c * 2", "2"))
_moved("atk_speed", lambda x, i: X.change_speed(x, 1.5), f"SELECT item, p AS pos, CAST(floor(p * {T - 1} / 4.0) AS BIGINT) AS old FROM items, (SELECT unnest(range(0, 5)) AS p)")
_moved("atk_random_crop", lambda x, i: X.random_crop(x, i, F.lit(7)), f"""SELECT item, row_number() OVER (PARTITION BY item ORDER BY p) - 1 AS pos, p AS old FROM (
  SELECT item, p, row_number() OVER (PARTITION BY item ORDER BY md5(item || '|7|' || p), p) AS r FROM items, (SELECT unnest(range(0, {T})) AS p)) WHERE r <= 4""")

QUERIES["scramble_seed"] = lambda s, d: items(s, d).select("item", X.md5_seed(F.concat_ws("_", F.col("item").cast("string"), F.lit("4"), F.lit("0"))).alias("seed"))
SQL["scramble_seed"] = f"WITH {ITEMS} SELECT item, CAST(('0x' || substr(md5(item || '_4_0'), 25, 8))::BIGINT % 2147483648 AS BIGINT) AS seed FROM items"


def _attacked(s, d):
    pairs = cluster_pairs(s, d).select("item_a", "item_b", "gt", "x_a", "x_b")
    hit = X.attack_positives(pairs, "x_b", "gt", "item_b", "reversal")
    return score_pairs(hit, "x_a", "x_b", ["ordered_frame"]).select("item_a", "item_b", "gt", r6("ordered_frame").alias("score"))


QUERIES["atk_apply_positive_only"] = _attacked
SQL["atk_apply_positive_only"] = f"""{WITH}, {PAIRS}, {UNITS} SELECT item_a, item_b, gt, round(sum(a.val * b.val) / {T}.0, 6) + 0.0 AS score
FROM pairs p JOIN units a ON a.item = p.item_a JOIN units b ON b.item = p.item_b AND b.dim = a.dim AND b.pos = CASE WHEN gt = 1 THEN {T - 1} - a.pos ELSE a.pos END GROUP BY ALL"""


def _negatives(s, d, ratio):
    pairs = cluster_pairs(s, d, ())
    return X.sample_negatives(pairs, pairs.where("gt = 1"), "item_a", "item_b", ratio, 42)


QUERIES["neg_sample_ratio"] = lambda s, d: _negatives(s, d, 1)
SQL["neg_sample_ratio"] = f"""WITH {ITEMS}, {PAIRS}, n AS (SELECT item_a, item_b, 0 AS label FROM pairs WHERE gt = 0 ORDER BY md5(item_a || '|' || item_b || '|42'), item_a, item_b LIMIT (SELECT count(*) FROM pairs WHERE gt = 1))
SELECT item_a, item_b, 1 AS label FROM pairs WHERE gt = 1 UNION ALL SELECT * FROM n"""
QUERIES["neg_sample_all"] = lambda s, d: _negatives(s, d, 0)
SQL["neg_sample_all"] = f"WITH {ITEMS}, {PAIRS} SELECT item_a, item_b, gt AS label FROM pairs"


def _sides(s, d):
    pairs = cluster_pairs(s, d, ()).select(F.col("item_a").alias("id_a"), F.col("item_b").alias("id_b"), F.col("gt").alias("label"))
    packed = seqs(s, d).select(F.col("item").alias("seq_id"), F.col("x").alias("emb"))
    return pairs, packed


KS = (1, 2, 4)


def _gradient(s, d):
    pairs, packed = _sides(s, d)
    scores = G.scramble_scores(pairs, packed, packed, KS, ["ordered_frame", "cosine"], seed=3).withColumn("score", F.round("score", 6))
    return G.scramble_gradient(scores)


def _scrambled_units(k: int) -> str:
    if k == 1:
        return f"SELECT 1 AS k, item, pos, dim, val FROM units"
    return f"SELECT {k} AS k, mv.item, mv.pos, c.dim, c.val FROM ({chunked(k, 3, f'c * {T // k}', str(T // k))}) mv JOIN units c ON c.item = mv.item AND c.pos = mv.old"


GRADIENT = f"""{WITH}, {PAIRS}, {UNITS}, sc AS ({' UNION ALL '.join(_scrambled_units(k) for k in KS)}),
means AS (SELECT item, dim, avg(val) AS val FROM cells GROUP BY item, dim),
o AS (SELECT 'ordered_frame' AS method, b.k, p.item_a, p.item_b, p.gt, round(sum(a.val * b.val) / {T}.0, 6) AS s FROM pairs p JOIN units a ON a.item = p.item_a JOIN sc b ON b.item = p.item_b AND b.pos = a.pos AND b.dim = a.dim GROUP BY ALL
  UNION ALL SELECT 'cosine', k, item_a, item_b, gt, s FROM (SELECT p.item_a, p.item_b, p.gt, round(sum(a.val * b.val) / (sqrt(sum(a.val * a.val)) * sqrt(sum(b.val * b.val))), 6) AS s FROM pairs p JOIN means a ON a.item = p.item_a JOIN means b ON b.item = p.item_b AND b.dim = a.dim GROUP BY ALL) CROSS JOIN (VALUES (1), (2), (4)) AS ks(k)),
c AS (SELECT method, k, s, sum(gt) AS pos, count(*) AS n FROM o GROUP BY ALL),
t AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM c WINDOW w AS (PARTITION BY method, k ORDER BY s DESC)),
ap AS (SELECT method, k, sum(pos * tp / CAST(seen AS DOUBLE)) / sum(pos) AS ap FROM t GROUP BY method, k)"""
QUERIES["scramble_gradient"] = lambda s, d: _gradient(s, d).select("method", "k", r6("ap").alias("ap"))
SQL["scramble_gradient"] = f"{GRADIENT} SELECT method, k, round(ap, 6) + 0.0 AS ap FROM ap"
QUERIES["gradient_verdict"] = lambda s, d: G.gradient_verdict(_gradient(s, d), 0.001).select("method", r6("drop").alias("drop"), "verdict")
SQL["gradient_verdict"] = f"{GRADIENT}, w AS (SELECT method, max(ap) FILTER (k = 1) - max(ap) FILTER (k = 4) AS d FROM ap GROUP BY method) SELECT method, round(d, 6) + 0.0 AS drop, CASE WHEN d > 0.001 THEN 'order-sensitive' ELSE 'order-invariant' END AS verdict FROM w"


def _multiseed(s, d):
    pairs, packed = _sides(s, d)
    rows = None
    for seed in range(3):
        part = G.scramble_gradient(G.scramble_scores(pairs, packed, packed, (4,), ["ordered_frame"], seed=seed).withColumn("score", F.round("score", 6)))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("method", "k").agg(r6(F.avg("ap")).alias("mean"), r6(F.stddev_pop("ap")).alias("std"), F.count("*").alias("n"))


QUERIES["multiseed_summary"] = _multiseed
SQL["multiseed_summary"] = f"""{WITH}, {PAIRS}, {UNITS}, sc AS ({' UNION ALL '.join(f"SELECT {seed} AS seed, mv.item, mv.pos, c.dim, c.val FROM ({chunked(4, seed, 'c * 2', '2')}) mv JOIN units c ON c.item = mv.item AND c.pos = mv.old" for seed in range(3))}),
o AS (SELECT b.seed, p.item_a, p.item_b, p.gt, round(sum(a.val * b.val) / {T}.0, 6) AS s FROM pairs p JOIN units a ON a.item = p.item_a JOIN sc b ON b.item = p.item_b AND b.pos = a.pos AND b.dim = a.dim GROUP BY ALL),
c AS (SELECT seed, s, sum(gt) AS pos, count(*) AS n FROM o GROUP BY ALL),
t AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM c WINDOW w AS (PARTITION BY seed ORDER BY s DESC)),
ap AS (SELECT seed, sum(pos * tp / CAST(seen AS DOUBLE)) / sum(pos) AS ap FROM t GROUP BY seed)
SELECT 'ordered_frame' AS method, 4 AS k, round(avg(ap), 6) + 0.0 AS mean, round(stddev_pop(ap), 6) + 0.0 AS std, count(*) AS n FROM ap"""


def _factorial(s, d):
    pairs, packed = _sides(s, d)
    short = packed.where("seq_id % 5 <> 0").withColumn("emb", F.slice("emb", 1, 4))
    return G.factorial_ap(pairs, {"whole": packed, "half": short}, ["cosine", "ordered_frame"]).select("feature", "method", r6("ap").alias("ap"), "n_pairs")


QUERIES["factorial_ap"] = _factorial
SQL["factorial_ap"] = f"""{WITH}, {PAIRS}, {UNITS}, pp AS (SELECT * FROM pairs WHERE item_a % 5 <> 0 AND item_b % 5 <> 0),
lens AS (SELECT 'whole' AS feature, {T} AS t UNION ALL SELECT 'half', 4),
m AS (SELECT feature, item, dim, avg(val) AS val FROM cells JOIN lens ON pos < t GROUP BY ALL),
o AS (SELECT feature, 'cosine' AS method, item_a, item_b, gt, sum(a.val * b.val) / (sqrt(sum(a.val * a.val)) * sqrt(sum(b.val * b.val))) AS s FROM pp JOIN m a ON a.item = item_a JOIN m b USING (feature, dim) WHERE b.item = item_b GROUP BY ALL
  UNION ALL SELECT feature, 'ordered_frame', item_a, item_b, gt, sum(a.val * b.val) / any_value(t) FROM pp JOIN units a ON a.item = item_a JOIN units b ON b.item = item_b AND b.pos = a.pos AND b.dim = a.dim JOIN lens ON a.pos < t GROUP BY ALL),
c AS (SELECT feature, method, s, sum(gt) AS pos, count(*) AS n FROM o GROUP BY ALL),
t AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM c WINDOW w AS (PARTITION BY feature, method ORDER BY s DESC))
SELECT feature, method, round(sum(pos * tp / CAST(seen AS DOUBLE)) / sum(pos), 6) + 0.0 AS ap, CAST(sum(n) AS BIGINT) AS n_pairs FROM t GROUP BY feature, method"""
QUERIES["flt_shared_pairs"] = lambda s, d: P.shared_pairs(_sides(s, d)[0], [items(s, d).where("item % 5 <> 0"), items(s, d).where("item % 3 <> 0")], "item")
SQL["flt_shared_pairs"] = f"WITH {ITEMS}, {PAIRS} SELECT item_a AS id_a, item_b AS id_b, gt AS label FROM pairs WHERE item_a % 5 <> 0 AND item_b % 5 <> 0 AND item_a % 3 <> 0 AND item_b % 3 <> 0"
QUERIES["flt_missing_features"] = lambda s, d: P.keep_known(_sides(s, d)[0], items(s, d).where("item % 5 <> 0"), "item")
SQL["flt_missing_features"] = f"WITH {ITEMS}, {PAIRS} SELECT item_a AS id_a, item_b AS id_b, gt AS label FROM pairs WHERE item_a % 5 <> 0 AND item_b % 5 <> 0"


def _report(s, d):
    pairs, packed = _sides(s, d)
    second = packed.where("seq_id % 2 = 0").withColumn("emb", F.reverse("emb"))
    return G.temporal_report(pairs, packed, second, (1, 4), "ordered_frame", seed=3).select("measure", "k", r6(F.round("value", 6)).alias("value"), "n", "note")


QUERIES["temporal_report"] = _report
# the second set holds the even items, turned round; scrambles of b-sides are of that set
SQL["temporal_report"] = f"""{WITH}, {PAIRS}, {UNITS}, rv AS (SELECT item, {T - 1} - pos AS pos, dim, val FROM units WHERE item % 2 = 0),
sc AS (SELECT 1 AS k, item, pos, dim, val FROM rv UNION ALL SELECT 4, mv.item, mv.pos, c.dim, c.val FROM ({chunked(4, 3, f'c * {T // 4}', str(T // 4))}) mv JOIN rv c ON c.item = mv.item AND c.pos = mv.old),
o AS (SELECT b.k, p.item_a, p.item_b, p.gt, sum(a.val * b.val) / {T}.0 AS s FROM pairs p JOIN units a ON a.item = p.item_a JOIN sc b ON b.item = p.item_b AND b.pos = a.pos AND b.dim = a.dim GROUP BY ALL),
c AS (SELECT k, s, sum(gt) AS pos, count(*) AS n FROM o GROUP BY k, s),
t AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM c WINDOW w AS (PARTITION BY k ORDER BY s DESC)),
ap AS (SELECT k, sum(pos * tp / CAST(seen AS DOUBLE)) / sum(pos) AS ap FROM t GROUP BY k),
d AS (SELECT max(ap) FILTER (k = 1) - max(ap) FILTER (k = 4) AS d FROM ap),
v AS (SELECT a.item, sum(a.val * b.val) / {T}.0 AS s FROM units a JOIN units b ON b.item = a.item AND b.dim = a.dim AND b.pos = {T - 1} - a.pos GROUP BY a.item)
SELECT 'ap' AS measure, CAST(k AS INTEGER) AS k, round(ap, 6) + 0.0 AS value, CAST(NULL AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS note FROM ap
UNION ALL SELECT 'drop', NULL, round(d, 6) + 0.0, NULL, CASE WHEN d > 0.05 THEN 'order-sensitive' ELSE 'order-invariant' END FROM d
UNION ALL SELECT 's_rev_mean', NULL, round(avg(s), 6) + 0.0, count(*), NULL FROM v
UNION ALL SELECT 's_rev_std', NULL, round(stddev_pop(s), 6) + 0.0, count(*), NULL FROM v"""


def _contrast(s, d):
    pairs = cluster_pairs(s, d).select("item_a", "item_b", "gt", "x_a", "x_b").withColumn("condition", F.explode(F.array(F.lit("normal"), F.lit("reversed")))).withColumn("x_b", F.when(F.col("condition") == "reversed", F.reverse("x_b")).otherwise(F.col("x_b")))
    scored = score_pairs(pairs, "x_a", "x_b", ["ordered_frame"]).withColumn("score", F.round("ordered_frame", 6))
    ap = M.average_precision(scored, ["condition"], "score", "gt").groupBy().pivot("condition", ["normal", "reversed"]).agg(F.max("ap"))
    return ap.select(r6("normal").alias("normal"), r6("reversed").alias("reversed"), r6(F.col("normal") - F.col("reversed")).alias("drop"))


QUERIES["condition_contrast"] = _contrast
SQL["condition_contrast"] = f"""{WITH}, {PAIRS}, {UNITS}, o AS (SELECT c, p.item_a, p.item_b, p.gt, round(sum(a.val * b.val) / {T}.0, 6) AS s FROM pairs p CROSS JOIN (VALUES ('n'), ('r')) AS cs(c) JOIN units a ON a.item = p.item_a
  JOIN units b ON b.item = p.item_b AND b.dim = a.dim AND b.pos = CASE WHEN c = 'r' THEN {T - 1} - a.pos ELSE a.pos END GROUP BY ALL),
c AS (SELECT c, s, sum(gt) AS pos, count(*) AS n FROM o GROUP BY ALL),
t AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM c WINDOW w AS (PARTITION BY c ORDER BY s DESC)),
ap AS (SELECT c, sum(pos * tp / CAST(seen AS DOUBLE)) / sum(pos) AS ap FROM t GROUP BY c)
SELECT round(max(ap) FILTER (c = 'n'), 6) + 0.0 AS normal, round(max(ap) FILTER (c = 'r'), 6) + 0.0 AS reversed, round(max(ap) FILTER (c = 'n') - max(ap) FILTER (c = 'r'), 6) + 0.0 AS drop FROM ap"""


def scenario_pipeline(s: SparkSession, d: str) -> DataFrame:
    """Base pairs, and their positives' a-sides against attacked b-sides as negatives, for each scenario."""
    base = cluster_pairs(s, d).select("item_a", "item_b", "gt", "x_a", "x_b")
    rows = base.withColumn("scenario", F.lit("standard"))
    attacks = {"reversal": F.reverse("x_b"), "scramble": X.scramble_hashed(F.col("x_b"), F.col("item_b"), F.lit(8), F.lit(0)), "speed": X.change_speed(F.col("x_b"), 2.0)}
    for name, attacked in attacks.items():
        rows = rows.unionByName(base.withColumn("scenario", F.lit(name))).unionByName(base.where("gt = 1").withColumn("x_b", attacked).withColumn("gt", F.lit(0)).withColumn("scenario", F.lit(name)))
    scored = score_pairs(rows, "x_a", "x_b", ["cosine", "chamfer", "dtw", "ordered_frame"])
    first = F.round(U.mean_of_available(F.col("cosine"), F.col("chamfer")), 6)
    second = F.round(U.mean_of_available(F.col("dtw"), F.col("ordered_frame")), 6)
    two = scored.select("scenario", "gt", F.explode(F.array(F.struct(F.lit("stage1").alias("stage"), first.alias("score")), F.struct(F.lit("stage2").alias("stage"), second.alias("score")))).alias("e")).select("scenario", "gt", "e.*")
    return M.average_precision(two, ["scenario", "stage"], "score", "gt").select("scenario", "stage", r6("ap").alias("ap"))


QUERIES["scenario_attack_pipeline"] = scenario_pipeline


def _fwd_rev(s, d):
    q = seqs(s, d).where("item % 10 = 0")
    other = q.select(F.col("item").alias("cand"), F.col("x").alias("y"))
    neg = q.join(other, F.col("item") != F.col("cand")).select("item", "x", "y", F.lit(0).alias("label"))
    pos = q.select("item", "x", F.reverse("x").alias("y"), F.lit(1).alias("label"))
    scored = score_pairs(neg.unionByName(pos), "x", "y", ["cosine", "ordered_frame"])
    return scored.groupBy("label").agg(F.count("*").alias("n"), r6(F.sum("cosine")).alias("cosine"), r6(F.sum("ordered_frame")).alias("ordered_frame"))


QUERIES["join_fwd_rev_gallery"] = _fwd_rev
SQL["join_fwd_rev_gallery"] = f"""{WITH}, {UNITS}, q AS (SELECT item FROM items WHERE item % 10 = 0),
m AS (SELECT item, dim, avg(val) AS val FROM cells GROUP BY item, dim),
p AS (SELECT a.item AS ia, b.item AS ib, CAST(a.item = b.item AS INTEGER) AS label FROM q a CROSS JOIN q b),
o AS (SELECT ia, ib, label, sum(a.val * b.val) / {T}.0 AS s FROM p JOIN units a ON a.item = ia JOIN units b ON b.item = ib AND b.dim = a.dim AND b.pos = CASE WHEN label = 1 THEN {T - 1} - a.pos ELSE a.pos END GROUP BY ALL),
c AS (SELECT ia, ib, label, sum(a.val * b.val) / (sqrt(sum(a.val * a.val)) * sqrt(sum(b.val * b.val))) AS s FROM p JOIN m a ON a.item = ia JOIN m b ON b.item = ib AND b.dim = a.dim GROUP BY ALL)
SELECT o.label, count(*) AS n, round(sum(c.s), 6) + 0.0 AS cosine, round(sum(o.s), 6) + 0.0 AS ordered_frame FROM o JOIN c USING (ia, ib) GROUP BY o.label"""


def _unit(v):
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, c: t + c * c))
    return F.transform(v, lambda c: c / F.greatest(norm, F.lit(1e-12)))


def forward_and_reversed(seqs: DataFrame) -> DataFrame:
    """Every sequence of (item, x) against all others' forward ones (label 0) and its own reversed one (label 1): number
    and sums of the scores.  Sequences have one shape, so both scores are products of unit vectors."""
    steps, dims = F.size("x"), F.size(F.col("x")[0])
    mean = F.transform(F.sequence(F.lit(0), dims - 1), lambda k: F.aggregate("x", F.lit(0.0), lambda t, r: t + F.get(r, k)) / steps)
    flat = F.transform(F.flatten(F.transform("x", _unit)), lambda c: c / F.sqrt(steps))
    vectors = seqs.select("item", _unit(mean).alias("mean"), flat.alias("flat"))
    totals = {v: gallery_totals(vectors, vectors, "item", v).withColumnRenamed("total", f"of_{v}") for v in ("mean", "flat")}
    neg = totals["mean"].join(totals["flat"], "n").select(F.lit(0).alias("label"), "n", r6("of_mean").alias("cosine"), r6("of_flat").alias("ordered_frame"))
    pos = score_pairs(seqs.select("x", F.reverse("x").alias("y")), "x", "y", ["cosine", "ordered_frame"])
    pos = pos.groupBy(F.lit(1).alias("label")).agg(F.count("*").alias("n"), r6(F.sum("cosine")).alias("cosine"), r6(F.sum("ordered_frame")).alias("ordered_frame"))
    return neg.unionByName(pos)


# all queries against all items; SQL over all pairs is too slow, so this has none
QUERIES["join_fwd_rev_gallery_all"] = lambda s, d: forward_and_reversed(seqs(s, d).select("item", "x"))


def _loose(s, d):
    numbered = items(s, d).select("item", F.col("item").alias("place"))  # the items are numbered from 0
    positives = cluster_pairs(s, d, ()).where("gt = 1").select(F.col("item_a").alias("id_a"), F.col("item_b").alias("id_b"))
    return X.draw_negatives(numbered, positives, "item", "place", 1000, 2000, 42)


QUERIES["neg_sample_loose"] = _loose
SQL["neg_sample_loose"] = f"""WITH {ITEMS}, {PAIRS}, k AS (SELECT unnest(range(0, 2000)) AS draw), n AS (SELECT count(*) AS n FROM items),
r AS (SELECT draw, ('0x' || substr(md5(draw || '|a|42'), 25, 8))::BIGINT % 2147483648 % n AS a, ('0x' || substr(md5(draw || '|b|42'), 25, 8))::BIGINT % 2147483648 % n AS b FROM k, n)
SELECT draw, least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE a <> b AND (least(a, b), greatest(a, b)) NOT IN (SELECT (item_a, item_b) FROM pairs WHERE gt = 1) ORDER BY draw LIMIT 1000"""


def _guarded(s, d):
    pairs = cluster_pairs(s, d).select("item_a", "item_b", F.when(F.col("item_a") % 7 == 0, F.slice("x_a", 1, 0)).otherwise(F.col("x_a")).alias("x_a"), "x_b")
    return score_pairs(pairs, "x_a", "x_b", ["ordered_frame"]).select("item_a", "item_b", r6("ordered_frame").alias("score"))


QUERIES["sim_empty_guard"] = _guarded
SQL["sim_empty_guard"] = f"""{WITH}, {PAIRS}, {UNITS} SELECT item_a, item_b, CASE WHEN item_a % 7 = 0 THEN 0.0 ELSE round(sum(a.val * b.val) / {T}.0, 6) + 0.0 END AS score
FROM pairs p JOIN units a ON a.item = p.item_a JOIN units b ON b.item = p.item_b AND b.dim = a.dim AND b.pos = a.pos GROUP BY item_a, item_b"""
QUERIES["seed_sweep"] = QUERIES["multiseed_summary"]
SQL["seed_sweep"] = SQL["multiseed_summary"]
