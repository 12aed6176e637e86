"""Pooling and per-sequence transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.catalog.base import CELLS, EVENTS, ITEMS, D, T, items, matrix_rows, r6, seqs, user_events, vector_rows
from strandline.operators import sequences as S
from strandline.operators import series
from strandline.operators.arrays import l2

WITH = f"WITH {ITEMS}, {CELLS}"
UNIT = "SELECT item, dim, round(val / greatest(sqrt(sum(val * val) OVER (PARTITION BY item)), 1e-12), 6) + 0.0 AS val FROM y"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def _vector(name: str, build, y: str, unit: bool = True) -> None:
    QUERIES[name] = lambda s, d: vector_rows(seqs(s, d).withColumn("y", build(F.col("x"))), ["item"], "y")
    SQL[name] = f"{WITH}, y AS ({y}) " + (UNIT if unit else "SELECT item, dim, round(val, 6) + 0.0 AS val FROM y")


def _matrix(name: str, build, y: str) -> None:
    QUERIES[name] = lambda s, d: matrix_rows(seqs(s, d).withColumn("y", build(F.col("x"))), ["item"], "y")
    SQL[name] = f"{WITH}, y AS ({y}) SELECT item, pos, dim, round(val, 6) + 0.0 AS val FROM y"


QUERIES["l2_normalize"] = lambda s, d: vector_rows(items(s, d).withColumn("y", l2(F.transform("v", lambda x: x * 3))), ["item"], "y")
SQL["l2_normalize"] = f"{WITH}, y AS (SELECT item, pos * {D} + dim AS dim, val * 3 AS val FROM cells) {UNIT}"
_vector("pool_mean", S.pool_mean, "SELECT item, dim, avg(val) AS val FROM cells GROUP BY item, dim")
_vector("pool_max", S.pool_max, "SELECT item, dim, max(val) AS val FROM cells GROUP BY item, dim")
_vector(
    "pool_attention",
    S.pool_attention,
    """WITH m AS (SELECT item, dim, avg(val) AS mean FROM cells GROUP BY item, dim),
    z AS (SELECT c.item, c.pos, sum(c.val * m.mean) AS z FROM cells c JOIN m USING (item, dim) GROUP BY c.item, c.pos),
    w AS (SELECT item, pos, exp(z - max(z) OVER (PARTITION BY item)) AS w FROM z),
    p AS (SELECT item, pos, w / sum(w) OVER (PARTITION BY item) AS p FROM w)
    SELECT c.item, c.dim, sum(c.val * p.p) AS val FROM cells c JOIN p USING (item, pos) GROUP BY c.item, c.dim""",
)
_vector("pool_last_frame", S.pool_last_unit, f"SELECT item, dim, val FROM cells WHERE pos = {T - 1}")
_vector("pool_first", S.pool_first, "SELECT item, dim, val FROM cells WHERE pos = 0", unit=False)
_vector("pool_last", S.pool_last, f"SELECT item, dim, val FROM cells WHERE pos = {T - 1}", unit=False)
_vector("pool_concat_fl", S.pool_first_last, f"SELECT item, CASE WHEN pos = 0 THEN dim ELSE dim + {D} END AS dim, val FROM cells WHERE pos IN (0, {T - 1})", unit=False)
_vector(
    "pool_masked",
    lambda x: S.pool_masked_mean(x, F.transform(x, lambda v: v[0] > 0), least=2),
    """WITH k AS (SELECT item, pos FROM cells WHERE dim = 0 AND val > 0),
    n AS (SELECT item FROM k GROUP BY item HAVING count(*) >= 2)
    SELECT c.item, c.dim, avg(c.val) AS val FROM cells c JOIN k USING (item, pos) JOIN n USING (item) GROUP BY c.item, c.dim""",
    unit=False,
)
_vector(
    "pool_temporal_stats",
    S.pool_temporal_stats,
    f"""SELECT item, dim, avg(val) AS val FROM cells GROUP BY item, dim
    UNION ALL SELECT item, dim + {D}, stddev_samp(val) FROM cells GROUP BY item, dim
    UNION ALL SELECT item, dim + {2 * D}, max(val) FROM cells GROUP BY item, dim
    UNION ALL SELECT item, dim + {3 * D}, min(val) FROM cells GROUP BY item, dim""",
)
_STEP = "SELECT item, pos, dim, val FROM (SELECT item, pos, dim, lead(val, {w}) OVER (PARTITION BY item, dim ORDER BY pos) - val AS val FROM {src}) WHERE val IS NOT NULL"
_matrix("derivative", lambda x: S.derivative(x), _STEP.format(w=1, src="cells"))
_matrix("derivative_order2", lambda x: S.derivative(x, order=2, window=2), f"WITH a AS ({_STEP.format(w=2, src='cells')}) {_STEP.format(w=2, src='a')}")
_matrix(
    "derivative_unit",
    lambda x: S.derivative(x, unit_rows=True),
    f"WITH a AS ({_STEP.format(w=1, src='cells')}) SELECT item, pos, dim, val / greatest(sqrt(sum(val * val) OVER (PARTITION BY item, pos)), 1e-12) AS val FROM a",
)
_matrix(
    "smooth_replicate",
    lambda x: S.smooth_replicate(x, 3),
    f"""SELECT c.item, c.pos, c.dim, sum(o.val) / 3.0 AS val FROM cells c CROSS JOIN (VALUES (-1), (0), (1)) AS k(o)
    JOIN cells o ON o.item = c.item AND o.dim = c.dim AND o.pos = greatest(0, least({T - 1}, c.pos + k.o)) GROUP BY c.item, c.pos, c.dim""",
)
_matrix(
    "trajectory_fp",
    lambda x: S.trajectory(x, 3),
    f"""WITH s AS (SELECT c.item, c.pos, c.dim, sum(o.val) / 3.0 AS val FROM cells c CROSS JOIN (VALUES (-1), (0), (1)) AS k(o)
    JOIN cells o ON o.item = c.item AND o.dim = c.dim AND o.pos = greatest(0, least({T - 1}, c.pos + k.o)) GROUP BY c.item, c.pos, c.dim),
    v AS (SELECT item, pos, dim, val, val - lag(val) OVER (PARTITION BY item, dim ORDER BY pos) AS vel FROM s)
    SELECT item, pos - 1 AS pos, dim, val FROM v WHERE pos > 0 UNION ALL SELECT item, pos - 1, dim + {D}, vel FROM v WHERE pos > 0""",
)
_matrix(
    "minmax_time",
    S.minmax_time,
    """SELECT item, pos, dim, (val - min(val) OVER w) / greatest(max(val) OVER w - min(val) OVER w, 1e-8) AS val
    FROM cells WINDOW w AS (PARTITION BY item, dim)""",
)

QUERIES["attention_centroid"] = lambda s, d: seqs(s, d).select("item", S.attention_centroid(F.transform("x", lambda v: F.transform(v, lambda z: F.abs(z)))).alias("c")).select("item", r6("c.cx").alias("cx"), r6("c.cy").alias("cy"))
SQL["attention_centroid"] = f"""{WITH}, p AS (SELECT item, pos, dim, abs(val) / (sum(abs(val)) OVER (PARTITION BY item) + 1e-8) AS p FROM cells)
SELECT item, round(sum(p * dim / {D}.0), 6) + 0.0 AS cx, round(sum(p * pos / {T}.0), 6) + 0.0 AS cy FROM p GROUP BY item"""
QUERIES["patch_statistics"] = lambda s, d: seqs(s, d).select("item", S.patch_statistics(F.col("x")).alias("c")).select("item", r6("c.spread").alias("spread"), r6("c.entropy").alias("entropy"))
SQL["patch_statistics"] = f"""{WITH}, a AS (SELECT item, dim, var_samp(val) AS v FROM cells GROUP BY item, dim),
n AS (SELECT item, pos, sqrt(sum(val * val)) AS n FROM cells GROUP BY item, pos),
e AS (SELECT item, exp(n - max(n) OVER (PARTITION BY item)) AS e FROM n),
p AS (SELECT item, e / sum(e) OVER (PARTITION BY item) AS p FROM e),
h AS (SELECT item, -sum(p * ln(p + 1e-8)) AS entropy FROM p GROUP BY item)
SELECT a.item, round(avg(a.v), 6) + 0.0 AS spread, round(any_value(h.entropy), 6) + 0.0 AS entropy FROM a JOIN h USING (item) GROUP BY a.item"""
# predictions and truths of 2 steps with 2 places of 4 dimensions: the halves of an embedding
_halves = "transform(sequence(0, 1), t -> transform(sequence(0, 1), p -> slice(v, {at} + t * 8 + p * 4 + 1, 4)))"
QUERIES["temporal_residual"] = lambda s, d: matrix_rows(items(s, d).select("item", S.temporal_residual(F.expr(_halves.format(at=0)), F.expr(_halves.format(at=32))).alias("y")), ["item"], "y")
SQL["temporal_residual"] = f"""WITH {ITEMS}, c AS (SELECT item, generate_subscripts(v, 1) - 1 AS i, unnest(v) AS val FROM items),
e AS (SELECT item, i % 32 AS j, sum(CASE WHEN i < 32 THEN val ELSE -val END) AS diff FROM c GROUP BY item, i % 32)
SELECT item, CAST(j // 8 AS BIGINT) AS pos, CAST(j % 4 AS BIGINT) AS dim, round(avg(diff), 6) + 0.0 AS val FROM e WHERE j < 16 GROUP BY item, j // 8, j % 4"""
QUERIES["motion_proxy"] = lambda s, d: items(s, d).select("item", r6(S.motion_proxy(F.col("v"))).alias("motion"))
SQL["motion_proxy"] = f"""WITH {ITEMS}, c AS (SELECT item, generate_subscripts(v, 1) AS i, unnest(v) AS val FROM items),
s AS (SELECT item, abs(val - lag(val) OVER (PARTITION BY item ORDER BY i)) AS step FROM c)
SELECT item, round(avg(step), 6) + 0.0 AS motion FROM s GROUP BY item"""
QUERIES["deriv_sign_flip"] = lambda s, d: seqs(s, d).select("item", r6(S.sign_flip(F.col("x"))).alias("flip"))
SQL["deriv_sign_flip"] = f"""{WITH}, f AS (SELECT item, pos, dim, lead(val) OVER (PARTITION BY item, dim ORDER BY pos) - val AS fwd FROM cells QUALIFY fwd IS NOT NULL),
r AS (SELECT f.item, f.pos, f.fwd, -o.fwd AS rev FROM f JOIN f o ON o.item = f.item AND o.dim = f.dim AND o.pos = {T - 2} - f.pos),
c AS (SELECT item, pos, sum(fwd * rev) / (greatest(sqrt(sum(fwd * fwd)), 1e-8) * greatest(sqrt(sum(rev * rev)), 1e-8)) AS c FROM r GROUP BY item, pos)
SELECT item, round(avg(c), 6) + 0.0 AS flip FROM c GROUP BY item"""

# series of a user's events


def _same(s, d):
    e = user_events(s, d).select("user_id", "event_id", "value")
    return series.smooth_same(e, ["user_id"], "event_id", "value", 50).select("user_id", "event_id", r6("smooth").alias("smooth"))


QUERIES["smooth_convolve_same"] = _same
SQL["smooth_convolve_same"] = """SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING) / 50.0, 6) + 0.0 AS smooth FROM events"""
QUERIES["downsample_block_mean"] = lambda s, d: series.block_mean(user_events(s, d), ["user_id"], "event_id", ["sec", "value"], 10).select("user_id", "block", F.round("sec", 3).alias("sec"), r6("value").alias("value"))
SQL["downsample_block_mean"] = f"""WITH {EVENTS}, n AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 10 AS block FROM ev)
SELECT user_id, CAST(block AS BIGINT) AS block, round(avg(sec), 3) AS sec, round(avg(value), 6) + 0.0 AS value FROM n GROUP BY user_id, block HAVING count(*) = 10"""
QUERIES["clock_offset_median"] = lambda s, d: series.clock_offset(user_events(s, d).withColumn("ms", F.floor(F.col("sec") * 1000)), ["user_id"], "ms", "value").select("user_id", F.round("offset", 4).alias("offset_s"))
SQL["clock_offset_median"] = f"WITH {EVENTS} SELECT user_id, round(median(floor(sec * 1000) / 1000.0 - value), 4) AS offset_s FROM ev WHERE sec > 0 AND value > 1 GROUP BY user_id"
_flow = lambda s, d: items(s, d).select(F.col("item").alias("seq"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct((F.element_at("v", i * 2 + 1) * 90).alias("dx"), (F.element_at("v", i * 2 + 2) * 90).alias("dy")))).alias("step", "f")).select("seq", F.col("step").cast("bigint").alias("step"), "f.dx", "f.dy")
FLOW = f"""{ITEMS}, c AS (SELECT item, generate_subscripts(v, 1) - 1 AS i, unnest(v) * 90 AS val FROM items),
flow AS (SELECT a.item AS seq, CAST(a.i // 2 AS BIGINT) AS step, a.val AS dx, b.val AS dy FROM c a JOIN c b ON a.item = b.item AND b.i = a.i + 1 WHERE a.i % 2 = 0)"""
QUERIES["flow_mag_hist"] = lambda s, d: series.magnitude_histogram(_flow(s, d), "seq", "dx", "dy").select("seq", "bin", r6("share").alias("share"))
SQL["flow_mag_hist"] = f"""WITH {FLOW}, m AS (SELECT seq, sqrt(dx * dx + dy * dy) AS mag FROM flow),
b AS (SELECT seq, CAST(least(floor(mag / (50.0 / 32)), 31) AS INTEGER) AS bin FROM m WHERE mag <= 50)
SELECT seq, bin, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY seq) AS DOUBLE), 6) + 0.0 AS share FROM b GROUP BY seq, bin"""
QUERIES["flow_dir_hist"] = lambda s, d: series.direction_histogram(_flow(s, d), "seq", "dx", "dy").select("seq", "angle_bin", "mag_bin", r6("share").alias("share"))
SQL["flow_dir_hist"] = f"""WITH {FLOW}, m AS (SELECT seq, sqrt(dx * dx + dy * dy) AS mag, atan2(dy, dx) AS ang FROM flow),
b AS (SELECT seq, CAST(least(greatest(floor((ang + pi()) / (2 * pi()) * 8), 0), 7) AS INTEGER) AS angle_bin,
  CAST(least(greatest(floor(mag / 12.5), 0), 3) AS INTEGER) AS mag_bin FROM m)
SELECT seq, angle_bin, mag_bin, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY seq) AS DOUBLE), 6) + 0.0 AS share FROM b GROUP BY seq, angle_bin, mag_bin"""
QUERIES["flow_mean_traj"] = lambda s, d: _flow(s, d).withColumn("step", F.floor(F.col("step") / 4)).groupBy("seq", "step").agg(r6(F.avg("dx")).alias("mean_dx"), r6(F.avg("dy")).alias("mean_dy"))
SQL["flow_mean_traj"] = f"WITH {FLOW} SELECT seq, CAST(step // 4 AS BIGINT) AS step, round(avg(dx), 6) + 0.0 AS mean_dx, round(avg(dy), 6) + 0.0 AS mean_dy FROM flow GROUP BY seq, step // 4"
