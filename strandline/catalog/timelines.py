"""As-of and interval joins, segments, density clusters, frame arithmetic, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.catalog.base import EVENTS, ITEMS, items, r6, user_events
from strandline.operators import asof as J
from strandline.operators import frames as R
from strandline.operators import pairs as P
from strandline.operators import segments as S
from strandline.operators.cluster import dbscan
from strandline.operators.positions import numbered_values
from strandline.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
HOUR = 86_400.0


def _sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = user_events(s, d)
    return e.where("event_type = 'view'").select("event_id", "user_id", "sec"), e.where("event_type = 'click'").select("user_id", F.col("sec").alias("ts"), "value")


L = f"WITH {EVENTS}, l AS (SELECT event_id, user_id, sec FROM ev WHERE event_type = 'view'), r AS (SELECT user_id, sec AS ts, value FROM ev WHERE event_type = 'click')"
NEIGHBOURS = "n AS (SELECT l.event_id, l.sec, p.ts AS pt, p.value AS pv, q.ts AS nt, q.value AS nv FROM l ASOF LEFT JOIN r p ON l.user_id = p.user_id AND l.sec >= p.ts ASOF LEFT JOIN r q ON l.user_id = q.user_id AND l.sec <= q.ts)"
QUERIES["asof_forward_clamp"] = lambda s, d: J.asof_forward_clamp(*_sides(s, d), ["user_id"], "sec", "ts", ["value"], HOUR).select("event_id", F.col("match.value").alias("value"))
SQL["asof_forward_clamp"] = f"{L}, {NEIGHBOURS} SELECT event_id, coalesce(nv, pv) AS value FROM n"
QUERIES["asof_nearest"] = lambda s, d: J.asof_nearest(*_sides(s, d), ["user_id"], "sec", "ts", ["value"], HOUR).select("event_id", F.col("match.value").alias("value"))
SQL["asof_nearest"] = f"{L}, {NEIGHBOURS} SELECT event_id, CASE WHEN nt IS NULL OR sec - pt < nt - sec THEN coalesce(pv, nv) ELSE nv END AS value FROM n"
QUERIES["asof_nearest_earlier"] = lambda s, d: J.asof_nearest(*_sides(s, d), ["user_id"], "sec", "ts", ["value"], HOUR, tie_later=False).select("event_id", F.col("match.value").alias("value"))
SQL["asof_nearest_earlier"] = f"{L}, {NEIGHBOURS} SELECT event_id, CASE WHEN nt IS NULL OR sec - pt <= nt - sec THEN coalesce(pv, nv) ELSE nv END AS value FROM n"
QUERIES["asof_interp"] = lambda s, d: J.asof_interpolate(*_sides(s, d), ["user_id"], "sec", "ts", "value", HOUR).select("event_id", F.round("value_at", 5).alias("value"))
SQL["asof_interp"] = f"{L}, {NEIGHBOURS} SELECT event_id, round(coalesce(pv + (nv - pv) * (sec - pt) / (nt - pt), pv, nv), 5) AS value FROM n"


def _intervals(s, d):
    e = user_events(s, d).where("event_type = 'view'")
    return e.select("event_id", "user_id", F.col("sec").alias("start"), (F.col("sec") + 36_000 + F.col("value") * 1000).alias("stop"))


IV = f"WITH {EVENTS}, iv AS (SELECT event_id, user_id, sec AS start, sec + 36000 + value * 1000 AS stop FROM ev WHERE event_type = 'view')"


def _contains(s, d):
    points = user_events(s, d).where("event_type <> 'view'").select("user_id", F.col("sec").alias("ts"), F.col("event_id").alias("point"))
    hit = J.interval_contains(_intervals(s, d), points, ["user_id"], "start", "stop", "ts", ["point"], 43_200.0, "event_id")
    return hit.select("event_id", F.size("inside").cast("bigint").alias("n"), F.concat_ws(",", F.transform("inside", lambda x: x["point"].cast("string"))).alias("points"))


QUERIES["join_interval_contains"] = _contains
SQL["join_interval_contains"] = f"{IV} SELECT iv.event_id, count(p.event_id) AS n, coalesce(string_agg(CAST(p.event_id AS VARCHAR), ',' ORDER BY p.sec, p.event_id), '') AS points FROM iv LEFT JOIN ev p ON p.user_id = iv.user_id AND p.event_type <> 'view' AND p.sec BETWEEN start AND stop GROUP BY iv.event_id"
QUERIES["join_overlap"] = lambda s, d: J.interval_overlaps(_intervals(s, d), _intervals(s, d), ["user_id"], "start", "stop", "event_id", 43_200.0).where("id_a < id_b").select("id_a", "id_b", F.round("overlap", 3).alias("overlap"))
SQL["join_overlap"] = f"{IV} SELECT a.event_id AS id_a, b.event_id AS id_b, round(greatest(0, least(a.stop, b.stop) - greatest(a.start, b.start)), 3) AS overlap FROM iv a JOIN iv b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.start < b.stop AND b.start < a.stop"

# segments of label streams

RN = f"WITH {EVENTS}, f AS (SELECT user_id, event_type, value, sec, k, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame FROM ev)"
_frames = lambda s, d: user_events(s, d).withColumn("frame", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("bigint"))
_ISLANDS = "g AS (SELECT *, frame - row_number() OVER (PARTITION BY user_id, {l} ORDER BY frame) AS run FROM f)"
QUERIES["seg_gaps_islands"] = lambda s, d: S.gaps_and_islands(_frames(s, d), ["user_id"], "frame", "event_type", ["click", "view"])
SQL["seg_gaps_islands"] = f"{RN}, {_ISLANDS.format(l='event_type')} SELECT user_id, event_type, min(frame) AS start, max(frame) + 1 AS \"end\", count(*) AS n FROM g WHERE event_type IN ('click', 'view') GROUP BY user_id, event_type, run"
QUERIES["seg_event_count"] = lambda s, d: S.count_run_starts(_frames(s, d), ["user_id"], "frame", "event_type", "error")
SQL["seg_event_count"] = f"{RN}, {_ISLANDS.format(l='event_type')} SELECT user_id, event_type, count(DISTINCT run) AS n FROM g WHERE event_type <> 'error' GROUP BY user_id, event_type"


def _midpoints(s, d):
    seg = S.gaps_and_islands(_frames(s, d), ["user_id"], "frame", "event_type", ["click"]).withColumn("t", S.midpoint_seconds(F.col("start"), F.col("end"), F.lit(0.0)))
    gps = _frames(s, d).select("user_id", (F.col("frame") / 2.0).alias("ts"), "value")
    return J.asof_forward_clamp(seg, gps, ["user_id"], "t", "ts", ["value"], 16.0).select("user_id", "start", r6("t").alias("t"), F.col("match.value").alias("value"))


QUERIES["seg_midpoint"] = _midpoints
SQL["seg_midpoint"] = f"""{RN}, {_ISLANDS.format(l='event_type')},
m AS (SELECT user_id, min(frame) AS start, ((min(frame) + max(frame) + 1) // 2) / 3.0 AS t FROM g WHERE event_type = 'click' GROUP BY user_id, run),
p AS (SELECT user_id, frame / 2.0 AS ts, value FROM f), z AS (SELECT user_id, arg_max(value, ts) AS last FROM p GROUP BY user_id)
SELECT m.user_id, m.start, round(m.t, 6) + 0.0 AS t, coalesce(p.value, z.last) AS value FROM m ASOF LEFT JOIN p ON m.user_id = p.user_id AND m.t <= p.ts JOIN z ON z.user_id = m.user_id"""


def _threshold(s, d):
    f = _frames(s, d).withColumn("turn", S.turn_label(F.col("value") / 10, (F.col("k") - 50) / 500.0, (F.col("k") - 50) / 20.0))
    return S.gaps_and_islands(f, ["user_id"], "frame", "turn", [2, 3]).where("n >= 2")


QUERIES["seg_threshold_and"] = _threshold
SQL["seg_threshold_and"] = f"""{RN}, t AS (SELECT user_id, frame, CASE WHEN value / 10 < 0.5 THEN 0 WHEN (k - 50) / 500.0 > 0.02 AND (k - 50) / 20.0 > 0.5 THEN 2 WHEN (k - 50) / 500.0 < -0.02 AND (k - 50) / 20.0 < -0.5 THEN 3 ELSE 1 END AS turn FROM f),
g AS (SELECT *, frame - row_number() OVER (PARTITION BY user_id, turn ORDER BY frame) AS run FROM t)
SELECT user_id, turn, min(frame) AS start, max(frame) + 1 AS "end", count(*) AS n FROM g WHERE turn IN (2, 3) GROUP BY user_id, turn, run HAVING count(*) >= 2"""
_clips = lambda s, d: user_events(s, d).where("value > 60").select("event_id", F.col("value").alias("duration"))
QUERIES["seg_uniform_slots"] = lambda s, d: S.uniform_slots(_clips(s, d), "duration").select("event_id", "slot", r6("start").alias("start"), r6("stop").alias("stop"))
SQL["seg_uniform_slots"] = f"WITH {EVENTS}, c AS (SELECT event_id, value - 70 AS room FROM ev WHERE value >= 70) SELECT event_id, slot, round(30 + slot * (room / 19), 6) + 0.0 AS start, round(40 + slot * (room / 19), 6) + 0.0 AS stop FROM c, (SELECT CAST(unnest(range(0, 20)) AS INTEGER) AS slot)"


def _sliding(s, d):
    e = user_events(s, d).select("user_id", "event_id", (F.col("sec") / 10_000).alias("start"), ((F.col("sec") + F.col("value") * 100) / 10_000).alias("stop"))
    return S.sliding_windows(e, ["user_id"], "start", "stop", "event_id").select("user_id", r6("start").alias("start"), r6("duration").alias("duration"), "size", F.concat_ws(",", F.transform("ids", lambda i: i.cast("string"))).alias("ids"))


QUERIES["seg_sliding_narrations"] = _sliding
SQL["seg_sliding_narrations"] = f"""WITH {EVENTS}, e AS (SELECT user_id, event_id, sec / 10000 AS start, (sec + value * 100) / 10000 AS stop FROM ev),
w AS (SELECT user_id, start, lead(stop, 1) OVER o - start AS duration, 2 AS size, event_id || ',' || lead(event_id, 1) OVER o AS ids FROM e WINDOW o AS (PARTITION BY user_id ORDER BY start, event_id)
  UNION ALL SELECT user_id, start, lead(stop, 2) OVER o - start, 3, event_id || ',' || lead(event_id, 1) OVER o || ',' || lead(event_id, 2) OVER o FROM e WINDOW o AS (PARTITION BY user_id ORDER BY start, event_id)),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id, start ORDER BY size DESC) AS k FROM w WHERE duration BETWEEN 6 AND 15)
SELECT user_id, round(start, 6) + 0.0 AS start, round(duration, 6) + 0.0 AS duration, size, ids FROM b WHERE k = 1"""
QUERIES["manifest_sample"] = lambda s, d: S.sample_per_group(user_events(s, d), "event_type", "event_id", 20, 42).select("event_type", "event_id")
SQL["manifest_sample"] = "SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5(event_type || '|' || event_id || '|42'), event_id) AS k FROM events) WHERE k <= 20"

# density clusters of embeddings by their first two dimensions

QUERIES["cluster_dbscan"] = lambda s, d: dbscan(items(s, d), "item", [F.element_at("v", 1) * 1000, F.element_at("v", 2) * 1000], 16.0, 4)
SQL["cluster_dbscan"] = f"""WITH RECURSIVE {ITEMS}, pt AS (SELECT item, v[1] * 1000 AS x, v[2] * 1000 AS y FROM items),
e AS (SELECT a.item AS a, b.item AS b FROM pt a JOIN pt b ON a.item <> b.item AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 256),
core AS (SELECT a AS item FROM e GROUP BY a HAVING count(*) + 1 >= 4),
ce AS (SELECT a, b FROM e WHERE a IN (SELECT item FROM core) AND b IN (SELECT item FROM core)),
cc(item, label) USING KEY (item) AS (SELECT item, item FROM core UNION SELECT ce.a, min(cc.label) FROM cc JOIN ce ON ce.b = cc.item JOIN recurring.cc AS r ON r.item = ce.a WHERE cc.label < r.label GROUP BY ce.a),
m AS (SELECT item, label FROM cc UNION ALL SELECT e.a, min(cc.label) FROM e JOIN cc ON cc.item = e.b WHERE e.a NOT IN (SELECT item FROM core) GROUP BY e.a)
SELECT item, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS cluster FROM m"""
QUERIES["flt_mixed_clusters"] = lambda s, d: P.mixed_groups(_frames(s, d), "user_id", "event_type", ["click", "purchase"], 5, "event_id").select("event_id")
SQL["flt_mixed_clusters"] = "WITH g AS (SELECT user_id, count(*) AS n, min(event_id) AS seen FROM events GROUP BY user_id HAVING bool_or(event_type = 'click') AND bool_or(event_type = 'purchase')) SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM g ORDER BY n DESC, seen LIMIT 5)"

# frame arithmetic over made-up clips: n frames, rate, times

_clip = lambda s, d: user_events(s, d).select("event_id", (F.col("k") + 1).alias("n"), (F.col("event_id") % 20 + 10).cast("double").alias("fps"), F.col("value").alias("duration"), "sec")
CLIP = f"WITH {EVENTS}, c AS (SELECT event_id, k + 1 AS n, CAST(event_id % 20 + 10 AS DOUBLE) AS fps, value AS duration, sec FROM ev)"
_listed = lambda c: F.concat_ws(",", F.transform(c, lambda i: i.cast("string")))
QUERIES["frame_sample_linspace"] = lambda s, d: _clip(s, d).select("event_id", _listed(R.sample_linspace(F.col("n"), 16)).alias("frames"))
SQL["frame_sample_linspace"] = f"{CLIP} SELECT event_id, CASE WHEN n <= 16 THEN array_to_string(range(0, n), ',') ELSE array_to_string(list_transform(range(0, 16), lambda i: (i * (n - 1)) // 15), ',') END AS frames FROM c"
QUERIES["frame_sample_stride"] = lambda s, d: _clip(s, d).select("event_id", _listed(R.sample_stride(F.col("n"), F.col("fps"), F.lit(8.0))).alias("frames"))
SQL["frame_sample_stride"] = f"{CLIP} SELECT event_id, array_to_string(list_filter(list_transform(range(0, n), lambda m: CAST(ceil(m * fps / 8) AS BIGINT)), lambda i: i < n), ',') AS frames FROM c"
QUERIES["frame_sample_nearest"] = lambda s, d: _clip(s, d).select("event_id", _listed(R.sample_nearest(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: i * i / 8.0), F.lit(1.0), F.col("n") * 1.0, 5)).alias("frames"))
SQL["frame_sample_nearest"] = f"""{CLIP} SELECT event_id, array_to_string(list_transform(range(0, 5), lambda j: list_min(list_transform(range(0, n), lambda i: {{'gap': abs(i * i / 8.0 - (1.0 + j / 4.0 * (n * 1.0 - 1.0))), 'i': i}})).i), ',') AS frames FROM c"""
QUERIES["frame_pad_truncate"] = lambda s, d: _clip(s, d).select("event_id", F.size(R.pad_or_cut(R.sample_stride(F.col("n"), F.lit(1.0), F.lit(1.0)))).cast("bigint").alias("size"), F.element_at(R.pad_or_cut(R.sample_stride(F.col("n"), F.lit(1.0), F.lit(1.0))), -1).cast("bigint").alias("last"), R.pad_stats(F.col("n"), F.col("duration")).alias("p")).select("event_id", "size", "last", "p.unique_frames", r6("p.dup_ratio").alias("dup_ratio"), r6("p.fps_eff").alias("fps_eff"))
SQL["frame_pad_truncate"] = f"{CLIP} SELECT event_id, CAST(64 AS BIGINT) AS size, CAST(least(n - 1, 63) AS BIGINT) AS last, n AS unique_frames, round(greatest(0, 1 - n / 64.0), 6) + 0.0 AS dup_ratio, round(n / duration, 6) + 0.0 AS fps_eff FROM c"


def _caps(s, d):
    c = _clip(s, d)
    caps = [2.0, 5.0, 10.0, 15.0, 30.0]
    rows = c.select("duration", F.explode(F.array(*(F.struct(F.lit(x).alias("cap"), (R.target_fps(F.col("duration")) > x).alias("active"), R.capped_unique(F.col("duration"), x).alias("u")) for x in caps))).alias("e"))
    return rows.groupBy("e.cap").agg(r6(100 * F.avg(F.col("e.active").cast("double"))).alias("active_pct"), r6(F.avg("e.u")).alias("mean_unique"), F.min("e.u").alias("min_unique"), F.max("e.u").alias("max_unique"))


QUERIES["fps_cap_stats"] = _caps
SQL["fps_cap_stats"] = f"""{CLIP}, e AS (SELECT cap, 64 / duration > cap AS active, CAST(greatest(1, least(64, floor(least(64 / duration, cap) * duration))) AS INTEGER) AS u FROM c, (SELECT unnest([2.0::DOUBLE, 5.0, 10.0, 15.0, 30.0]) AS cap))
SELECT cap, round(100 * avg(CAST(active AS INTEGER)), 6) + 0.0 AS active_pct, round(avg(u), 6) + 0.0 AS mean_unique, min(u) AS min_unique, max(u) AS max_unique FROM e GROUP BY cap"""
QUERIES["fps_effective"] = lambda s, d: user_events(s, d).groupBy("user_id").agg(F.array_sort(F.collect_list("sec")).alias("t")).select("user_id", F.round(R.effective_fps(F.col("t")), 9).alias("fps"))
SQL["fps_effective"] = f"WITH {EVENTS} SELECT user_id, CASE WHEN count(*) >= 2 AND max(sec) > min(sec) THEN round((count(*) - 1) / (max(sec) - min(sec)), 9) ELSE 1.0 END AS fps FROM ev GROUP BY user_id"
QUERIES["temporal_masks"] = lambda s, d: _clip(s, d).select("event_id", R.temporal_masks(F.col("n") % 9, 8, 4).alias("m")).select("event_id", _listed(F.col("m.context")).alias("context"), _listed(F.col("m.target")).alias("target"))
SQL["temporal_masks"] = f"{CLIP} SELECT event_id, array_to_string(range(0, (n % 9) * 4), ',') AS context, array_to_string(range((n % 9) * 4, 32), ',') AS target FROM c"

# filters and projections

QUERIES["flt_label_subset"] = lambda s, d: P.within_group_pairs(items(s, d).where(F.col("kind").isin(1, 2)), "cluster", "item", "kind").select("item_a", "item_b", "gt")
SQL["flt_label_subset"] = f"WITH {ITEMS} SELECT a.item AS item_a, b.item AS item_b, CAST(a.kind = b.kind AS INTEGER) AS gt FROM items a JOIN items b ON a.cluster = b.cluster AND a.item < b.item WHERE a.kind IN (1, 2) AND b.kind IN (1, 2)"
QUERIES["flt_cross_session"] = lambda s, d: P.within_group_pairs(items(s, d).withColumn("session", F.col("item") % 7), "cluster", "item", "kind", ["session"]).where("session_a <> session_b").select("item_a", "item_b")
SQL["flt_cross_session"] = f"WITH {ITEMS} SELECT a.item AS item_a, b.item AS item_b FROM items a JOIN items b ON a.cluster = b.cluster AND a.item < b.item WHERE a.item % 7 <> b.item % 7"
QUERIES["flt_gps_valid"] = lambda s, d: table(s, d, "maneuver_segments").where((F.abs("lat") >= 1) & (F.abs("lng") >= 1) & ~F.isnan("lat") & ~F.isnan("lng")).select("segment_id", "lat", "lng").distinct()
SQL["flt_gps_valid"] = "SELECT DISTINCT segment_id, lat, lng FROM maneuver_segments WHERE abs(lat) >= 1 AND abs(lng) >= 1 AND NOT isnan(lat) AND NOT isnan(lng)"
QUERIES["flt_min_duration"] = lambda s, d: table(s, d, "nuscenes_segments").where("end_ts - start_ts >= 2.0").select("segment_id").distinct()
SQL["flt_min_duration"] = "SELECT DISTINCT segment_id FROM nuscenes_segments WHERE end_ts - start_ts >= 2.0"
QUERIES["flt_nan_rows"] = lambda s, d: table(s, d, "scores").na.drop(subset=["bot_similarity", "dtw_distance"]).where("not isnan(bot_similarity) and not isnan(dtw_distance)").groupBy("query_indices").agg(F.count("*").alias("n"))
SQL["flt_nan_rows"] = "SELECT query_indices, count(*) AS n FROM scores WHERE bot_similarity IS NOT NULL AND dtw_distance IS NOT NULL AND NOT isnan(bot_similarity) AND NOT isnan(dtw_distance) GROUP BY query_indices"


def dense_ids(df: DataFrame, label: str, out: str) -> DataFrame:
    """0-based numbers of the sorted distinct labels; a null label has none."""
    return df.join(numbered_values(df, label, out), label, "left")


QUERIES["prj_label_ids"] = lambda s, d: dense_ids(user_events(s, d), "event_type", "label_id").select("event_id", "label_id")
SQL["prj_label_ids"] = "SELECT event_id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS label_id FROM events"
QUERIES["prj_dense_index"] = lambda s, d: dense_ids(items(s, d).where("item % 3 <> 1"), "item", "idx").select("item", "idx")
SQL["prj_dense_index"] = f"WITH {ITEMS} SELECT item, CAST(row_number() OVER (ORDER BY item) - 1 AS INTEGER) AS idx FROM items WHERE item % 3 <> 1"


def gps_integrity(points: DataFrame, session: str) -> DataFrame:
    """(session, flag) from per-session points with ts, lat, lng and the clip's v_start, v_length, in order of precedence."""
    valid = (F.abs("lat") > 1) & (F.abs("lng") > 1) & ~F.isnan("lat") & ~F.isnan("lng")
    a = points.groupBy(session).agg(F.count("*").alias("n"), F.sum(F.coalesce(valid, F.lit(False)).cast("int")).alias("ok"), *(F.expr(f"max(case when abs(lat) > 1 and abs(lng) > 1 and not isnan(lat) and not isnan(lng) then {c} end) - min(case when abs(lat) > 1 and abs(lng) > 1 and not isnan(lat) and not isnan(lng) then {c} end)").alias(f"range_{c}") for c in ("lat", "lng")), F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.first("v_start").alias("vs"), F.first("v_length").alias("vl"))
    share = F.when(F.col("vl") > 0, J.overlap(F.col("vs"), F.col("vs") + F.col("vl"), F.col("lo"), F.col("hi")) / F.col("vl") * 100).otherwise(F.lit(0.0))
    flag = F.when(F.col("ok") == 0, "EMPTY").when((F.col("range_lat") < 1e-4) & (F.col("range_lng") < 1e-4), "STUCK").when(F.col("ok") / F.col("n") * 100 < 50, "LOW").when(share < 10, "DESYNC").when(share < 50, "PARTIAL").otherwise("OK")
    return a.select(session, flag.alias("flag"))


def _integrity(s, d):
    p = table(s, d, "maneuver_segments").where("session_id is not null and start_frame is not null").select("session_id", F.col("start_frame").cast("double").alias("ts"), "lat", "lng", F.lit(1000.0).alias("v_start"), F.lit(3000.0).alias("v_length"))
    return gps_integrity(p, "session_id")


QUERIES["flt_gps_integrity"] = _integrity
SQL["flt_gps_integrity"] = """WITH p AS (SELECT session_id, CAST(start_frame AS DOUBLE) AS ts, lat, lng, abs(lat) > 1 AND abs(lng) > 1 AND NOT isnan(lat) AND NOT isnan(lng) AS ok FROM maneuver_segments WHERE session_id IS NOT NULL AND start_frame IS NOT NULL),
a AS (SELECT session_id, count(*) AS n, count(*) FILTER (ok) AS good, max(lat) FILTER (ok) - min(lat) FILTER (ok) AS rlat, max(lng) FILTER (ok) - min(lng) FILTER (ok) AS rlng, greatest(0, least(4000.0, max(ts)) - greatest(1000.0, min(ts))) / 30.0 AS share FROM p GROUP BY session_id)
SELECT session_id, CASE WHEN good = 0 THEN 'EMPTY' WHEN rlat < 1e-4 AND rlng < 1e-4 THEN 'STUCK' WHEN good * 100.0 / n < 50 THEN 'LOW' WHEN share < 10 THEN 'DESYNC' WHEN share < 50 THEN 'PARTIAL' ELSE 'OK' END AS flag FROM a"""
QUERIES["join_semi_exists"] = lambda s, d: table(s, d, "relationships").join(table(s, d, "videos").select(F.col("video_id").alias("video1_id")), "video1_id", "left_semi").groupBy("topic_id").agg(F.count("*").alias("n"))
SQL["join_semi_exists"] = "SELECT topic_id, count(*) AS n FROM relationships WHERE video1_id IN (SELECT video_id FROM videos) GROUP BY topic_id"
QUERIES["join_anti_missing"] = lambda s, d: P.missing_ids(table(s, d, "relationships").select(F.col("video1_id").alias("video_id")).dropna(), table(s, d, "videos"), "video_id")
SQL["join_anti_missing"] = "SELECT DISTINCT video1_id AS video_id FROM relationships WHERE video1_id IS NOT NULL AND video1_id NOT IN (SELECT video_id FROM videos WHERE video_id IS NOT NULL)"
