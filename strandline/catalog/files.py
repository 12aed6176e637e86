"""Readers and writers, over files made of the driver's tables in the shared folder."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.catalog.base import EVENTS, ITEMS, items, seqs, user_events
from strandline.functions import parse as T
from strandline.operators.pairs import within_group_pairs
from strandline.scratch import shared_root
from strandline.sources import readers as R
from strandline.sources import sinks as W
from strandline.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/strandline-files-{uuid.uuid4().hex}/{name}"


def _text(spark: SparkSession, line: DataFrame, name: str, header: str | None = None) -> str:
    """A one-column table written as text; a heading goes first in every file."""
    path = _place(spark, name)
    lines = line.select(F.lit(1).alias("at"), F.col(line.columns[0]).alias("value"))
    if header is not None:
        lines = lines.unionByName(spark.createDataFrame([(0, header)], "at int, value string"))
    lines = lines.repartition(1).sortWithinPartitions("at").select("value")
    lines.write.text(path)
    return path


def _cat(*parts: Column | str) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _s(c: str) -> Column:
    return F.col(c).cast("string")


def pt_embeddings(s, d):
    path = _place(s, "sequences")
    seqs(s, d).select(_s("item").alias("seq_id"), F.col("x").alias("emb")).write.parquet(path)
    return R.read_sequences(s, path).select("seq_id", F.size("emb").cast("bigint").alias("steps"), F.round(F.element_at(F.element_at("emb", 2), 3), 6).alias("probe"))


QUERIES["src_pt_embeddings"] = pt_embeddings
SQL["src_pt_embeddings"] = "SELECT CAST(vec_id AS VARCHAR) AS seq_id, CAST(8 AS BIGINT) AS steps, round(CAST(embedding[11] AS DOUBLE), 6) AS probe FROM embeddings"


def _pairs_read_back(s, p):
    line = p.select(F.when(F.col("item_b") % 11 == 0, _cat(" ", _s("item_a"), ",", _s("item_b"))).otherwise(_cat(" ", _s("item_a"), " , ", _s("item_b"), ",", _s("gt"))).alias("value"))
    return R.read_pairs(s, _text(s, line, "pairs.csv", "Video_A,video_b,label"))


QUERIES["src_pairs_csv"] = lambda s, d: _pairs_read_back(s, within_group_pairs(items(s, d), "cluster", "item", "kind").where("item_a % 5 = 0"))
SQL["src_pairs_csv"] = f"WITH {ITEMS} SELECT CAST(a.item AS VARCHAR) AS id_a, CAST(b.item AS VARCHAR) AS id_b, CAST(a.kind = b.kind AS INTEGER) AS label FROM items a JOIN items b ON a.cluster = b.cluster AND a.item < b.item WHERE a.item % 5 = 0 AND b.item % 11 <> 0"
QUERIES["src_pairs_csv_all"] = lambda s, d: _pairs_read_back(s, within_group_pairs(items(s, d), "cluster", "item", "kind"))
SQL["src_pairs_csv_all"] = f"WITH {ITEMS} SELECT CAST(a.item AS VARCHAR) AS id_a, CAST(b.item AS VARCHAR) AS id_b, CAST(a.kind = b.kind AS INTEGER) AS label FROM items a JOIN items b ON a.cluster = b.cluster AND a.item < b.item WHERE b.item % 11 <> 0"


def pair_annotations(s, d):
    r = table(s, d, "relationships").where("video1_id is not null and video2_id is not null").select("video1_id", "video2_id")
    line = r.select(F.when(F.col("video1_id") % 13 == 0, _cat(_s("video1_id"), ",", _s("video2_id"))).otherwise(_cat(_s("video1_id"), ",", _s("video2_id"), ",0:00,0:01,0:02,0:03")).alias("value"))
    return R.read_pair_annotations(s, _text(s, line, "copies")).select(F.regexp_replace("id_a", "^.*/", "").alias("id_a"), F.regexp_replace("id_b", "^.*/", "").alias("id_b"))


QUERIES["src_pair_annotations"] = pair_annotations
SQL["src_pair_annotations"] = "SELECT DISTINCT least(CAST(video1_id AS VARCHAR), CAST(video2_id AS VARCHAR)) AS id_a, greatest(CAST(video1_id AS VARCHAR), CAST(video2_id AS VARCHAR)) AS id_b FROM relationships WHERE video1_id <> video2_id AND video1_id % 13 <> 0"


def files_found(s, d):
    path = _place(s, "tree")
    items(s, d).select(F.col("item").alias("n"), F.col("cluster")).repartition(1).write.partitionBy("cluster").parquet(path)
    return R.discover_files(s, path, [".parquet"]).select(F.regexp_extract("path", r"cluster=(\d+)/", 1).cast("int").alias("cluster")).distinct()


QUERIES["src_discover_files"] = files_found
SQL["src_discover_files"] = "SELECT DISTINCT label AS cluster FROM embeddings"


def sessions_found(s, d):
    m = table(s, d, "maneuver_segments").where("session_id is not null")
    return R.discover_sessions(m.where("label = 1"), m.where("start_frame > 100"), m.select("session_id").distinct(), m.where("lat is not null"), "session_id")


QUERIES["src_discover_sessions"] = sessions_found
SQL["src_discover_sessions"] = "SELECT DISTINCT session_id FROM maneuver_segments WHERE session_id IN (SELECT session_id FROM maneuver_segments WHERE label = 1) AND session_id IN (SELECT session_id FROM maneuver_segments WHERE start_frame > 100) AND session_id IN (SELECT session_id FROM maneuver_segments WHERE lat IS NOT NULL)"


def gps_csv(s, d):
    m = table(s, d, "maneuver_segments").where("start_frame is not null").select("start_frame", "lat", "lng").distinct()
    line = m.select(_cat(_s("start_frame"), ".0,x,", F.coalesce(_s("lat"), F.lit("NaN")), ",", F.coalesce(_s("lng"), F.lit("NaN"))).alias("value"))
    g = R.read_gps(s, _text(s, line, "gps.csv", "time,alt,lng,lat"))
    return g.where("not isnan(lat) and not isnan(lng)").select("ts", "lat", "lng")


QUERIES["src_gps_csv"] = gps_csv
SQL["src_gps_csv"] = "SELECT DISTINCT CAST(start_frame AS DOUBLE) AS ts, lat, lng FROM maneuver_segments WHERE start_frame IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lng)"


def json_tables(s, d):
    """Samples, sensors and calibrations written as JSON, read back with fixed schemas."""
    e = user_events(s, d)
    paths = {n: _place(s, n) for n in ("sample_data", "calibrated", "sensor")}
    e.select(_s("event_id").alias("token"), _s("k").alias("calibrated_sensor_token"), (F.col("sec") * 1e6).cast("long").alias("timestamp")).write.json(paths["sample_data"])
    e.select(_s("k").alias("token"), (F.col("k") % 3).cast("string").alias("sensor_token")).distinct().write.json(paths["calibrated"])
    s.createDataFrame([("0", "CAM_FRONT"), ("1", "CAM_BACK"), ("2", "LIDAR_TOP")], "token string, channel string").write.json(paths["sensor"])
    data = s.read.schema("token string, calibrated_sensor_token string, timestamp long").json(paths["sample_data"])
    cal = s.read.schema("token string, sensor_token string").json(paths["calibrated"])
    return R.camera_frames(data, cal, s.read.schema("token string, channel string").json(paths["sensor"])).select("token", "timestamp")


QUERIES["src_json_tables"] = json_tables
SQL["src_json_tables"] = f"WITH {EVENTS} SELECT CAST(event_id AS VARCHAR) AS token, epoch_us(ts) AS timestamp FROM ev WHERE k % 3 = 0"


def chain_walk(s, d):
    e = user_events(s, d).select("user_id", "event_id", "sec")
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    samples = e.withColumn("nxt", F.lead("event_id").over(w)).select("user_id", _s("event_id").alias("token"), F.when(F.col("event_id") % 37 != 0, _s("nxt")).otherwise(F.lit("gone")).alias("next"), F.col("sec").alias("timestamp"))
    scenes = e.groupBy("user_id").agg(F.min("event_id").cast("string").alias("first_token")).select(F.col("user_id").alias("scene"), "first_token")
    return R.walk_chain(scenes, samples.select("token", "next", "timestamp")).select("scene", "step", "token")


QUERIES["src_chain_walk"] = chain_walk
SQL["src_chain_walk"] = """WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step FROM events),
c AS (SELECT user_id, min(step) AS cut FROM n WHERE event_id % 37 = 0 GROUP BY user_id)
SELECT n.user_id AS scene, step, CAST(event_id AS VARCHAR) AS token FROM n LEFT JOIN c ON c.user_id = n.user_id WHERE cut IS NULL OR step <= cut"""


def can(s, d):
    e = user_events(s, d)
    pose = e.where("event_type = 'view'").select(F.col("user_id").alias("scene"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("utime"), F.array(F.col("value") / 10, F.col("value") / 20).alias("vel"), F.array(F.lit(0.0), F.lit(0.0), (F.col("k") - 50) / 100.0).alias("rotation_rate"))
    steer = e.where("event_type = 'click'").select(F.col("user_id").alias("scene"), F.unix_micros(F.col("ts").cast("timestamp")).alias("utime"), "value")
    return R.can_bus(pose, steer, 86_400.0).select("scene", F.round("sec", 3).alias("sec"), F.round("speed", 6).alias("speed"), F.round("yaw", 6).alias("yaw"), F.round("steer", 5).alias("steer"))


QUERIES["src_can_bus"] = can
SQL["src_can_bus"] = f"""WITH {EVENTS}, l AS (SELECT event_id, user_id, sec, value, k FROM ev WHERE event_type = 'view'), r AS (SELECT user_id, sec AS ts, value FROM ev WHERE event_type = 'click'),
n AS (SELECT l.*, p.ts AS pt, p.value AS pv, q.ts AS nt, q.value AS nv FROM l ASOF LEFT JOIN r p ON l.user_id = p.user_id AND l.sec >= p.ts ASOF LEFT JOIN r q ON l.user_id = q.user_id AND l.sec <= q.ts)
SELECT user_id AS scene, round(sec, 3) AS sec, round(sqrt(pow(value / 10, 2) + pow(value / 20, 2)), 6) AS speed, round((k - 50) / 100.0, 6) AS yaw, round(coalesce(pv + (nv - pv) * (sec - pt) / (nt - pt), pv, nv), 5) AS steer FROM n"""
QUERIES["src_muvr"] = lambda s, d: R.related_videos(table(s, d, "topics"), table(s, d, "videos"), table(s, d, "relationships"), 120).select("video1_id", "video2_id", "topic_id").distinct()
SQL["src_muvr"] = """WITH t AS (SELECT DISTINCT topic_id FROM topics WHERE topic_id IS NOT NULL ORDER BY 1 LIMIT 120), k AS (SELECT DISTINCT video_id FROM videos WHERE video_name IS NOT NULL AND topic_id IN (SELECT topic_id FROM t))
SELECT DISTINCT video1_id, video2_id, topic_id FROM relationships WHERE topic_id IN (SELECT topic_id FROM t) AND video1_id IN (SELECT video_id FROM k) AND video2_id IN (SELECT video_id FROM k)"""

QUERIES["src_muvr_all"] = lambda s, d: R.related_videos(table(s, d, "topics"), table(s, d, "videos"), table(s, d, "relationships")).select("video1_id", "video2_id", "topic_id").distinct()
SQL["src_muvr_all"] = """WITH k AS (SELECT DISTINCT video_id FROM videos WHERE video_name IS NOT NULL)
SELECT DISTINCT video1_id, video2_id, topic_id FROM relationships WHERE video1_id IN (SELECT video_id FROM k) AND video2_id IN (SELECT video_id FROM k)"""


def narrations(s, d):
    a = table(s, d, "activity_segments").where("start_sec is not null and end_sec is not null and start_sec < 36000").select("segment_id", "start_sec", "end_sec").distinct()
    clock = lambda c: F.concat_ws(":", F.lpad(F.floor(F.col(c) / 3600).cast("string"), 2, "0"), F.lpad((F.floor(F.col(c) / 60) % 60).cast("string"), 2, "0"), F.format_string("%05.2f", F.floor(F.col(c) * 100) % 6000 / 100.0))
    line = a.select(_cat(_s("segment_id"), ",P01,V1,", clock("start_sec"), ",", clock("end_sec"), ",open door,1,2").alias("value"))
    n = R.read_narrations(s, _text(s, line, "narrations.csv", "narration_id,participant_id,video_id,start_timestamp,stop_timestamp,narration,verb_class,noun_class"))
    return n.select(F.col("narration_id").cast("bigint").alias("id"), F.round("start_sec", 2).alias("start_sec"), F.round("stop_sec", 2).alias("stop_sec"))


QUERIES["src_epic_csv"] = narrations
SQL["src_epic_csv"] = "SELECT DISTINCT segment_id AS id, round(floor(start_sec * 100) / 100, 2) AS start_sec, round(floor(end_sec * 100) / 100, 2) AS stop_sec FROM activity_segments WHERE end_sec IS NOT NULL AND start_sec < 36000"
QUERIES["src_manifest_json"] = lambda s, d: R.manifest_subset(user_events(s, d).select("event_id"), user_events(s, d).where("value > 20"), "event_id", 100, 42)
SQL["src_manifest_json"] = "SELECT event_id FROM events WHERE value > 20 ORDER BY md5(event_id || '|42'), event_id LIMIT 100"


def ssv2(s, d):
    v = table(s, d, "videos").where("video_id is not null").select("video_id", (F.col("video_id") % 97).alias("pair_id"), (F.col("video_id") % 2).alias("template_id")).distinct()
    path = _place(s, "manifest")
    v.select(F.to_json(F.struct("video_id", "pair_id", "template_id")).alias("value")).write.text(path)
    clips = s.read.text(path).select(F.from_json("value", "video_id long, pair_id long, template_id long").alias("j")).select("j.*")
    return R.clip_pairs(clips)


QUERIES["src_ssv2_manifest"] = QUERIES["join_chiral_pairs"] = ssv2
SQL["src_ssv2_manifest"] = SQL["join_chiral_pairs"] = "WITH v AS (SELECT DISTINCT video_id FROM videos WHERE video_id IS NOT NULL) SELECT a.video_id % 97 AS pair_id, a.video_id AS video_a, b.video_id AS video_b, CAST(a.video_id % 2 = b.video_id % 2 AS INTEGER) AS gt FROM v a JOIN v b ON a.video_id % 97 = b.video_id % 97 AND a.video_id < b.video_id"
QUERIES["src_session_regex"] = lambda s, d: R.activity_sequences(table(s, d, "activity_segments").groupBy("sequence_name").agg(F.max("end_sec").alias("duration")), "sequence_name", "duration").select("person_session", "activity_id", "sequence_name")
SQL["src_session_regex"] = r"""WITH q AS (SELECT sequence_name, max(end_sec) AS duration FROM activity_segments GROUP BY 1),
p AS (SELECT sequence_name, regexp_extract(sequence_name, '^([0-9]{8}_s[0-9]+_[a-z]+_[a-z]+)_(act[0-9]+)_([a-z0-9]+)$', 1) AS person_session, regexp_extract(sequence_name, '^([0-9]{8}_s[0-9]+_[a-z]+_[a-z]+)_(act[0-9]+)_([a-z0-9]+)$', 2) AS activity_id FROM q WHERE duration <= 3600)
SELECT person_session, activity_id, sequence_name FROM p WHERE person_session <> '' AND person_session IN (SELECT person_session FROM p GROUP BY 1 HAVING count(*) >= 2)"""
QUERIES["join_person_pairs"] = lambda s, d: within_group_pairs(R.activity_sequences(table(s, d, "activity_segments").groupBy("sequence_name").agg(F.max("end_sec").alias("duration")), "sequence_name", "duration"), "person_session", "sequence_name", "activity_id").select("person_session", "sequence_name_a", "sequence_name_b", "gt")
SQL["join_person_pairs"] = f"WITH z AS ({SQL['src_session_regex']}) SELECT a.person_session, a.sequence_name AS sequence_name_a, b.sequence_name AS sequence_name_b, CAST(a.activity_id = b.activity_id AS INTEGER) AS gt FROM z a JOIN z b ON a.person_session = b.person_session AND a.sequence_name < b.sequence_name"
QUERIES["src_aria_gps"] = lambda s, d: R.device_positions(table(s, d, "maneuver_segments").select((F.col("start_frame").cast("long") * 333).alias("utc_time_ms"), F.col("lat").alias("latitude"), F.col("lng").alias("longitude"), (F.col("segment_id") % 150).cast("double").alias("accuracy"))).select(F.round("sec", 3).alias("sec"), "latitude", "longitude", "accuracy").distinct()
SQL["src_aria_gps"] = "SELECT DISTINCT round(CAST(start_frame AS BIGINT) * 333 / 1000.0, 3) AS sec, CASE WHEN isfinite(lat) THEN lat END AS latitude, CASE WHEN isfinite(lng) THEN lng END AS longitude, CAST(segment_id % 150 AS DOUBLE) AS accuracy FROM maneuver_segments WHERE NOT (lat = 0 AND lng = 0) AND CAST(start_frame AS BIGINT) * 333 > 0 AND segment_id % 150 <= 100"


def imu(s, d):
    e = user_events(s, d)
    sample = F.struct(F.col("sec").alias("ts"), F.array(F.col("value"), F.col("k") * 1.0, F.lit(1.0)).alias("accel"), F.array(F.lit(0.5), F.lit(0.25), F.col("k") / 4.0).alias("gyro"))
    path = _place(s, "imu")
    e.select(F.to_json(F.struct((F.col("event_id") % 2).alias("stream"), F.array(sample).alias("samples"))).alias("value")).write.text(path)
    return R.device_motion(s.read.text(path), 100.0).select(F.round("ts", 3).alias("ts"), F.round(F.col("ay").cast("double"), 3).alias("ay"), F.round(F.col("gz").cast("double"), 3).alias("gz"))


QUERIES["src_aria_imu"] = imu
SQL["src_aria_imu"] = f"WITH {EVENTS} SELECT round(sec + 100, 3) AS ts, CAST(k AS DOUBLE) AS ay, round(k / 4.0, 3) AS gz FROM ev WHERE event_id % 2 = 0"
QUERIES["src_prompts"] = lambda s, d: R.prompts(table(s, d, "topics").select(F.to_json(F.struct(F.array(F.col("name")).alias("prompts"))).alias("value")), ["which way?"], "whole?").select(F.concat_ws("|", "prompts").alias("prompts"), "integrity_prompt").distinct()
SQL["src_prompts"] = "SELECT DISTINCT coalesce(name, '') AS prompts, 'whole?' AS integrity_prompt FROM topics"
QUERIES["src_aria_meta"] = lambda s, d: R.recording_start(user_events(s, d).select(F.to_json(F.struct(F.struct(F.to_json(F.struct(F.floor("sec").alias("start_time"))).alias("metadata")).alias("tags"))).alias("value"))).distinct()
SQL["src_aria_meta"] = f"WITH {EVENTS} SELECT DISTINCT CAST(floor(sec) AS BIGINT) AS start_time FROM ev"


def templates(s, d):
    rows = [(i, f"{verb} [something] {way}{tail}") for i, (verb, way, tail) in enumerate((v, w, t) for v in ("Pushing", "Moving", "Pulling") for w in ("from left to right", "from right to left", "up", "down") for t in ("", " onto [something]"))]
    return R.chiral_templates(s.createDataFrame([(n, i) for i, n in rows], "name string, template_id int"))


QUERIES["join_chiral_templates"] = templates
SQL["join_chiral_templates"] = """WITH v AS (SELECT * FROM (VALUES (0, 'Pushing'), (8, 'Moving'), (16, 'Pulling')) AS t(b, verb)), k AS (SELECT unnest([0, 1]) AS k)
SELECT b + k AS id_a, b + 2 + k AS id_b, 'left_right' AS axis, 'left_to_right' AS direction_a, 'right_to_left' AS direction_b FROM v, k
UNION ALL SELECT b + 4 + k, b + 6 + k, 'up_down', 'up', 'down' FROM v, k"""

# sinks: written, then read again


def report(s, d):
    text = W.report_json(items(s, d).groupBy("cluster").agg(F.count("*").alias("n")).orderBy("cluster"))
    rows = [(r["cluster"], r["n"]) for r in json.loads(text)]
    return s.createDataFrame(rows, "cluster int, n long")


QUERIES["sink_json_report"] = report
SQL["sink_json_report"] = "SELECT label AS cluster, count(*) AS n FROM embeddings GROUP BY label"


def staged(s, d):
    path = _place(s, "cache")
    W.write_staged(items(s, d).select("item", "cluster").where("item < 0"), path)
    W.write_staged(items(s, d).select("item", "cluster"), path)
    return s.read.schema("item long, cluster int").parquet(path)


QUERIES["sink_feature_cache"] = staged
SQL["sink_feature_cache"] = "SELECT vec_id AS item, label AS cluster FROM embeddings"


def groups(s, d):
    path = _place(s, "groups")
    e = user_events(s, d).select("event_id", "event_type", "value")
    W.write_groups(e, path, "event_type", ["event_id"])
    W.write_groups(e.where("event_type = 'click'").withColumn("value", F.lit(1.0)), path, "event_type", ["event_id"])
    return s.read.schema("event_id long, value double, event_type string").parquet(path).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


QUERIES["sink_hdf5_groups"] = groups
SQL["sink_hdf5_groups"] = "SELECT event_type, count(*) AS n, round(sum(CASE WHEN event_type = 'click' THEN 1.0 ELSE value END), 2) AS total FROM events GROUP BY event_type"
QUERIES["sink_cache_validation"] = lambda s, d: W.score_completeness(table(s, d, "scores"), "query_indices", "cand_id", "bot_similarity")
SQL["sink_cache_validation"] = "SELECT query_indices, count(*) AS n, CAST(sum(CASE WHEN bot_similarity IS NULL OR NOT isfinite(bot_similarity) THEN 1 ELSE 0 END) AS BIGINT) AS bad FROM scores WHERE query_indices <> cand_id GROUP BY query_indices"
QUERIES["sink_csv_wide"] = lambda s, d: W.wide_table(user_events(s, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n")), "user_id", "event_type", "n", ["click", "view", "nothing"])
SQL["sink_csv_wide"] = "SELECT user_id, coalesce(CAST(nullif(count(*) FILTER (event_type = 'click'), 0) AS VARCHAR), '') AS click, coalesce(CAST(nullif(count(*) FILTER (event_type = 'view'), 0) AS VARCHAR), '') AS view, '' AS nothing FROM events GROUP BY user_id"

# scalar functions

QUERIES["fn_clock_name"] = lambda s, d: user_events(s, d).select("event_id", T.clock_name(F.col("value") * 100).alias("name"))
SQL["fn_clock_name"] = "SELECT event_id, lpad(CAST(CAST(floor(floor(value * 100) / 3600) AS BIGINT) AS VARCHAR), 2, '0') || '.' || lpad(CAST(CAST(floor(floor(value * 100) / 60) AS BIGINT) % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(CAST(floor(value * 100) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS name FROM events"
QUERIES["fn_template"] = lambda s, d: user_events(s, d).select("event_id", T.plain_template(_cat("Moving [a ", F.col("event_type"), "] ", _s("k"), "[x] ")).alias("t"))
SQL["fn_template"] = f"WITH {EVENTS} SELECT event_id, 'Moving X ' || k || 'X' AS t FROM ev"
QUERIES["fn_file_time"] = lambda s, d: user_events(s, d).select("event_id", T.file_name_unix(_cat(F.date_format("ts", "yyyy-MM-dd-HH-mm-ss"), "_new_0.75.mp4")).alias("unix"))
SQL["fn_file_time"] = "SELECT event_id, epoch(CAST(date_trunc('second', ts) AS TIMESTAMP)) + 28800 AS unix FROM events"
