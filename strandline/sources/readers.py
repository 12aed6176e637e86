"""Readers: files to DataFrames with a fixed schema, so that no read infers one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.parse import clock_seconds, sequence_parts
from strandline.operators.asof import asof_interpolate

PAIR_HEADERS = ("id_a", "video_a", "query")


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id string, emb array<array<double>>) from Parquet; a file with other columns is refused before any job runs."""
    df = spark.read.parquet(path)
    missing = {"seq_id", "emb"} - set(df.columns)
    if missing:
        raise ValueError(f"not a sequence file, missing: {', '.join(sorted(missing))}")
    return df.select(F.col("seq_id").cast("string").alias("seq_id"), F.col("emb").cast("array<array<double>>").alias("emb"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(id_a, id_b, label int) of a comma text: values trimmed, lines of fewer than three fields skipped.
    A heading is a line whose first field is one of ``PAIR_HEADERS`` (any case) and whose third is no number, wherever a
    split of the file puts it."""
    lines = spark.read.text(path).select(F.split("value", ",").alias("f"))
    rows = lines.where(F.size("f") >= 3).select(*(F.trim(F.col("f")[i]).alias(c) for i, c in enumerate(("id_a", "id_b", "label"))))
    header = F.lower("id_a").isin(*PAIR_HEADERS) & F.col("label").try_cast("int").isNull()
    return rows.where(~header).select("id_a", "id_b", F.col("label").try_cast("int").alias("label"))


def read_pair_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b, each once: lines of exactly six fields a,b,...; ids get the file's name as prefix."""
    lines = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]*$", 1).alias("cat"), F.split("value", ",", -1).alias("f")).where(F.size("f") == 6)
    named = [F.concat_ws("/", "cat", F.trim(F.col("f")[i])) for i in (0, 1)]
    return lines.select(F.least(*named).alias("id_a"), F.greatest(*named).alias("id_b")).where("id_a <> id_b").distinct()


def discover_files(spark: SparkSession, root: str, extensions: Sequence[str]) -> DataFrame:
    """(path): relative paths of the files below ``root`` with one of the extensions (any case); contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    base = F.regexp_replace("path", "^.*" + root.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return found.where(suffix.isin([e.lower() for e in extensions])).select(base.alias("path"))


def discover_sessions(labels: DataFrame, folders: DataFrame, videos: DataFrame, gps: DataFrame, id: str) -> DataFrame:
    """Sessions with a label file, a folder, a video and positions: the videos' rows of those."""
    out = videos
    for other in (labels, folders, gps):
        out = out.join(other.select(id).distinct(), id, "left_semi")
    return out


def read_gps(spark: SparkSession, path: str) -> DataFrame:
    """(ts, lat, lng): columns 0, 2 and 3 of a comma file whose headings have lat and lng the wrong way round."""
    raw = spark.read.schema("ts double, c1 string, lng_named_lat string, lat_named_lng string").option("header", True).option("enforceSchema", True).csv(path)
    return raw.select("ts", F.col("lng_named_lat").try_cast("double").alias("lat"), F.col("lat_named_lng").try_cast("double").alias("lng"))


def camera_frames(sample_data: DataFrame, calibrated: DataFrame, sensors: DataFrame, channel: str = "CAM_FRONT") -> DataFrame:
    """sample_data rows taken by one sensor channel."""
    of_channel = calibrated.join(sensors.where(F.col("channel") == channel).select(F.col("token").alias("sensor_token")), "sensor_token", "left_semi")
    return sample_data.join(of_channel.select(F.col("token").alias("calibrated_sensor_token")), "calibrated_sensor_token", "left_semi")


def walk_chain(scenes: DataFrame, samples: DataFrame) -> DataFrame:
    """(scene, step, token, timestamp): samples in the order of their ``next`` links from each scene's first one.

    Links double in length every round (pointer jumping): log2(longest chain) joins, not one per link.  A missing token
    ends the chain; a cycle is refused.
    """
    from strandline.scratch import Scratch

    spark = scenes.sparkSession
    scratch = Scratch(spark, "chain")
    # distance to the chain's end by doubling: (token, to, hops) with to = null once the end is passed
    known = samples.select(F.col("token").alias("to"))
    jump = samples.select("token", F.col("next").alias("to")).join(known, "to", "left_semi").select("token", "to")
    reach = samples.select("token").join(jump, "token", "left").select("token", "to", F.when(F.col("to").isNotNull(), 1).otherwise(0).cast("long").alias("hops"))
    reach = scratch.table(reach)
    # a chain of distinct tokens has fewer links than there are samples; a link open beyond that is part of a cycle
    steps, n_samples = 1, samples.count()
    while reach.where("to is not null").limit(1).count():
        if steps > n_samples:
            raise ValueError("the next links of the samples form a cycle")
        far = reach.select(F.col("token").alias("to"), F.col("to").alias("to2"), F.col("hops").alias("hops2"))
        after = reach.join(far, "to", "left").select("token", F.col("to2").alias("to"), (F.col("hops") + F.coalesce("hops2", F.lit(0))).alias("hops"))
        reach = scratch.table(after)
        steps *= 2
    # every sample of a chain lies as many hops before the end as its distance from the first sample tells
    first = scenes.select("scene", F.col("first_token").alias("token")).join(reach.select("token", F.col("hops").alias("length")), "token")
    ends = chain_ends(samples, scratch)
    placed = samples.select("token", "timestamp").join(reach.select("token", "hops"), "token").join(ends, "token")
    starts = first.join(ends, "token").select("scene", "length", "end")
    return placed.join(starts, "end").where(F.col("hops") <= F.col("length")).select("scene", (F.col("length") - F.col("hops")).alias("step"), "token", "timestamp")


def chain_ends(samples: DataFrame, scratch) -> DataFrame:
    """(token, end): the last token reachable from each."""
    known = samples.select(F.col("token").alias("next"))
    to = samples.join(known, "next", "left_semi").select("token", F.col("next").alias("end"))
    ends = scratch.table(samples.select("token").join(to, "token", "left").select("token", F.coalesce("end", "token").alias("end")))
    while True:
        far = ends.select(F.col("token").alias("end"), F.col("end").alias("end2"))
        after = scratch.table(ends.join(far, "end").select("token", F.col("end").alias("old"), F.col("end2").alias("end")))
        if not after.where("old <> end").limit(1).count():
            return after.select("token", "end")
        ends = after.select("token", "end")


def can_bus(pose: DataFrame, steer: DataFrame, bucket: float = 60.0) -> DataFrame:
    """(scene, sec, speed, yaw, steer): microseconds to seconds, speed from the velocity, steering interpolated."""
    p = pose.select("scene", (F.col("utime") / 1e6).alias("sec"), F.sqrt(F.col("vel")[0] * F.col("vel")[0] + F.col("vel")[1] * F.col("vel")[1]).alias("speed"), F.col("rotation_rate")[2].alias("yaw"))
    s = steer.select("scene", (F.col("utime") / 1e6).alias("ts"), "value")
    return asof_interpolate(p, s, ["scene"], "sec", "ts", "value", bucket, out="steer")


def related_videos(topics: DataFrame, videos: DataFrame, relationships: DataFrame, first_topics: int | None = None) -> DataFrame:
    """Pairs both of whose videos can be resolved (have a name), of the first topics if a number of them is given."""
    known, out = videos.where(F.col("video_name").isNotNull()), relationships
    if first_topics is not None:
        chosen = topics.select("topic_id").dropna().distinct().orderBy("topic_id").limit(first_topics)
        known, out = known.join(chosen, "topic_id", "left_semi"), out.join(chosen, "topic_id", "left_semi")
    known = known.select("video_id").distinct()
    for side in ("video1_id", "video2_id"):
        out = out.join(known.withColumnRenamed("video_id", side), side, "left_semi")
    return out


def read_narrations(spark: SparkSession, path: str) -> DataFrame:
    """Narrations with start_sec and stop_sec from HH:MM:SS.ss."""
    schema = "narration_id string, participant_id string, video_id string, start_timestamp string, stop_timestamp string, narration string, verb_class int, noun_class int"
    raw = spark.read.schema(schema).option("header", True).csv(path)
    return raw.withColumn("start_sec", clock_seconds(F.col("start_timestamp"))).withColumn("stop_sec", clock_seconds(F.col("stop_timestamp")))


def manifest_subset(manifest: DataFrame, available: DataFrame, id: str, n: int, seed: int) -> DataFrame:
    """``n`` manifest rows whose file is there, chosen by md5 key, sorted by id."""
    key = F.md5(F.concat_ws("|", F.col(id).cast("string"), F.lit(str(seed))))
    return manifest.join(available.select(id).distinct(), id, "left_semi").orderBy(key, id).limit(n).orderBy(id)


def clip_pairs(clips: DataFrame) -> DataFrame:
    """(pair_id, video_a, video_b, gt): all clips of a chiral pair against each other; gt where the template agrees."""
    from strandline.operators.pairs import within_group_pairs

    return within_group_pairs(clips, "pair_id", "video_id", "template_id").select("pair_id", F.col("video_id_a").alias("video_a"), F.col("video_id_b").alias("video_b"), "gt")


def activity_sequences(names: DataFrame, name: str, duration: str, longest: float = 3600.0) -> DataFrame:
    """(person_session, activity_id, name, duration) of well-formed names not over ``longest``, in sessions with at least two."""
    rows = names.withColumn("p__", sequence_parts(F.col(name))).where(F.col("p__").isNotNull() & (F.col(duration) <= longest)).select("p__.person_session", "p__.activity_id", F.col(name).alias("sequence_name"), F.col(duration).alias("duration"))
    several = rows.groupBy("person_session").agg(F.count("*").alias("n__")).where("n__ >= 2")
    return rows.join(several.select("person_session"), "person_session", "left_semi")


def device_positions(raw: DataFrame) -> DataFrame:
    """(sec, latitude, longitude, accuracy): no (0, 0), UTC above 0, accuracy up to 100; milliseconds to seconds.
    A coordinate that is no finite number is null."""
    ok = ~((F.col("latitude") == 0) & (F.col("longitude") == 0)) & (F.col("utc_time_ms") > 0) & (F.col("accuracy") <= 100)
    return raw.where(ok).select((F.col("utc_time_ms") / 1000).alias("sec"), *(F.when(F.abs(c) < float("inf"), F.col(c)).alias(c) for c in ("latitude", "longitude")), "accuracy")


def device_motion(raw: DataFrame, offset: float) -> DataFrame:
    """(ts, ax..gz) of stream 0 from JSON {"stream", "samples": [{"ts", "accel", "gyro"}]}, device time shifted to UTC."""
    schema = "stream int, samples array<struct<ts: double, accel: array<float>, gyro: array<float>>>"
    rows = raw.select(F.from_json("value", schema).alias("j")).where("j.stream = 0").select(F.explode("j.samples").alias("s"))
    axes = [F.col(f"s.{k}")[i].alias(f"{k[0]}{a}") for k in ("accel", "gyro") for i, a in enumerate("xyz")]
    return rows.select((F.col("s.ts") + offset).alias("ts"), *axes)


def prompts(raw: DataFrame, defaults: Sequence[str], integrity: str) -> DataFrame:
    """(prompts array, integrity_prompt) of JSON text; what is absent takes its default, a wrong type fails."""
    j = raw.select(F.from_json("value", "prompts array<string>, integrity_prompt string").alias("j"))
    return j.select(F.coalesce("j.prompts", F.array(*(F.lit(p) for p in defaults))).alias("prompts"), F.coalesce("j.integrity_prompt", F.lit(integrity)).alias("integrity_prompt"))


def recording_start(raw: DataFrame) -> DataFrame:
    """(start_time): from JSON text within JSON, tags.metadata holding an object with start_time."""
    inner = F.get_json_object("value", "$.tags.metadata")
    return raw.select(F.get_json_object(inner, "$.start_time").try_cast("long").alias("start_time"))


def chiral_templates(templates: DataFrame) -> DataFrame:
    """(id_a, id_b, axis, direction_a, direction_b): opposite templates of like verb and tail, each template used once.

    Of several candidates the smallest ids go together; the axes are taken in order, so a template used on
    the first axis is not used on the second.
    """
    from strandline.functions.parse import DIRECTIONS, plain_template

    plain = templates.select("template_id", plain_template(F.col("name")).alias("t"))
    out = None
    for axis, pa, pb, da, db in DIRECTIONS:
        left = plain.where(F.col("t").rlike(pa)).select(F.col("template_id").alias("id_a"), *(F.trim(F.regexp_extract("t", pa, i)).alias(k) for i, k in ((1, "verb"), (2, "tail"))))
        right = plain.where(F.col("t").rlike(pb)).select(F.col("template_id").alias("id_b"), *(F.trim(F.regexp_extract("t", pb, i)).alias(k) for i, k in ((1, "verb"), (2, "tail"))))
        # within (verb, tail) the n-th of one side goes with the n-th of the other: each is used once
        w = Window.partitionBy("verb", "tail")
        left = left.withColumn("k", F.row_number().over(w.orderBy("id_a")))
        right = right.withColumn("k", F.row_number().over(w.orderBy("id_b")))
        pairs = left.join(right, ["verb", "tail", "k"]).where("id_a <> id_b").select("id_a", "id_b", F.lit(axis).alias("axis"), F.lit(da).alias("direction_a"), F.lit(db).alias("direction_b"))
        if out is None:
            out = pairs
        else:
            used = out.select(F.explode(F.array("id_a", "id_b")).alias("u")).distinct()
            pairs = pairs.join(used.withColumnRenamed("u", "id_a"), "id_a", "left_anti").join(used.withColumnRenamed("u", "id_b"), "id_b", "left_anti")
            out = out.unionByName(pairs.select(out.columns))
    return out
