"""Queries of the training-data operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.bpe import encode_corpus, token_counts
from strandline.llm.components import connected_components, relationship_links
from strandline.llm.mixing import Mix, mix_sources
from strandline.llm.mojibake import repair_documents
from strandline.llm.runs import collapse_runs
from strandline.llm.splits import assign_splits, consolidate, own_key, session_reading, split_targets
from strandline.llm.topn import By, top_n_per_group
from strandline.scratch import Scratch
from strandline.tables import table


def _clean_session(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"(?U)^\s+|\s+$", "")


def _runs(spark: SparkSession, d: str) -> DataFrame:
    segments = table(spark, d, "maneuver_segments").where(F.col("label").isin(1, 2, 3))
    segments = segments.select("segment_id", _clean_session(F.col("session_id")).alias("session_id"), "label", "start_frame", "end_frame")
    return collapse_runs(segments, "session_id", "label", "start_frame", "end_frame", "segment_id", gap=6)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).where("n_events >= 2").select("session_id", "label", "start_frame", "end_frame").distinct()


def p1_runs(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    links = relationship_links(table(spark, d, "relationships"), table(spark, d, "videos"))
    return connected_components(links, "video1_id", "video2_id").select(F.col("record").alias("video_id"), F.col("group").alias("group_id"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    videos = table(spark, d, "videos")
    links = relationship_links(table(spark, d, "relationships"), videos)
    return connected_components(links, "video1_id", "video2_id", records=videos, record="video_id").select(F.col("record").alias("video_id"), F.col("group").alias("group_id"))


def _finite(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "scores").withColumn("bot_similarity", _finite(F.col("bot_similarity"))).withColumn("dtw_distance", _finite(F.col("dtw_distance")))
    return s.where(F.col("bot_similarity").isNotNull() & (F.col("query_indices") != F.col("cand_id")))


def _best(spark: SparkSession, d: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return top_n_per_group(_scored(spark, d), "query_indices", "cand_id", [By("bot_similarity", descending=True), By("dtw_distance")], 10, keep)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _best(spark, d).select("query_indices", "cand_id")


def p3_ranked(spark: SparkSession, d: str) -> DataFrame:
    return _best(spark, d, ("bot_similarity", "dtw_distance"))


def _keyed_activity(spark: SparkSession, d: str) -> DataFrame:
    """(segment_id, person_session, session_key): the key is the name that hash-to-min finds for the row's spelling."""
    rows = table(spark, d, "activity_segments")
    rows = rows.select("segment_id", "person_session", session_reading(F.col("person_session"), F.col("sequence_name"), F.col("video_path")).alias("read"))
    rows = Scratch(spark, "keys").table(rows)  # read twice, so that the patterns are matched once
    return consolidate(rows, F.col("read.spelling"), F.col("read.name"), "session_key").drop("read")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _keyed_activity(spark, d).where(F.col("session_key").isNotNull() & ~F.col("session_key").eqNullSafe(F.col("person_session")))
    return rows.select("segment_id", "session_key").distinct()


def p4_activity(spark: SparkSession, d: str) -> DataFrame:
    # a row whose person-session is the key of another session ties the two; one that is no key at all ties nothing,
    # but rows without any key are kept together by it
    rows = _keyed_activity(spark, d)
    rows = rows.withColumn("entity", F.coalesce("session_key", F.concat(F.lit("?"), F.lower(F.trim("person_session")))))
    rows = rows.withColumn("also", F.coalesce(own_key(F.col("person_session")), "entity"))
    out = assign_splits(rows, "entity", "also", split_targets(table(spark, d, "partition_targets")), ["segment_id"])
    return out.select("segment_id", "person_session", "session_key", F.col("split").alias("part")).distinct()


def p4_maneuver(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "maneuver_segments").select("segment_id", _clean_session(F.col("session_id")).alias("session_id"))
    return assign_splits(rows, "session_id", None, split_targets(table(spark, d, "partition_targets")), ["segment_id"]).select("segment_id", "session_id", F.col("split").alias("part")).distinct()


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    # a score whose cluster isn't known is tied to its query's other scores, and so to the cluster these know
    folds = table(spark, d, "loco_folds").select(F.lit(None).cast("bigint").alias("query_indices"), F.lit(None).cast("bigint").alias("cand_id"), "cluster_id")
    known = F.when(F.col("query_clusters") >= 0, F.col("query_clusters"))
    rows = folds.unionByName(table(spark, d, "scores").select("query_indices", "cand_id", known.alias("cluster_id")))
    rows = rows.withColumn("entity", F.concat(F.lit("c"), F.col("cluster_id"))).withColumn("also", F.concat(F.lit("q"), F.col("query_indices")))
    out = assign_splits(rows, "entity", "also", split_targets(table(spark, d, "partition_targets")), ["cand_id"])
    return out.select("query_indices", "cand_id", "cluster_id", F.col("split").alias("part")).distinct()


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each part against the proportions asked for, by table."""
    parts = [p4_activity(spark, d).select(F.lit("activity").alias("dataset"), "part"), p4_maneuver(spark, d).select(F.lit("maneuver").alias("dataset"), "part"), p4_clusters(spark, d).select(F.lit("clusters").alias("dataset"), "part")]
    counts = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("dataset", "part").agg(F.count("*").alias("n"))
    asked = table(spark, d, "partition_targets").select(F.col("partition_name").alias("part"), "proportion").dropna().distinct()
    every = asked.crossJoin(F.broadcast(spark.createDataFrame([("activity",), ("maneuver",), ("clusters",)], "dataset string")))  # three rows a target
    out = every.join(counts, ["dataset", "part"], "left").fillna(0, ["n"])
    total = F.sum("n").over(Window.partitionBy("dataset"))  # a row a part
    return out.select("dataset", "part", F.round("proportion", 6).alias("target_share"), "n", F.round(F.when(total > 0, F.col("n") / total).otherwise(0.0), 6).alias("actual_share"))


def _vocabulary(spark: SparkSession) -> str:
    """The vocabulary file's place, a setting of the session."""
    return spark.conf.get("spark.strandline.tokenizers", "/opt/tokenizers").rstrip("/") + "/byte_bpe_50k.tiktoken"


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select("doc_id", "text")
    return encode_corpus(documents, "text", _vocabulary(spark)).select("doc_id", "ids")


def _mix(spark: SparkSession, d: str) -> Mix:
    documents = table(spark, d, "documents").select("doc_id", "source", "text")
    return mix_sources(token_counts(documents, "text", _vocabulary(spark)), "doc_id", "source", "n_tokens", table(spark, d, "mix_targets"))


def p7_selection(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).selection


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).shares


def p7_char_shares(spark: SparkSession, d: str) -> DataFrame:
    """The mixture by characters, a size that SQL can count as well."""
    documents = table(spark, d, "documents").select("doc_id", "source", F.char_length("text").alias("n_chars"))
    return mix_sources(documents, "doc_id", "source", "n_chars", table(spark, d, "mix_targets")).shares


def _repaired(spark: SparkSession, d: str) -> DataFrame:
    return repair_documents(table(spark, d, "documents").select("doc_id", "text"), "text").where("garbled")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _repaired(spark, d).select("doc_id").distinct()


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return _repaired(spark, d).select("doc_id", "restored")


def p8_routes(spark: SparkSession, d: str) -> DataFrame:
    """Garbled documents by how they were found: only utf-8, single-byte and wide are strict round trips."""
    return _repaired(spark, d).groupBy(F.concat_ws(", ", "routes").alias("routes")).agg(F.count_distinct("doc_id").alias("n_documents"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_runs, p2_found, p2_groups, p3_found, p3_ranked, p4_found, p4_activity, p4_maneuver, p4_clusters, p4_shares, p6_ids, p7_selection, p7_shares, p7_char_shares, p8_found, p8_restored, p8_routes)}


