"""How the driver's tables stand in for sequences, items and series, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.tables import table

T, D = 8, 8  # an embedding of 64 read as 8 steps of 8


def r6(c: Column | str) -> Column:
    """Rounded for comparison; no negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def items(spark: SparkSession, d: str) -> DataFrame:
    """(item, cluster, kind, v): kind is the second label."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("item"), F.col("label").alias("cluster"), (F.col("vec_id") % 3).cast("int").alias("kind"), F.col("embedding").cast("array<double>").alias("v"))


def seqs(spark: SparkSession, d: str, steps: int = T, dims: int = D) -> DataFrame:
    """``items`` with the packed sequence x."""
    return items(spark, d).withColumn("x", F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.slice("v", i * dims + 1, dims)))


ITEMS = "items AS (SELECT vec_id AS item, label AS cluster, CAST(vec_id % 3 AS INTEGER) AS kind, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
SEQS = f"seqs AS (SELECT item, cluster, kind, v, list_transform(range(0, {T}), lambda i: list_slice(v, i * {D} + 1, i * {D} + {D})) AS x FROM items)"
CELLS = f"""cells AS (SELECT item, cluster, kind, CAST(i // {D} AS BIGINT) AS pos, CAST(i % {D} AS BIGINT) AS dim, val
  FROM (SELECT item, cluster, kind, generate_subscripts(v, 1) - 1 AS i, unnest(v) AS val FROM items))"""


def matrix_rows(df: DataFrame, keys: Sequence[str], x: Column | str) -> DataFrame:
    """(keys, pos, dim, val), rounded."""
    steps = df.select(*keys, F.posexplode(x).alias("pos", "vec"))
    cells = steps.select(*keys, F.col("pos").cast("bigint").alias("pos"), F.posexplode("vec").alias("dim", "val"))
    return cells.select(*keys, "pos", F.col("dim").cast("bigint").alias("dim"), r6("val").alias("val"))


def vector_rows(df: DataFrame, keys: Sequence[str], v: Column | str) -> DataFrame:
    """(keys, dim, val), rounded."""
    cells = df.select(*keys, F.posexplode(v).alias("dim", "val"))
    return cells.select(*keys, F.col("dim").cast("bigint").alias("dim"), r6("val").alias("val"))


def user_events(spark: SparkSession, d: str) -> DataFrame:
    """events with a number for the JSON member k and seconds of the time stamp."""
    e = table(spark, d, "events")
    return e.select("event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("sec"), "ts")


EVENTS = "ev AS (SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, epoch_us(ts) / 1e6 AS sec, ts FROM events)"
