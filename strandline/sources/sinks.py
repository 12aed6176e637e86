"""Writers: reports, staged tables, partitioned exports, wide tables; and the check of a stored score table."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def report_json(rows: DataFrame) -> str:
    """An indented JSON array of a report's rows; a report is small by nature, more than 100,000 rows are refused."""
    found = rows.limit(100_001).toJSON().collect()
    if len(found) > 100_000:
        raise ValueError("a report of more than 100,000 rows is a table: write it as one")
    return json.dumps([json.loads(r) for r in found], indent=2)


def write_staged(df: DataFrame, path: str) -> None:
    """Replace the table at ``path`` as a whole: it is written beside it and put in its place only when complete."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    staging, old = f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp", f"{path.rstrip('/')}.{uuid.uuid4().hex}.old"
    df.write.parquet(staging)
    to_path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = to_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = fs.exists(to_path(path))
    if had and not fs.rename(to_path(path), to_path(old)):
        raise OSError(f"cannot move {path}")
    if not fs.rename(to_path(staging), to_path(path)):
        if had:
            fs.rename(to_path(old), to_path(path))
        raise OSError(f"cannot put {staging} in place")
    if had:
        fs.delete(to_path(old), True)


def write_groups(df: DataFrame, path: str, group: str, order: Sequence[str]) -> None:
    """One folder per group, rows in order; groups that aren't in ``df`` keep what they have."""
    df.repartition(group).sortWithinPartitions(group, *order).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(group).parquet(path)


def fingerprint(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row that tells whether a table holds the same rows: their number and an order-free sum of hashes."""
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*keys).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash"))


def _not_finite(c: str) -> Column:
    return F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def score_completeness(scores: DataFrame, query: str, cand: str, score: str) -> DataFrame:
    """(query, n, bad): per query the scores of other items, and how many of them aren't finite."""
    return scores.where(F.col(query) != F.col(cand)).groupBy(query).agg(F.count("*").alias("n"), F.sum(_not_finite(score).cast("long")).alias("bad"))


def wide_table(rows: DataFrame, key: str, names: str, values: str, columns: Sequence[str]) -> DataFrame:
    """One text row per key with a fixed set of columns; what is missing is empty."""
    wide = rows.groupBy(key).pivot(names, list(columns)).agg(F.max(F.col(values).cast("string")))
    return wide.select(key, *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns))


def written_text(spark: SparkSession, lines: DataFrame, path: str) -> str:
    lines.write.mode("overwrite").text(path)
    return path
