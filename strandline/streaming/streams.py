"""Streams of events: windowed pooling, session segments, runs with state, and look-ups per micro-batch.

Every query is checkpointed; state is bounded by watermarks (late rows beyond them are dropped, as a
stream must decide) and, for runs, by a time-out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandline.scratch import shared_root


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 8) -> DataFrame:
    """A stream of the Parquet files in the folder ``path``, or of that one file."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        folder, name = path.rsplit("/", 1)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def tumbling_pool(events: DataFrame, ts: str, keys: list[str], value: str, width: str, late: str) -> DataFrame:
    """(keys, start, n, mean, max) per window of ``width``; the watermark lets rows come ``late``."""
    windowed = events.withWatermark(ts, late).groupBy(*keys, F.window(ts, width).alias("w"))
    return windowed.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max")).select(*keys, F.col("w.start").alias("start"), "n", "mean", "max")


def session_segments(events: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    """(key, start, stop, n): stretches of events no more than ``gap`` apart; ``stop`` is the last event's time plus the gap."""
    sessions = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return sessions.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


_RUN_STATE = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("last", T.LongType()), T.StructField("n", T.LongType())])


def run_segments(events: DataFrame, key: str, order: str, label: str, ts: str, late: str, idle_ms: int = 86_400_000) -> DataFrame:
    """(key, label, start, last, n): runs of equal labels per key, emitted when another label comes, or the key has been
    idle for ``idle_ms`` of event time.  One open run per key is all the state."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        open_run = list(state.get) if state.exists else None
        if state.hasTimedOut:
            rows.append((k[0], *open_run))
            state.remove()
        else:
            frame = pd.concat(list(batches)).sort_values(order, kind="stable")
            for lab, at in zip(frame[label], frame[order]):
                if open_run is not None and lab == open_run[0]:
                    open_run[2], open_run[3] = int(at), open_run[3] + 1
                else:
                    if open_run is not None:
                        rows.append((k[0], *open_run))
                    open_run = [lab, int(at), int(at), 1]
            newest = int(pd.to_datetime(frame[ts]).max().timestamp() * 1000)
            state.update(tuple(open_run))
            state.setTimeoutTimestamp(max(newest + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["key", "label", "start", "last", "n"])

    out = f"key {events.schema[key].dataType.simpleString()}, label string, start long, last long, n long"
    return events.withWatermark(ts, late).groupBy(key).applyInPandasWithState(step, out, _RUN_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_to_table(stream: DataFrame, name: str, mode: str = "append", each_batch: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run a stream over all that is there now, into a table of the shared folder, and return that table."""
    spark = stream.sparkSession
    root = f"{shared_root(spark)}/strandline-stream-{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{root}/state")
    if each_batch is not None:
        writer.foreachBatch(each_batch).start().awaitTermination()
        return stream
    if mode == "append":
        writer.outputMode("append").format("parquet").option("path", f"{root}/out").start().awaitTermination()
    else:
        # complete results replace each other; the last one stands
        def replace(df: DataFrame, _: int) -> None:
            df.write.mode("overwrite").parquet(f"{root}/out")

        writer.outputMode(mode).foreachBatch(replace).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def best_of_gallery(queries: DataFrame, gallery: DataFrame, out: str, score: Callable[[DataFrame, DataFrame], DataFrame], k: int) -> DataFrame:
    """Each micro-batch of queries against a static gallery: the k best candidates of every query go to the table ``out``."""
    from pyspark.sql import Window

    def batch(df: DataFrame, batch_id: int) -> None:
        scored = score(df, gallery)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "cand_id"))
        scored.withColumn("place", place).where(F.col("place") <= k).select("query_id", "cand_id", "place").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    run_to_table(queries, "gallery", each_batch=batch)
    return queries.sparkSession.read.schema("query_id long, cand_id long, place int").parquet(out).select("query_id", "cand_id", "place")
