"""Materialised intermediate tables in the folder that all executors share.

Iterative operators cut their lineage by writing a table and reading it back.  The folder is the one the
cluster names in ``spark.checkpoint.dir``, or else the one given to ``setCheckpointDir``.  Only a session whose
executors run on this machine (master ``local``) may have neither and gets a folder of its own; others are refused.
A written table survives the loss of any executor, which a locally cached or locally checkpointed one doesn't.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_made: list[tuple[SparkSession, str]] = []
_local: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local one where none is set and all executors are on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        given = context._jsc.sc().getCheckpointDir()
        if given.isDefined():
            root = given.get()
        elif context.master == "local" or context.master.startswith("local["):
            root = _local.get("root")
            if not root:
                root = _local["root"] = "file://" + tempfile.mkdtemp(prefix="strandline-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share: intermediate tables are written there")
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """One operator call's folder of intermediate tables; ``drop`` frees those that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_root(spark)}/strandline-{name}-{uuid.uuid4().hex}"
        self._n = 0
        _made.append((spark, self.folder))

    def table(self, df: DataFrame, **measures: Column) -> DataFrame:
        """Write ``df`` and return a scan of what was written (same columns and types).

        ``measures``: aggregates of the rows, taken as they are written and kept in ``measured`` of the result.
        """
        self._n += 1
        path = f"{self.folder}/{self._n}"
        seen = Observation()
        counted = df.observe(seen, *(c.alias(name) for name, c in measures.items())) if measures else df
        counted.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._strandline_path = path
        out.measured = seen.get if measures else {}
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_strandline_path", None)
        if path:
            _delete(self.spark, path)


@atexit.register
def _sweep() -> None:
    while _made:
        spark, path = _made.pop()
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the JVM may be gone already; the cluster's own cleaning of the folder remains
            return
