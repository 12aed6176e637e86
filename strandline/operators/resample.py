"""Bootstrap intervals.

Clusters are resampled by multiplicities: how often a replicate draws a cluster.  Means weigh the clusters' totals;
pooled curves pass their sorted scores once through a kernel that carries all replicates side by side, so neither rows nor
scores are multiplied by the replicates.  Draws follow either one MT19937 stream (``generator``), as a loop of resamples
would, or md5 keys (``md5``), which any engine can repeat.  Pair-level replicates run one per task row over counts of
distinct scores, whose number is checked before they are shipped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.scratch import Scratch

MOST_CLUSTERS = 200_000
MOST_SCORES = 2_000_000
MOST_TIMES = 1 << 29  # clusters x replicates of a pooled curve, one byte each: what a task can hold
_ROWS = 1024  # rows that the curve kernel takes at a time, times the replicates


def drawn_times(n: int, replicates: Sequence[int], seed: int, draws: str) -> Iterator[np.ndarray]:
    """How often each of ``n`` clusters is drawn, by replicate (rising numbers).

    ``generator``: replicate r uses the r-th block of n draws of one stream.  ``md5``: draw i takes the (i mod 4)-th 32 bits of
    md5(seed|replicate|i div 4), modulo n.
    """
    if draws not in ("generator", "md5"):
        raise ValueError("draws must be generator or md5")
    rng, at = np.random.RandomState(seed % (1 << 32)), 0
    for r in replicates:
        if draws == "md5":
            raw = b"".join(hashlib.md5(f"{seed}|{r}|{k}".encode()).digest() for k in range(-(-n // 4)))
            places = np.frombuffer(raw, ">u4")[:n].astype(np.int64) % n
        else:
            while at < r:  # wind on, a replicate at a time
                rng.randint(0, n, size=n)
                at += 1
            places, at = rng.randint(0, n, size=n), at + 1
        yield np.bincount(places, minlength=n)


def _check_clusters(n: int) -> None:
    if n > MOST_CLUSTERS:
        raise ValueError(f"more than {MOST_CLUSTERS} clusters")


def multiplicities(spark: SparkSession, clusters: Sequence, replicates: int, seed: int, draws: str = "generator") -> DataFrame:
    """(replicate, place, times): how often each cluster is drawn (see ``drawn_times``)."""
    n = len(clusters)
    _check_clusters(n)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = [int(r) for b in batches for r in b["id"]]
        for r, times in zip(ids, drawn_times(n, ids, seed, draws)):
            drawn = np.flatnonzero(times)
            yield pd.DataFrame({"replicate": r, "place": drawn.astype(np.int32), "times": times[drawn].astype(np.int32)})

    return spark.range(replicates).mapInPandas(draw, "replicate long, place int, times int")


def _interval(rows: DataFrame, keys: Sequence[str], value: str, level: float) -> DataFrame:
    tail = (1 - level) / 2
    return rows.groupBy(*keys).agg(F.percentile(F.col(value), F.lit(tail)).alias("ci_low"), F.percentile(F.col(value), F.lit(1 - tail)).alias("ci_high"))


def cluster_mean(rows: DataFrame, cluster: str, value: str, replicates: int = 2000, seed: int = 42, level: float = 0.95, draws: str = "generator") -> DataFrame:
    """(point, ci_low, ci_high, n_clusters) of the mean of all rows, resampling clusters; null values don't count."""
    spark = rows.sparkSession
    use = rows.where(F.col(cluster).isNotNull() & F.col(value).isNotNull())
    sums = use.groupBy(cluster).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count(value).alias("n")).orderBy(cluster).limit(MOST_CLUSTERS + 1).toPandas()
    _check_clusters(len(sums))
    if sums.empty:
        return spark.createDataFrame([(float("nan"), float("nan"), float("nan"), 0)], "point double, ci_low double, ci_high double, n_clusters long")
    totals = (sums["s"].to_numpy(), sums["n"].to_numpy(np.float64))
    shared = spark.sparkContext.broadcast(totals)  # at most MOST_CLUSTERS rows

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, n = shared.value
        ids = [int(r) for b in batches for r in b["id"]]
        yield pd.DataFrame({"m": [float((times @ s) / (times @ n)) for times in drawn_times(len(s), ids, seed, draws)]})

    drawn = spark.range(replicates).mapInPandas(draw, "m double")
    point = float(totals[0].sum() / totals[1].sum())
    return _interval(drawn, [], "m", level).select(F.lit(point).alias("point"), "ci_low", "ci_high", F.lit(len(sums)).cast("long").alias("n_clusters"))


def paired_mean_difference(rows: DataFrame, cluster: str, a: str, b: str, replicates: int = 2000, seed: int = 42, level: float = 0.95, draws: str = "generator") -> DataFrame:
    """(difference, ci_low, ci_high, n_clusters): both sides share each replicate's clusters."""
    return cluster_mean(rows.withColumn("d__", F.col(a) - F.col(b)), cluster, "d__", replicates, seed, level, draws).withColumnRenamed("point", "difference")


def _ap(pos: np.ndarray, neg: np.ndarray) -> float:
    """Average precision from counts per distinct score, best first."""
    p = pos.sum()
    if p == 0 or neg.sum() == 0:
        return float("nan")
    tp = np.cumsum(pos)
    return float((pos * tp / np.maximum(tp + np.cumsum(neg), 1)).sum() / p)


def _auc(pos: np.ndarray, neg: np.ndarray) -> float:
    p, n = pos.sum(), neg.sum()
    if p == 0 or n == 0:
        return float("nan")
    worse = n - np.cumsum(neg)
    return float((pos * (worse + neg / 2)).sum() / (p * n))


METRICS = {"ap": _ap, "auc": _auc}


def pair_interval(pairs: DataFrame, score: str, label: str, metric: str = "ap", replicates: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """(point, ci_low, ci_high, n): pairs resampled with replacement; a replicate of one class takes the point.

    Replicate r draws with a generator of ``seed`` + r, so replicates are independent tasks.  Drawing n of n pairs is
    drawing a multinomial over the counts of (score, label), of which there may be ``MOST_SCORES``.
    """
    spark = pairs.sparkSession
    use = pairs.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull())
    counts = use.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) != 1).cast("long")).alias("neg"))
    found = counts.limit(MOST_SCORES + 1).toPandas().sort_values("s", ascending=False)
    if len(found) > MOST_SCORES:
        raise ValueError(f"more than {MOST_SCORES} distinct scores; resample clusters, or round the scores")
    pos, neg = found["pos"].to_numpy(np.int64), found["neg"].to_numpy(np.int64)
    n = int(pos.sum() + neg.sum())
    measure = METRICS[metric]
    point = measure(pos, neg)
    if n == 0:
        return spark.createDataFrame([(float("nan"), float("nan"), float("nan"), 0)], "point double, ci_low double, ci_high double, n long")
    shared = spark.sparkContext.broadcast((np.concatenate([pos, neg]) / n, len(pos)))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        share, half = shared.value
        for ids in batches:
            values = []
            for r in ids["id"]:
                times = np.random.RandomState((seed + int(r)) % (1 << 32)).multinomial(n, share)
                m = measure(times[:half], times[half:])
                values.append(point if np.isnan(m) else m)
            yield pd.DataFrame({"m": values})

    drawn = spark.range(replicates).mapInPandas(draw, "m double")
    return _interval(drawn, [], "m", level).select(F.lit(point).alias("point"), "ci_low", "ci_high", F.lit(n).cast("long").alias("n"))


class _Curves:
    """The precision curves of all replicates over scores that come in falling."""

    def __init__(self, times: np.ndarray):
        self.times = times  # (clusters, replicates)
        self.start()

    def start(self) -> None:
        n = self.times.shape[1]
        self.tp, self.seen, self.ap, self.before = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        self.score, self.pos, self.all = None, np.zeros(n), np.zeros(n)  # of the score that may go on

    def begin_with(self, place: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> None:
        """What lies above the first score."""
        for k in range(0, len(place), _ROWS):
            times = self.times[place[k : k + _ROWS]].astype(np.float64)
            self.tp += pos[k : k + _ROWS] @ times
            self.seen += (pos + neg)[k : k + _ROWS] @ times
        self.before = self.tp.copy()

    def _close(self, pos: np.ndarray, every: np.ndarray) -> None:
        """Whole scores, one a row."""
        if len(pos):
            tp, seen = self.tp + np.cumsum(pos, axis=0), self.seen + np.cumsum(every, axis=0)
            self.ap += np.divide(pos * tp, seen, out=np.zeros_like(tp), where=seen > 0).sum(axis=0)
            self.tp, self.seen = tp[-1], seen[-1]

    def add(self, score: np.ndarray, place: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> None:
        for k in range(0, len(score), _ROWS):
            s = score[k : k + _ROWS]
            times = self.times[place[k : k + _ROWS]].astype(np.float64)
            heads = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            p = np.add.reduceat(times * pos[k : k + _ROWS, None], heads, axis=0)
            e = np.add.reduceat(times * (pos + neg)[k : k + _ROWS, None], heads, axis=0)
            if self.score is not None and self.score == s[0]:
                p[0] += self.pos
                e[0] += self.all
            elif self.score is not None:
                self._close(self.pos[None], self.all[None])
            self._close(p[:-1], e[:-1])
            self.score, self.pos, self.all = s[-1], p[-1], e[-1]

    def end(self) -> tuple[np.ndarray, np.ndarray]:
        """(sums of precision at positives, positives) of what was added."""
        self._close(self.pos[None], self.all[None])
        return self.ap, self.tp - self.before


def cluster_ap(pairs: DataFrame, cluster: str, methods: Sequence[str], label: str, replicates: int = 2000, seed: int = 42, draws: str = "generator") -> DataFrame:
    """(replicate, method, ap): pooled average precision of resampled clusters, the same draws for every method.

    Replicate -1 is the point; without positives ap is NaN.  Rows with a null cluster or label, or a null or NaN score, take no
    part; label 1 is positive, anything else negative.  A method's distinct scores are cut into chunks at its quantiles; what
    each cluster holds above a chunk goes before the chunk's own rows, so chunks are independent, and a kernel passes each
    once with all replicates side by side.  Clusters x replicates may be ``MOST_TIMES``.
    """
    spark = pairs.sparkSession
    scratch = Scratch(spark, "resample")
    ids = [r[0] for r in pairs.select(cluster).dropna().distinct().orderBy(cluster).limit(MOST_CLUSTERS + 1).collect()]
    if not ids:
        return spark.createDataFrame([], "replicate long, method string, ap double")
    _check_clusters(len(ids))
    if len(ids) * (replicates + 1) > MOST_TIMES:
        raise ValueError(f"clusters x replicates beyond {MOST_TIMES}")
    places = spark.createDataFrame(list(enumerate(ids)), f"place int, {cluster} {pairs.schema[cluster].dataType.simpleString()}")
    long = pairs.where(F.col(label).isNotNull()).select(cluster, (F.col(label) == 1).cast("long").alias("y"), F.explode(F.array(*(F.struct(F.lit(m).alias("method"), (F.col(m).cast("double") + 0.0).alias("s")) for m in methods))).alias("e")).select(cluster, "y", "e.*")
    counts = long.where(F.col("s").isNotNull() & ~F.isnan("s")).groupBy(cluster, "method", "s").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    counts = scratch.table(counts.join(places, cluster).select("method", "s", "place", "pos", "neg"))
    chunks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = counts.groupBy("method").agg(F.percentile_approx("s", [k / chunks for k in range(1, chunks)] or [0.5], 10_000).alias("bounds"))  # a row a method
    held = counts.join(bounds, "method").withColumn("chunk", F.size(F.filter("bounds", lambda b: b > F.col("s")))).drop("bounds")
    totals = held.groupBy("method", "place", "chunk").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    every = totals.select("method", "place").distinct().withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(max(chunks - 1, 1)))))
    above = Window.partitionBy("method", "place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row a chunk
    before = every.join(totals, ["method", "place", "chunk"], "left").select("method", "chunk", F.lit(0).alias("kind"), F.lit(0.0).alias("s"), "place", F.sum(F.coalesce("pos", F.lit(0))).over(above).alias("pos"), F.sum(F.coalesce("neg", F.lit(0))).over(above).alias("neg"))
    rows = before.where("pos + neg > 0").unionByName(held.select("method", "chunk", F.lit(1).alias("kind"), "s", "place", "pos", "neg"))
    n = len(ids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        curves, now = None, None

        def closed() -> pd.DataFrame:
            ap, pos = curves.end()
            return pd.DataFrame({"replicate": np.arange(-1, replicates), "method": now[0], "ap": ap, "pos": pos})

        for batch in batches:
            for (method, chunk, kind), part in batch.groupby(["method", "chunk", "kind"], sort=False):
                if curves is None:
                    times = np.ones((n, replicates + 1), np.uint8)
                    for r, drawn in enumerate(drawn_times(n, range(replicates), seed, draws)):
                        times[:, r + 1] = np.minimum(drawn, 255)  # more has a chance below 10 ** -500
                    curves = _Curves(times)
                if now != (method, chunk):
                    if now is not None:
                        yield closed()
                    now = (method, chunk)
                    curves.start()
                place, pos, neg = part["place"].to_numpy(), part["pos"].to_numpy(np.float64), part["neg"].to_numpy(np.float64)
                if kind == 0:
                    curves.begin_with(place, pos, neg)
                else:
                    curves.add(part["s"].to_numpy(), place, pos, neg)
        if now is not None:
            yield closed()

    sorted_rows = rows.repartition(chunks * len(methods), "method", "chunk").sortWithinPartitions("method", "chunk", "kind", F.desc("s"))
    sums = sorted_rows.mapInPandas(run, "replicate long, method string, ap double, pos double").groupBy("replicate", "method").agg(F.sum("ap").alias("g"), F.sum("pos").alias("p"))
    return sums.select("replicate", "method", F.when(F.col("p") > 0, F.col("g") / F.col("p")).otherwise(F.lit(float("nan"))).alias("ap"))


def cluster_ap_interval(replicated: DataFrame, level: float = 0.95) -> DataFrame:
    """(method, point, ci_low, ci_high) from cluster_ap; degenerate replicates are left out."""
    drawn = replicated.where((F.col("replicate") >= 0) & ~F.isnan("ap"))
    point = replicated.where("replicate = -1").select("method", F.col("ap").alias("point"))
    return point.join(_interval(drawn, ["method"], "ap", level), "method", "left")


def paired_ap_difference(replicated: DataFrame, a: str, b: str, level: float = 0.95) -> DataFrame:
    """(difference, ci_low, ci_high, p_greater) of two methods over shared replicates."""
    side = lambda m, name: replicated.where(F.col("method") == m).select("replicate", F.col("ap").alias(name))
    both = side(a, "x").join(side(b, "y"), "replicate").withColumn("d", F.col("x") - F.col("y"))
    drawn = both.where((F.col("replicate") >= 0) & ~F.isnan("d"))
    point = both.where("replicate = -1").select(F.col("d").alias("difference"))
    greater = drawn.agg(F.avg((F.col("d") > 0).cast("double")).alias("p_greater"))
    return point.join(_interval(drawn, [], "d", level), F.lit(True)).join(greater, F.lit(True))


def width_ratio(wide: Column, narrow: Column) -> Column:
    return wide / F.greatest(narrow, F.lit(1e-9))
