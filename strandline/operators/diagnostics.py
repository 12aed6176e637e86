"""Temporal diagnostics: reversal sensitivity, scramble gradients, factorials and the joint report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import metrics
from strandline.operators import sequences as S
from strandline.operators.arrays import rows_l2
from strandline.operators.comparators import comparator, dtw_exp, score_pairs
from strandline.operators.pairs import attach_features
from strandline.operators.perturb import scramble_hashed
from strandline.plans.rules import split_by_order


def multiscale_similarity(pairs: DataFrame, a: str, b: str, windows: Sequence[int], out: str = "score") -> DataFrame:
    """Mean over scales of exp(-warped distance) of unit-row derivatives.

    A scale counts where both sides are longer than its window; without any such scale the similarity is 0.
    """
    keep = [c for c in pairs.columns if c not in (a, b)]
    rows = None
    for w in windows:
        longer = (F.size(a) > w) & (F.size(b) > w)
        part = pairs.where(longer).select(*keep, S.derivative(F.col(a), 1, w, unit_rows=True).alias("da__"), S.derivative(F.col(b), 1, w, unit_rows=True).alias("db__"))
        rows = part if rows is None else rows.unionByName(part)
    scored = score_pairs(rows, "da__", "db__", {"s__": dtw_exp(1.0, False)})
    means = scored.groupBy(*keep).agg(F.avg("s__").alias(out))
    return pairs.select(*keep).join(means, keep, "left").fillna(0.0, [out])


def reversal_scores(sequences: DataFrame, id: str, x: str, methods: Sequence[str]) -> DataFrame:
    """(id, method, s): each method's similarity of a sequence with its own reversal."""
    both = sequences.select(id, F.col(x).alias("x__"), F.reverse(x).alias("y__"))
    wide = score_pairs(both, "x__", "y__", methods)
    return wide.select(id, F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).alias("s")) for m in methods))).alias("e")).select(id, "e.*")


def reversal_summary(sequences: DataFrame, id: str, x: str, methods: Sequence[str]) -> DataFrame:
    """(method, mean, std, n) with the population's standard deviation; no sequences: NaN, NaN, 0."""
    spark = sequences.sparkSession
    stats = reversal_scores(sequences, id, x, methods).groupBy("method").agg(F.avg("s").alias("mean"), F.stddev_pop("s").alias("std"), F.count("s").alias("n"))
    wanted = spark.createDataFrame([(m,) for m in methods], "method string")
    return wanted.join(stats, "method", "left").fillna(float("nan"), ["mean", "std"]).fillna(0, ["n"])


def reversal_ratio(sequences: DataFrame, id: str, x: str, method: str) -> DataFrame:
    """(id, ratio): similarity with the reversal over that with itself; 1 where the latter is at most 1e-8."""
    rows = sequences.select(id, F.col(x).alias("x__"), F.explode(F.array(F.lit("self"), F.lit("rev"))).alias("k__")).withColumn("y__", F.when(F.col("k__") == "rev", F.reverse("x__")).otherwise(F.col("x__")))
    scored = score_pairs(rows, "x__", "y__", {"s__": comparator(method).kernel}).groupBy(id).agg(F.max(F.when(F.col("k__") == "rev", F.col("s__"))).alias("r"), F.max(F.when(F.col("k__") == "self", F.col("s__"))).alias("t"))
    return scored.select(id, F.when(F.abs("t") <= 1e-8, F.lit(1.0)).otherwise(F.col("r") / F.col("t")).alias("ratio"))


# The lower ends of the buckets of violation counts.
VIOLATION_BUCKETS = ((0, "0"), (1, "1"), (2, "2-4"), (5, "5-9"), (10, "10-19"), (20, "20-49"), (50, "50-99"), (100, "100+"))


def violation_histogram(scored: DataFrame, count: str, by: str) -> DataFrame:
    """(by, bucket, n, share of the rows of ``by``)."""
    bucket = F.lit(VIOLATION_BUCKETS[0][1])
    for low, name in VIOLATION_BUCKETS[1:]:
        bucket = F.when(F.col(count) >= low, F.lit(name)).otherwise(bucket)
    counts = scored.groupBy(by, bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def scramble_scores(pairs: DataFrame, first: DataFrame, second: DataFrame, ks: Sequence[int], methods: Sequence[str], seed: int = 0) -> DataFrame:
    """(id_a, id_b, label, k, method, score): b-sides scrambled in k chunks; pairs with a missing side fall out.

    ``first`` and ``second`` are (seq_id, emb).  Methods whose score can't depend on order are computed once and
    repeated for all k.
    """
    joined = pairs.join(first.select(F.col("seq_id").alias("id_a"), F.col("emb").alias("a__")), "id_a").join(second.select(F.col("seq_id").alias("id_b"), F.col("emb").alias("b__")), "id_b")
    fixed, moving = split_by_order(methods)
    each = F.explode(F.array(*(F.lit(k) for k in sorted(set(ks)))))
    keys = ["id_a", "id_b", "label"]

    def melted(wide: DataFrame, names: Sequence[str], *more: str) -> DataFrame:
        return wide.select(*keys, *more, F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).alias("score")) for m in names))).alias("e")).select(*keys, *more, "e.*")

    parts = []
    if fixed:
        parts.append(melted(score_pairs(joined.select(*keys, "a__", "b__"), "a__", "b__", fixed), fixed).withColumn("k", each).select(*keys, "k", "method", "score"))
    if moving:
        rows = joined.withColumn("k", each).withColumn("b__", scramble_hashed(F.col("b__"), F.col("id_b"), F.col("k"), F.lit(seed)))
        parts.append(melted(score_pairs(rows.select(*keys, "k", "a__", "b__"), "a__", "b__", moving), moving, "k").select(*keys, "k", "method", "score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scramble_gradient(scores: DataFrame) -> DataFrame:
    """(method, k, ap) from scramble_scores."""
    return metrics.average_precision(scores, ["method", "k"], "score", "label")


def gradient_verdict(gradient: DataFrame, drop: float = 0.05) -> DataFrame:
    """(method, drop, verdict): sensitive if AP at K=1 exceeds that at the largest K by more than ``drop``.

    Inconclusive with fewer than two K, without K=1, or where either AP is missing.
    """
    wide = gradient.groupBy("method").agg(
        F.max(F.when(F.col("k") == 1, F.col("ap"))).alias("base"),
        F.max_by("ap", "k").alias("last"),
        F.count_distinct("k").alias("n_k"),
    )
    usable = (F.col("n_k") >= 2) & F.col("base").isNotNull() & F.col("last").isNotNull() & ~F.isnan("base") & ~F.isnan("last")
    lost = F.when(usable, F.col("base") - F.col("last"))
    verdict = F.when(lost.isNull(), "inconclusive").when(lost > drop, "order-sensitive").otherwise("order-invariant")
    return wide.select("method", lost.alias("drop"), verdict.alias("verdict"))


def factorial_ap(pairs: DataFrame, feature_sets: Mapping[str, DataFrame], methods: Sequence[str]) -> DataFrame:
    """(feature, method, ap, n_pairs) on the pairs shared by all feature sets (seq_id, emb)."""
    if not feature_sets:
        raise ValueError("no feature sets")
    shared = pairs
    for features in feature_sets.values():
        ids = features.select("seq_id").distinct()
        shared = shared.join(ids.withColumnRenamed("seq_id", "id_a"), "id_a", "left_semi").join(ids.withColumnRenamed("seq_id", "id_b"), "id_b", "left_semi")
    rows = None
    for name, features in feature_sets.items():
        joined = attach_features(shared, features, "seq_id", ["emb"])
        wide = score_pairs(joined.select("id_a", "id_b", "label", "emb_a", "emb_b"), "emb_a", "emb_b", methods)
        part = wide.select("id_a", "id_b", "label", F.lit(name).alias("feature"), F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).alias("score")) for m in methods))).alias("e")).select("id_a", "id_b", "label", "feature", "e.*")
        rows = part if rows is None else rows.unionByName(part)
    ap = metrics.average_precision(rows, ["feature", "method"], "score", "label")
    counts = rows.groupBy("feature", "method").agg(F.count("*").alias("n_pairs"))
    return ap.join(counts, ["feature", "method"])


def merged_sequences(first: DataFrame, second: DataFrame) -> DataFrame:
    """The union of two (seq_id, emb) tables; the second's sequence wins where both have an id."""
    return second.select("seq_id", "emb").unionByName(first.select("seq_id", "emb").join(second.select("seq_id"), "seq_id", "left_anti"))


def temporal_report(pairs: DataFrame, first: DataFrame, second: DataFrame, ks: Sequence[int], method: str, seed: int = 0) -> DataFrame:
    """(measure, k, value, n, note): the gradient, its verdict and reversal sensitivity over all sequences."""
    gradient = scramble_gradient(scramble_scores(pairs, first, second, ks, [method], seed))
    lines = gradient.select(F.lit("ap").alias("measure"), F.col("k").cast("int"), F.col("ap").alias("value"), F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("string").alias("note"))
    verdict = gradient_verdict(gradient).select(F.lit("drop").alias("measure"), F.lit(None).cast("int").alias("k"), F.col("drop").alias("value"), F.lit(None).cast("bigint").alias("n"), F.col("verdict").alias("note"))
    whole = reversal_summary(merged_sequences(first, second), "seq_id", "emb", [method])
    rev = whole.select(F.explode(F.array(F.struct(F.lit("s_rev_mean").alias("measure"), F.col("mean").alias("value")), F.struct(F.lit("s_rev_std").alias("measure"), F.col("std").alias("value")))).alias("e"), "n").select("e.measure", F.lit(None).cast("int").alias("k"), "e.value", "n", F.lit(None).cast("string").alias("note"))
    return lines.unionByName(verdict).unionByName(rev)


def unit_rows(sequences: DataFrame, x: str) -> DataFrame:
    return sequences.withColumn(x, rows_l2(F.col(x)))
