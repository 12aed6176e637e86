"""Held-out classifiers over score or feature columns, by Spark ML."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.metrics import average_precision, roc_auc
from strandline.operators.positions import numbered


def hashed_folds(rows: DataFrame, by: Sequence[str], k: int, seed: int, out: str = "fold", stratify: str | None = None) -> DataFrame:
    """Fold 0..k-1 of each row from the hash of ``by`` (rows alike in it share a fold).

    With ``stratify`` the rows of each class are dealt out evenly in the order of their hashes.
    """
    h = F.xxhash64(F.lit(seed), *by)
    if stratify is None:
        return rows.withColumn(out, F.pmod(h, F.lit(k)).cast("int"))
    placed = numbered(rows.withColumn("hash__", h), [stratify], F.shiftright("hash__", 54), [F.col("hash__"), *map(F.col, by)], "place__")
    return placed.withColumn(out, ((F.col("place__") - 1) % k).cast("int")).drop("place__", "hash__")


def _logistic(c: float, n: int) -> LogisticRegression:
    return LogisticRegression(featuresCol="x__", labelCol="y__", regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-8)


def _without_summary(model: PipelineModel) -> PipelineModel:
    """``model`` for use in tasks: the training summary of two classes holds the session, which can't be sent to them once it has observed a query."""
    fitted = model.stages[-1]._java_obj
    fitted.setSummary(SparkContext._active_spark_context._jvm.scala.Option.empty())
    return model


def out_of_fold(rows: DataFrame, features: Sequence[str], label: str, fold: str, k: int, c: float = 1.0, scale: bool = False) -> DataFrame:
    """``rows`` with the probability that a model fitted on the other folds gives them; rows with a null feature fall out."""
    data = VectorAssembler(inputCols=list(features), outputCol="raw__", handleInvalid="skip").transform(rows.withColumn("y__", F.col(label).cast("double")))
    out = None
    for f in range(k):
        train, test = data.where(F.col(fold) != f), data.where(F.col(fold) == f)
        n = train.count()
        if n == 0 or train.select("y__").distinct().count() < 2:
            continue
        steps = [StandardScaler(inputCol="raw__", outputCol="x__", withMean=True)] if scale else []
        lr = _logistic(c, n) if scale else _logistic(c, n).setFeaturesCol("raw__")
        scored = _without_summary(Pipeline(stages=[*steps, lr]).fit(train)).transform(test).withColumn("p", vector_to_array("probability")[1]).select(*rows.columns, "p")
        out = scored if out is None else out.unionByName(scored)
    return out if out is not None else rows.limit(0).withColumn("p", F.lit(None).cast("double"))


def cross_validated(rows: DataFrame, features: Sequence[str], label: str, ties: Sequence[str], k: int = 5, seed: int = 42, c: float = 1.0) -> DataFrame:
    """(ap, auc, n) out of fold, classes dealt evenly over k folds; NaN with fewer than k rows of a class."""
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if len(sizes) < 2 or min(sizes.values()) < k:
        return rows.sparkSession.createDataFrame([(float("nan"), float("nan"), sum(sizes.values()))], "ap double, auc double, n long")
    scored = out_of_fold(hashed_folds(rows, ties, k, seed, stratify=label), features, label, "fold", k, c)
    return average_precision(scored, [], "p", label).join(roc_auc(scored, [], "p", label), F.lit(True)).join(scored.agg(F.count("*").alias("n")), F.lit(True))


def leave_one_out(rows: DataFrame, group: str, features: Sequence[str], label: str, c: float = 1.0) -> DataFrame:
    """(group, ap, auc): each group scored by a model of all others."""
    groups = [r[0] for r in rows.select(group).distinct().orderBy(group).limit(1001).collect()]
    if len(groups) > 1000:
        raise ValueError("more than 1,000 groups to leave out")
    numbered = rows.join(F.broadcast(rows.sparkSession.createDataFrame(list(enumerate(groups)), f"fold int, {group} {rows.schema[group].dataType.simpleString()}")), group)
    scored = out_of_fold(numbered, features, label, "fold", len(groups), c)
    return average_precision(scored, [group], "p", label).join(roc_auc(scored, [group], "p", label), group)


def group_probe(rows: DataFrame, group: str, features: Sequence[str], label: str, cs: Sequence[float] = (0.01, 0.1, 1.0, 10.0), k: int = 5, seed: int = 42) -> DataFrame:
    """(c, accuracy) of the best C by mean accuracy over folds of whole groups (the first of equals); scaling is fitted on training folds."""
    best: tuple[float, float] | None = None
    folded = hashed_folds(rows, [group], k, seed)
    for c in cs:
        scored = out_of_fold(folded, features, label, "fold", k, c, scale=True)
        hit = (F.col("p") > 0.5).cast("int") == F.col(label)  # even odds are class 0
        by_fold = [r["a"] for r in scored.groupBy("fold").agg(F.avg(hit.cast("double")).alias("a")).collect() if r["a"] is not None]  # k rows at most
        if not by_fold:
            continue
        accuracy = math.fsum(by_fold) / len(by_fold)  # the same in any order of folds, or equals aren't equal
        if best is None or accuracy > best[1]:
            best = (c, accuracy)
    return rows.sparkSession.createDataFrame([best or (float("nan"), float("nan"))], "c double, accuracy double")


def mlp_probe(rows: DataFrame, group: str, features: Sequence[str], label: str, hidden: Sequence[int] = (256, 256), k: int = 5, seed: int = 42, max_iter: int = 100) -> DataFrame:
    """(accuracy) over folds of whole groups of a network with ``hidden`` layers (sigmoid units, as Spark ML has them)."""
    data = VectorAssembler(inputCols=list(features), outputCol="raw__", handleInvalid="skip").transform(hashed_folds(rows, [group], k, seed).withColumn("y__", F.col(label).cast("double")))
    hits = None
    for f in range(k):
        train, test = data.where(F.col("fold") != f), data.where(F.col("fold") == f)
        if train.select("y__").distinct().count() < 2:
            continue
        net = MultilayerPerceptronClassifier(featuresCol="x__", labelCol="y__", layers=[len(features), *hidden, 2], seed=seed, maxIter=max_iter)
        model = Pipeline(stages=[StandardScaler(inputCol="raw__", outputCol="x__", withMean=True), net]).fit(train)
        part = model.transform(test).select("fold", (F.col("prediction") == F.col("y__")).cast("double").alias("hit"))
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        return rows.sparkSession.createDataFrame([(float("nan"),)], "accuracy double")
    return hits.groupBy("fold").agg(F.avg("hit").alias("a")).agg(F.avg("a").alias("accuracy"))
