"""Pairs and galleries: joins that make the rows which comparators score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _two(items: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    return tuple(items.select(*(F.col(c).alias(f"{c}_{side}") for c in columns)) for side in "ab")  # type: ignore[return-value]


def within_group_pairs(items: DataFrame, group: str, id: str, label: str, extra: Sequence[str] = ()) -> DataFrame:
    """All pairs id_a < id_b of a group, with gt = 1 where the labels agree (0 where they differ or one is null).

    The result of a group is quadratic in its size by definition; it is an equi-join on the group, so AQE splits
    crowded groups.  Items with a null group or id are in no pair.
    """
    a, b = _two(items, [group, id, label, *extra])
    joined = a.join(b, (F.col(f"{group}_a") == F.col(f"{group}_b")) & (F.col(f"{id}_a") < F.col(f"{id}_b")))
    gt = F.coalesce((F.col(f"{label}_a") == F.col(f"{label}_b")).cast("int"), F.lit(0))
    return joined.withColumnRenamed(f"{group}_a", group).drop(f"{group}_b").withColumn("gt", gt)


def all_pairs(items: DataFrame, id: str, columns: Sequence[str] = ()) -> DataFrame:
    """The upper triangle of all items: a report on small sets only, as it is quadratic."""
    a, b = _two(items, [id, *columns])
    return a.join(b, F.col(f"{id}_a") < F.col(f"{id}_b"))


def directed_gallery(items: DataFrame, id: str, columns: Sequence[str] = (), queries: DataFrame | None = None) -> DataFrame:
    """Every query against every other item (query_* and cand_* columns)."""
    q = (queries if queries is not None else items).select(*(F.col(c).alias(f"query_{c}") for c in (id, *columns)))
    c = items.select(*(F.col(x).alias(f"cand_{x}") for x in (id, *columns)))
    return q.join(c, F.col(f"query_{id}") != F.col(f"cand_{id}"))


def with_relevance(gallery: DataFrame, group: str, label: str) -> DataFrame:
    """rel = 1 where a candidate has the query's group and label."""
    same = (F.col(f"query_{group}") == F.col(f"cand_{group}")) & (F.col(f"query_{label}") == F.col(f"cand_{label}"))
    return gallery.withColumn("rel", F.coalesce(same.cast("int"), F.lit(0)))


def eligible(relevance: DataFrame, query: str, rel: str = "rel") -> DataFrame:
    """Rows of the queries that have something relevant."""
    return relevance.join(relevance.where(F.col(rel) == 1).select(query).distinct(), query, "left_semi")


def attach_features(pairs: DataFrame, features: DataFrame, id: str, columns: Sequence[str], a: str = "id_a", b: str = "id_b") -> DataFrame:
    """Pairs with both sides' columns; pairs with a missing side fall out."""
    for side, name in ((a, "a"), (b, "b")):
        pairs = pairs.join(features.select(F.col(id).alias(side), *(F.col(c).alias(f"{c}_{name}") for c in columns)), side)
    return pairs


def keep_known(pairs: DataFrame, ids: DataFrame, id: str, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """Pairs both ends of which are known."""
    known = ids.select(id).dropna().distinct()
    for side in (a, b):
        pairs = pairs.join(known.withColumnRenamed(id, side), side, "left_semi")
    return pairs


def shared_pairs(pairs: DataFrame, feature_sets: Sequence[DataFrame], id: str, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """Pairs known to every feature set; no sets at all is an error."""
    if not feature_sets:
        raise ValueError("no feature sets")
    for ids in feature_sets:
        pairs = keep_known(pairs, ids, id, a, b)
    return pairs


def missing_ids(needed: DataFrame, available: DataFrame, id: str) -> DataFrame:
    return needed.select(id).distinct().join(available.select(id), id, "left_anti")


def threshold_candidates(scored: DataFrame, score: str, at_least: float, forced: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs whose score reaches ``at_least``, and the forced ones, each once."""
    return scored.where(F.col(score) >= at_least).select(*keys).unionByName(forced.select(*keys)).distinct()


def unordered(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def mixed_groups(items: DataFrame, group: str, label: str, needed: Sequence, top: int, first_seen: str) -> DataFrame:
    """Items of the ``top`` largest groups that hold every needed label; of equal size, the group seen first."""
    stats = items.groupBy(group).agg(F.count("*").alias("n__"), F.min(first_seen).alias("seen__"), *(F.bool_or(F.col(label) == x).alias(f"has{k}__") for k, x in enumerate(needed)))
    for k in range(len(needed)):
        stats = stats.where(F.col(f"has{k}__"))
    # one row per group: a single small window
    chosen = stats.withColumn("place__", F.row_number().over(Window.orderBy(F.desc("n__"), "seen__"))).where(F.col("place__") <= top)
    return items.join(chosen.select(group), group, "left_semi")
