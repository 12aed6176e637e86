"""Rewrites made while a plan is built.

``split_by_order``   methods that ignore order are scored once, not once per scramble (used by ``scramble_scores``).
``rank_key``         a growing function of a score can't change a ranking: rank by the score itself.
``mirrored``         a symmetric score is computed for one half of all pairs and mirrored.
``candidates_first`` a costly score is computed only for the pairs that a cheap one leaves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.comparators import comparator, score_pairs

#: comparators that are growing functions of minus a distance
DISTANCE_OF = {"dtw": "dtw_distance", "dtw_normalized": "dtw_distance_normalized", "dtw_alpha5": "dtw_distance_normalized", "dtw_reciprocal": "dtw_distance_normalized"}


def split_by_order(methods: Sequence[str]) -> tuple[list[str], list[str]]:
    """(methods that ignore order, the others), each in the given order."""
    fixed = [m for m in methods if comparator(m).order_invariant]
    return fixed, [m for m in methods if m not in fixed]


def rank_key(method: str) -> tuple[str, bool]:
    """(comparator to compute, whether larger is better) for rankings by ``method``."""
    return (DISTANCE_OF[method], False) if method in DISTANCE_OF else (method, True)


def mirrored(half: DataFrame, a: str, b: str, method: str) -> DataFrame:
    """Both directions of the pairs a < b scored by a symmetric comparator; another is refused."""
    if not comparator(method).symmetric:
        raise ValueError(f"{method} is not symmetric")
    turned = half.select(*(F.col(b if c == a else a if c == b else c).alias(c) for c in half.columns))
    return half.unionAll(turned)


def candidates_first(pairs: DataFrame, query: str, cand: str, cheap: Column, top: int, a: str, b: str, method: str) -> DataFrame:
    """The ``top`` candidates of each query by the cheap score, with the costly one computed for them alone.

    The rank filter stands on the window, so Catalyst limits each group before and after the shuffle.
    """
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.col("cheap").desc(), cand))
    kept = pairs.withColumn("cheap", cheap).withColumn("place", place).where(F.col("place") <= top)
    return score_pairs(kept, a, b, [method])
