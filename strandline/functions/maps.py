"""Maps from method names to scores."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def score_map(scores: Mapping[str, Column]) -> Column:
    """The scores by name; a score that is null has no entry."""
    whole = F.map_from_arrays(F.array(*(F.lit(n) for n in scores)), F.array(*scores.values()))
    return F.map_filter(whole, lambda _, v: v.isNotNull())


def merged(first: Column, second: Column) -> Column:
    """Both maps in one; where both have a name the second's entry stands."""
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k)), second)
