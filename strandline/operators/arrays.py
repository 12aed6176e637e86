"""Column expressions on vectors (array<double>) and packed sequences (array<array<double>>, one row per time step)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once (an expression inside a lambda is otherwise computed per element)."""
    return F.transform(F.array(value), use)[0]


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def l2(v: Column, eps: float = EPS) -> Column:
    """The vector over its length, or over ``eps`` where that is larger: a zero vector stays zero."""
    return let(F.greatest(norm(v), F.lit(eps)), lambda n: F.transform(v, lambda x: x / n))


def rows_l2(m: Column) -> Column:
    return F.transform(m, lambda v: l2(v))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def fold_rows(m: Column, by: Callable[[Column, Column], Column]) -> Column:
    """The rows of a packed sequence folded element by element; null if it is empty."""
    return F.when(F.size(m) > 0, F.aggregate(F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(0))), m[0], lambda s, v: F.zip_with(s, v, by)))


def mean_rows(m: Column) -> Column:
    return let(F.size(m).cast("double"), lambda t: F.transform(fold_rows(m, lambda x, y: x + y), lambda s: s / t))


def column_values(m: Column, d: Column) -> Column:
    """The values of one dimension over time."""
    return F.transform(m, lambda v: F.element_at(v, d + 1))


def sample_std(values: Column) -> Column:
    """Standard deviation with n - 1; null below two values."""
    return let(
        total(values) / F.size(values),
        lambda mean: F.when(F.size(values) > 1, F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / (F.size(values) - 1))),
    )


def each_dimension(m: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` applied to the values over time of every dimension: one result per dimension."""
    return F.transform(F.sequence(F.lit(0), F.size(m[0]) - 1), lambda d: use(column_values(m, d)))


def range0(n: Column) -> Column:
    """0 .. n-1; empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def pick(m: Column, index: Column) -> Column:
    """Elements of ``m`` at the 0-based places of the array ``index``."""
    return F.transform(index, lambda i: F.element_at(m, (i + 1).cast("int")))
