"""Comparators of two sequences, their registry, and the Arrow operator that scores pairs.

A comparator is a function of two stacked batches (N, Ta, D) and (N, Tb, D) that gives N scores.  The pair operator
groups the rows of an Arrow batch by shape, so sequences may differ in length, and computes any number of
comparators in one pass over the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strandline.names import free_name
from strandline.operators.dtw import dtw_distance, frame_distances

Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Comparator:
    kernel: Kernel
    order_invariant: bool = False  # the order of either side's steps makes no difference
    symmetric: bool = True
    pads_empty: bool = True  # a side without steps scores 0


def unit(x: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=-1, keepdims=True)), eps)


def _rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(axis=-1)


def cosine_pooled(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _rows(unit(a.mean(axis=1)), unit(b.mean(axis=1)))


def dot_pooled(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _rows(a.mean(axis=1), b.mean(axis=1))


def cosine_guarded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of the means; 0 where either is shorter than 1e-8."""
    p, q = a.mean(axis=1), b.mean(axis=1)
    lp, lq = np.sqrt(_rows(p, p)), np.sqrt(_rows(q, q))
    small = (lp < 1e-8) | (lq < 1e-8)
    return np.where(small, 0.0, _rows(p, q) / np.where(small, 1.0, lp * lq))


def _common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = min(a.shape[1], b.shape[1])
    return a[:, :t], b[:, :t]


def flat_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = _common(a, b)
    return _rows(unit(a.reshape(len(a), -1)), unit(b.reshape(len(b), -1)))


def ordered_frame(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mean cosine of the steps at like places, over the shorter length."""
    a, b = _common(a, b)
    return _rows(unit(a), unit(b)).mean(axis=1)


def _similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a @ b.transpose(0, 2, 1)


def chamfer(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return chamfer_raw(unit(a), unit(b))


def chamfer_raw(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    s = _similar(a, b)
    return (s.max(axis=2).mean(axis=1) + s.max(axis=1).mean(axis=1)) / 2


def chamfer_euclid(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = frame_distances(a, b)
    return np.exp(-(d.min(axis=2).mean(axis=1) + d.min(axis=1).mean(axis=1)) / 2)


def maxsim(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _similar(a, b).max(axis=2).mean(axis=1)


def _descents(s: np.ndarray) -> np.ndarray:
    """How often the best partner lies before that of the step before (the first of equals is the best)."""
    best = s.argmax(axis=2)
    return (best[:, 1:] < best[:, :-1]).sum(axis=1)


def violations(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    s = _similar(a, b)
    return (_descents(s) + _descents(s.transpose(0, 2, 1))) / 2


def violation_fraction(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _descents(_similar(a, b)) / a.shape[1]


def ordered_maxsim_soft(penalty: float) -> Kernel:
    """Max-similarity less ``penalty`` per descent and step, the mean of both directions."""

    def one(s: np.ndarray) -> np.ndarray:
        return s.max(axis=2).mean(axis=1) - penalty * _descents(s) / s.shape[1]

    def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        s = _similar(a, b)
        return (one(s) + one(s.transpose(0, 2, 1))) / 2

    return kernel


def ordered_maxsim_hard(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Left to right, each step takes its best partner not before the last one taken; the mean of both directions."""

    def one(s: np.ndarray) -> np.ndarray:
        n, ta, tb = s.shape
        floor, score = np.zeros(n, dtype=np.int64), np.zeros(n)
        places = np.arange(tb)
        for i in range(ta):
            allowed = np.where(places[None, :] >= floor[:, None], s[:, i], -np.inf)
            floor = allowed.argmax(axis=1)
            score += allowed[np.arange(n), floor]
        return score / ta

    s = _similar(a, b)
    return (one(s) + one(s.transpose(0, 2, 1))) / 2


def dtw(normalize: bool) -> Kernel:
    return lambda a, b: dtw_distance(a, b, normalize)


def dtw_exp(alpha: float, normalize: bool) -> Kernel:
    return lambda a, b: np.exp(-alpha * dtw_distance(a, b, normalize))


def dtw_reciprocal(normalize: bool) -> Kernel:
    return lambda a, b: 1.0 / (1.0 + dtw_distance(a, b, normalize))


def negative_motion_gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Less the gap of the mean absolute steps of both sides."""
    move = lambda x: np.abs(np.diff(x, axis=1)).mean(axis=(1, 2)) if x.shape[1] > 1 else np.zeros(len(x))
    return -np.abs(move(a) - move(b))


_REGISTRY: dict[str, Comparator] = {}


def register_comparator(name: str, kernel: Kernel, *, order_invariant: bool = False, symmetric: bool = True, pads_empty: bool = True) -> None:
    """Make ``kernel`` known by ``name``; a known name is replaced."""
    _REGISTRY[name] = Comparator(kernel, order_invariant, symmetric, pads_empty)


def comparator(name: str) -> Comparator:
    if name not in _REGISTRY:
        raise ValueError(f"unknown comparator {name!r}; known: {', '.join(sorted(_REGISTRY))}")
    return _REGISTRY[name]


def comparator_names() -> list[str]:
    return sorted(_REGISTRY)


for _name, _kernel, _invariant in (
    ("cosine", cosine_pooled, True),
    ("dot", dot_pooled, True),
    ("cosine_guarded", cosine_guarded, True),
    ("chamfer", chamfer, True),
    ("chamfer_raw", chamfer_raw, True),
    ("chamfer_euclid", chamfer_euclid, True),
    ("flat_cosine", flat_cosine, False),
    ("ordered_frame", ordered_frame, False),
    ("oms_hard", ordered_maxsim_hard, False),
    ("violations", violations, False),
    ("motion_gap", negative_motion_gap, False),
    ("dtw", dtw_exp(1.0, False), False),
    ("dtw_normalized", dtw_exp(1.0, True), False),
    ("dtw_alpha5", dtw_exp(5.0, True), False),
    ("dtw_reciprocal", dtw_reciprocal(True), False),
):
    register_comparator(_name, _kernel, order_invariant=_invariant)
for _penalty in (0.0, 0.05, 0.1, 0.2, 0.5):
    register_comparator(f"oms_soft_{round(_penalty * 100):02d}", ordered_maxsim_soft(_penalty))
register_comparator("maxsim", maxsim, order_invariant=True, symmetric=False)
register_comparator("violation_fraction", violation_fraction, symmetric=False)
register_comparator("dtw_distance", dtw(False), pads_empty=False)
register_comparator("dtw_distance_normalized", dtw(True), pads_empty=False)


class _Stacked:
    """The packed sequences of an Arrow column, as flat values with offsets."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        self.valid = np.asarray(column.is_valid())
        self.steps = np.where(self.valid, np.asarray(column.value_lengths().fill_null(0)), 0).astype(np.int64)
        rows = column.flatten()  # vectors of all valid sequences
        self.first = np.concatenate([[0], np.cumsum(self.steps)])
        widths = np.asarray(rows.value_lengths().fill_null(0)) if len(rows) else np.zeros(0, np.int64)
        self.width = int(widths[0]) if len(widths) else 0
        if len(widths) and (widths != self.width).any():
            raise ValueError("the vectors of a column differ in width")
        self.values = np.asarray(rows.flatten().cast(pa.float64()).fill_null(float("nan"))).reshape(-1, self.width) if self.width else np.zeros((len(rows), 0))

    def take(self, index: np.ndarray) -> np.ndarray:
        t = int(self.steps[index[0]])
        return self.values[self.first[index][:, None] + np.arange(t)[None, :]]


def score_pairs(pairs: DataFrame, a: str, b: str, comparators: Mapping[str, Kernel] | Sequence[str], block: int = 2048) -> DataFrame:
    """``pairs`` without its sequences ``a`` and ``b``, with one score column (double) per comparator.

    A null sequence scores null; one without steps scores 0 (a distance: null).  Null vector elements count as
    NaN.  Clashing names get a number.  Rows of like shape are stacked, at most ``block`` at a time.
    """
    if not isinstance(comparators, Mapping):
        comparators = {name: comparator(name).kernel for name in comparators}
    kept = [f for f in pairs.schema.fields if f.name not in (a, b)]
    names = [free_name(n, [f.name for f in kept]) for n in comparators]
    empty = [0.0 if n not in _REGISTRY or _REGISTRY[n].pads_empty else None for n in comparators]
    kernels = list(comparators.values())
    schema = T.StructType(kept + [T.StructField(n, T.DoubleType()) for n in names])
    at_a, at_b = pairs.columns.index(a), pairs.columns.index(b)
    kept_at = [k for k, f in enumerate(pairs.schema.fields) if f.name not in (a, b)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            left, right = _Stacked(batch.column(at_a)), _Stacked(batch.column(at_b))
            out = [np.full(n, np.nan) for _ in kernels]
            null = [~(left.valid & right.valid) for _ in kernels]
            bare = ~null[0] & ((left.steps == 0) | (right.steps == 0)) if kernels else np.zeros(n, bool)
            for k, value in enumerate(empty):
                if value is None:
                    null[k] = null[k] | bare
                else:
                    out[k][bare] = value
            rest = np.flatnonzero((left.valid & right.valid) & (left.steps > 0) & (right.steps > 0))
            shapes = left.steps[rest] * (1 << 32) + right.steps[rest]
            order = rest[np.argsort(shapes, kind="stable")]
            sorted_shapes = np.sort(shapes)
            for group in np.split(order, np.flatnonzero(np.diff(sorted_shapes)) + 1) if len(order) else []:
                for start in range(0, len(group), block):
                    part = group[start : start + block]
                    x, y = left.take(part), right.take(part)
                    for k, kernel in enumerate(kernels):
                        out[k][part] = kernel(x, y)
            scored = [pa.array(o, pa.float64(), mask=m) for o, m in zip(out, null)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept_at), *scored], names=[f.name for f in schema.fields])

    return pairs.mapInArrow(run, schema)
