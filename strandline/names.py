"""Column names that cannot clash with the caller's."""

from __future__ import annotations

from collections.abc import Iterable


def free_name(wanted: str, taken: Iterable[str]) -> str:
    """``wanted``, or the first of ``wanted_1``, ``wanted_2`` ... that no column has (names compare caselessly)."""
    used = {t.lower() for t in taken}
    name, k = wanted, 0
    while name.lower() in used:
        k += 1
        name = f"{wanted}_{k}"
    return name
