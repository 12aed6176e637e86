"""Order-free, exact comparison of a DataFrame with a DuckDB result."""

from __future__ import annotations


def _plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return None if v is None else str(v)


def assert_same(df, relation) -> None:
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    at = [relation.columns.index(c) for c in columns]
    ours = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=str)
    theirs = sorted((tuple(_plain(r[i]) for i in at) for r in relation.fetchall()), key=str)
    assert len(ours) == len(theirs)
    assert ours == theirs
