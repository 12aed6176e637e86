from __future__ import annotations

import numpy as np
import pytest

from strandline.operators import gallery as G


def _items(spark, x):
    return spark.createDataFrame([(int(i), None if v is None else [float(t) for t in v]) for i, v in enumerate(x)], "item long, v array<double>")


def _order(x, q):
    """All other items of a query by falling product at six digits, then id."""
    s = [(-round(float(x[q] @ x[c]), 6), c) for c in range(len(x)) if c != q]
    return sorted(s)


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 16)
    monkeypatch.setattr(G, "HELD", 400)
    monkeypatch.setattr(G, "PIECE", 5)


@pytest.mark.parametrize("seed", [0, 1])
def test_cells_equal_loops(spark, small, seed):
    """Many strips and pieces, many equal scores."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-2, 3, size=(90, 4)).astype(float) if seed else rng.normal(size=(90, 4))
    df = _items(spark, x)
    scores = {(r[0], r[1]): (r[2], r[3]) for r in G.gallery_scores(df, df, "item", "v", 2).collect()}
    assert len(scores) == 90 * 89
    for (q, c), (sim, dist) in list(scores.items())[::97]:
        assert sim == pytest.approx(float(x[q] @ x[c])) and dist == pytest.approx(float(np.linalg.norm(x[q, :2] - x[c, :2])), abs=1e-6)
    best = {}
    for r in G.gallery_best(df, df, "item", "v", 7).collect():
        best.setdefault(r["query_id"], []).append((r["rank"], r["cand_id"]))
    assert {q: [c for _, c in sorted(b)] for q, b in best.items()} == {q: [c for _, c in _order(x, q)[:7]] for q in range(90)}
    wanted = [(q, c) for q in range(90) for c in range(90) if q != c and (q * c) % 7 == 0]
    rel = spark.createDataFrame([(q, c, float(x[q] @ x[c])) for q, c in wanted], "query_id long, cand_id long, sim double")
    ranks = {(r["query_id"], r["cand_id"]): r["rank"] for r in G.gallery_ranks(df, df, rel, "item", "v").collect()}
    assert ranks == {(q, c): [k for _, k in _order(x, q)].index(c) + 1 for q, c in wanted}
    total = G.gallery_totals(df, df, "item", "v").first()
    assert total["n"] == 90 * 89 and total["total"] == pytest.approx(sum(s for s, _ in scores.values()), abs=1e-6)


def test_missing_vectors_few_items_and_refusals(spark):
    df = _items(spark, [[1.0, 0.0], None, [0.0, 1.0]])
    rel = spark.createDataFrame([(0, 2, 0.0), (0, 1, 0.0), (1, 0, 0.0)], "query_id long, cand_id long, sim double")
    assert [tuple(r) for r in G.gallery_ranks(df, df, rel, "item", "v").collect()] == [(0, 2, 0.0, 1)]
    assert sorted((r["query_id"], r["cand_id"], r["rank"]) for r in G.gallery_best(df, df, "item", "v", 5).collect()) == [(0, 2, 1), (2, 0, 1)]
    none = df.limit(0)
    assert G.gallery_best(none, none, "item", "v", 5).count() == 0 and G.gallery_scores(none, none, "item", "v").count() == 0
    with pytest.raises(ValueError):
        G.gallery_best(df, df, "item", "v", 0)
    with pytest.raises(Exception, match="non-finite"):
        bad = _items(spark, [[float("nan")], [1.0]])
        G.gallery_best(bad, bad, "item", "v", 1).collect()


def test_no_join_without_a_key(spark, data):
    from strandline.catalog.rankings import QUERIES

    for name in ("join_directed_gallery", "rank_metrics", "cascade_rerank", "outcome_composition"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
        assert "Cross" not in plan and "Join Inner\n" not in plan
