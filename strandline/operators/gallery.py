"""Scores of every query against every item, by cells.

Queries are cut into strips that a task can hold, the items into strips that a task streams past them; a cell is one
strip of either, so each item is sent once per strip of the other side (an equi-join on strips: nothing is broadcast,
nothing is joined without a key).  Kernels for the best items and for ranks keep counts and k items a query in the cell,
so no row per pair is made where only these are asked for.

Scores are compared at ``DIGITS`` digits: products of blocks differ in their last bits with how blocks are cut, and
equal scores must be equal everywhere.  Of equal scores the smaller id comes first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.scratch import Scratch

BLOCK = 512  # vectors in a packed row
HELD = 8_000_000  # numbers of a strip of queries (vectors, and scores to be ranked) that a task holds
PIECE = 4096  # relevant items of a query that go together; a query with more stands in several pieces
DIGITS = 6
_UNIT = 10**DIGITS
_FAR = 1 << 50  # beyond any score in units: products go up to 10 ** 9


def _packed(rows: DataFrame, strips: int, columns: dict, key: str) -> DataFrame:
    """(strip, rows): rows of a strip packed by about BLOCK."""
    count = rows.count()
    strip = F.pmod(F.xxhash64(key, F.lit(7)), F.lit(strips)).cast("int")
    block = F.pmod(F.xxhash64(key), F.lit(max(1, -(-count // (BLOCK * strips)))))
    return rows.groupBy(strip.alias("strip"), block.alias("block")).agg(F.collect_list(F.struct(*(c.alias(n) for n, c in columns.items()))).alias("rows")).drop("block")


def _cells(queries: DataFrame, items: DataFrame, id: str, v: str, query_numbers: int, extra: dict | None = None) -> tuple[DataFrame, int]:
    """Packed rows of both sides by cell, the queries of a cell first.  ``query_numbers``: numbers of all queries to be held."""
    spark = items.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    q_strips = max(1, -(-query_numbers // HELD))
    c_strips = max(1, -(-4 * parts // q_strips))
    vector = {"id": F.col(id).cast("long"), "v": F.col(v).cast("array<double>")}
    extra = extra or {}
    nothing = {n: F.lit(None).cast(t) for n, (_, t) in extra.items()}
    q = _packed(queries.where(F.col(v).isNotNull()), q_strips, {**vector, **{n: c for n, (c, _) in extra.items()}}, id)
    c = _packed(items.where(F.col(v).isNotNull()), c_strips, {**vector, **nothing}, id)
    q = q.select(F.lit(0).alias("side"), F.explode(F.sequence(F.lit(0), F.lit(c_strips - 1))).alias("other"), "strip", "rows").select((F.col("strip") * c_strips + F.col("other")).alias("cell"), "side", "rows")
    c = c.select(F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.lit(q_strips - 1))).alias("other"), "strip", "rows").select((F.col("other") * c_strips + F.col("strip")).alias("cell"), "side", "rows")
    return q.unionByName(c).repartition(q_strips * c_strips, "cell").sortWithinPartitions("cell", "side"), c_strips


def _side(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of packed rows."""
    ids = np.asarray(rows.field("id"))
    return ids, np.asarray(rows.field("v").flatten()).reshape(len(ids), -1) if len(ids) else np.zeros((0, 0))


def _over_cells(start: Callable, step: Callable, end: Callable):
    """A kernel over sorted cells: ``start`` makes a state of a cell's queries, ``step`` meets one packed row of items, ``end`` closes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, state = None, [], None
        for batch in batches:
            for k in range(batch.num_rows):
                now = batch.column("cell")[k].as_py()
                if now != cell:
                    if state is not None:
                        yield from end(state)
                    cell, held, state = now, [], None
                rows = batch.column("rows").slice(k, 1).flatten()
                if batch.column("side")[k].as_py() == 0:
                    held.append(rows)
                elif held or state is not None:
                    if state is None:
                        state = start(pa.concat_arrays(held) if len(held) > 1 else held[0])
                        held = []
                    yield from step(state, rows)
        if state is not None:
            yield from end(state)

    return run


def _chunks(n: int, size: int = 2048) -> Iterator[slice]:
    return (slice(k, min(k + size, n)) for k in range(0, n, size))


def _numbers(queries: DataFrame, v: str) -> int:
    return queries.agg(F.coalesce(F.sum(F.size(v)), F.lit(0))).first()[0]


def _units(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Products in whole units of DIGITS digits; a non-finite or too large one fails."""
    product = (q @ c.T) * _UNIT
    if not (np.abs(product) < _FAR).all():
        raise ValueError("non-finite gallery score")
    return np.rint(product).astype(np.int64)


def _distances(q: np.ndarray, c: np.ndarray, dims: int | None) -> np.ndarray:
    q, c = q[:, :dims], c[:, :dims]
    gap = (q * q).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (q @ c.T)
    return np.sqrt(np.maximum(gap, 0.0))


def gallery_scores(queries: DataFrame, items: DataFrame, id: str, v: str, dist_dims: int | None = None) -> DataFrame:
    """(query_id, cand_id, sim, dist) for all query_id <> cand_id: product of the vectors, and Euclidean distance of
    their first ``dist_dims`` dimensions (all if None).  Items without a vector have no rows; ids are integers."""

    def step(state, rows):
        qi, q = state
        ci, c = _side(rows)
        for part in _chunks(len(qi)):
            other = (qi[part, None] != ci[None, :]).ravel()
            n = part.stop - part.start
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(qi[part], len(ci))[other]), pa.array(np.tile(ci, n)[other]), pa.array((q[part] @ c.T).ravel()[other]), pa.array(_distances(q[part], c, dist_dims).ravel()[other])],
                names=["query_id", "cand_id", "sim", "dist"],
            )

    cells, _ = _cells(queries, items, id, v, _numbers(queries, v))
    return cells.mapInArrow(_over_cells(_side, step, lambda state: ()), "query_id long, cand_id long, sim double, dist double")


def gallery_totals(queries: DataFrame, items: DataFrame, id: str, v: str) -> DataFrame:
    """(n, total) in one row: number and sum of the products of the vectors over all query_id <> cand_id, added up
    within each cell, so no row per pair is made.  ``n`` is 0 and ``total`` null where there is none."""

    def step(state, rows):
        (qi, q), (ci, c) = state, _side(rows)
        n, total = 0, 0.0
        for part in _chunks(len(qi)):
            other = qi[part, None] != ci[None, :]
            n += int(other.sum())
            total += float((q[part] @ c.T)[other].sum())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.float64())], names=["n", "total"])

    cells, _ = _cells(queries, items, id, v, _numbers(queries, v))
    sums = cells.mapInArrow(_over_cells(_side, step, lambda state: ()), "n long, total double")
    return sums.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("total").alias("total"))


def gallery_best(queries: DataFrame, items: DataFrame, id: str, v: str, k: int, dist_dims: int | None = None) -> DataFrame:
    """(query_id, cand_id, sim, dist, rank) of each query's ``k`` best items other than itself, by product at DIGITS digits,
    then id.  A cell keeps k items a query; cells are merged by one small ranking per query."""
    from pyspark.sql import Window

    if k < 1:
        raise ValueError("k must be at least 1")

    def start(rows):
        qi, q = _side(rows)
        return {"qi": qi, "q": q, "least": np.full(len(qi), -_FAR, np.int64), "row": np.zeros(0, np.int64), "sim": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "dist": np.zeros(0)}

    def step(s, rows):
        ci, c = _side(rows)
        found = []
        for part in _chunks(len(s["qi"])):
            sim = _units(s["q"][part], c)
            sim[s["qi"][part, None] == ci[None, :]] = -_FAR
            bar = s["least"][part]
            if len(ci) > k:
                bar = np.maximum(bar, np.partition(sim, len(ci) - k, axis=1)[:, len(ci) - k])
            r, j = np.nonzero((sim >= bar[:, None]) & (sim > -_FAR))
            apart = s["q"][part][r, :dist_dims] - c[j, :dist_dims]
            found.append((r + part.start, sim[r, j], ci[j], np.sqrt((apart * apart).sum(1))))
        row, sim, ids, dist = (np.concatenate([s[n], *(f[i] for f in found)]) for i, n in enumerate(("row", "sim", "id", "dist")))
        order = np.lexsort((ids, -sim, row))
        row, sim, ids, dist = row[order], sim[order], ids[order], dist[order]
        first = np.searchsorted(row, row)
        keep = np.arange(len(row)) - first < k
        s["row"], s["sim"], s["id"], s["dist"] = row[keep], sim[keep], ids[keep], dist[keep]
        last = np.arange(len(row)) - first == k - 1
        s["least"][row[last]] = sim[last]
        return ()

    def end(s):
        yield pa.RecordBatch.from_arrays([pa.array(s["qi"][s["row"]]), pa.array(s["id"]), pa.array(s["sim"] / _UNIT), pa.array(s["dist"])], names=["query_id", "cand_id", "sim", "dist"])

    cells, strips = _cells(queries, items, id, v, _numbers(queries, v))
    best = cells.mapInArrow(_over_cells(start, step, end), "query_id long, cand_id long, sim double, dist double")
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "cand_id")  # at most k rows a strip of items
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def gallery_ranks(queries: DataFrame, items: DataFrame, relevant: DataFrame, id: str, v: str) -> DataFrame:
    """``relevant`` (query_id, cand_id, sim) with ``rank``: the 1-based place of the candidate among all other items by
    product at DIGITS digits, then id.

    Every cell counts, for each relevant candidate, how many of its items come before it; the counts are added up.
    A query with many relevant candidates stands in pieces of about PIECE, so a task's share is bounded.
    ``sim`` is the pair's product, as scored elsewhere.  Queries without a vector, and pairs whose candidate has none, have no rank (they fall out).
    """
    scratch = Scratch(items.sparkSession, "ranks")
    wanted = relevant.select(F.col("query_id").cast("long").alias("query_id"), F.col("cand_id").cast("long").alias("cand_id"), F.rint(F.col("sim") * _UNIT).cast("long").alias("units"), "sim").where("query_id <> cand_id")
    sizes = wanted.groupBy("query_id").agg(F.count("*").alias("n"))
    piece = F.pmod(F.xxhash64("cand_id"), F.ceil(F.col("n") / PIECE)).cast("int")
    pieces = wanted.join(sizes, "query_id").groupBy("query_id", piece.alias("piece")).agg(F.collect_list(F.struct("cand_id", "units")).alias("asked"))
    placed = scratch.table(queries.where(F.col(v).isNotNull()).select(F.col(id).cast("long").alias("query_id"), F.col(v).alias("v")).join(pieces, "query_id"))

    def start(rows):
        qi, q = _side(rows)
        asked = rows.field("asked")
        counts = np.diff(np.asarray(asked.offsets)) if len(asked) else np.zeros(0, np.int64)
        flat = asked.flatten()
        owner = np.repeat(np.arange(len(qi)), counts)
        return {"qi": qi, "q": q, "owner": owner, "cand": np.asarray(flat.field("cand_id")), "units": np.asarray(flat.field("units")), "above": np.zeros(len(owner), np.int64)}

    def step(s, rows):
        ci, c = _side(rows)
        by_id = np.argsort(ci)
        ci, c = ci[by_id], c[by_id]
        bits = max(1, int(len(ci)).bit_length())
        for part in _chunks(len(s["qi"]), 1024):
            units = _units(s["q"][part], c)
            # one number orders a row's items: score falling, then id rising
            keys = ((_FAR - units) << bits) + np.arange(len(ci))
            keys[s["qi"][part, None] == ci[None, :]] = np.iinfo(np.int64).max
            keys.sort(axis=1)
            low, high = np.searchsorted(s["owner"], [part.start, part.stop])
            mine = s["owner"][low:high] - part.start
            key = ((_FAR - s["units"][low:high]) << bits) + np.searchsorted(ci, s["cand"][low:high])
            # binary search of all asked in their rows at once
            left, right = np.zeros(len(mine), np.int64), np.full(len(mine), len(ci), np.int64)
            for _ in range(bits + 1):
                middle = (left + right) // 2
                less = (left < right) & (keys[mine, np.minimum(middle, len(ci) - 1)] < key)
                right = np.where((left < right) & ~less, middle, right)
                left = np.where(less, middle + 1, left)
            s["above"][low:high] += left
        return ()

    def end(s):
        yield pa.RecordBatch.from_arrays([pa.array(s["qi"][s["owner"]]), pa.array(s["cand"]), pa.array(s["above"])], names=["query_id", "cand_id", "above"])

    numbers = placed.agg(F.coalesce(F.sum(F.size("v") + 2 * F.size("asked")), F.lit(0))).first()[0]
    cells, _ = _cells(placed, items.select(F.col(id).cast("long").alias("query_id"), F.col(v).alias("v")), "query_id", "v", numbers, {"asked": (F.col("asked"), "array<struct<cand_id:bigint,units:bigint>>")})
    counted = cells.mapInArrow(_over_cells(start, step, end), "query_id long, cand_id long, above long").groupBy("query_id", "cand_id").agg((F.sum("above") + 1).alias("rank"))
    known = items.where(F.col(v).isNotNull()).select(F.col(id).cast("long").alias("cand_id"))
    return wanted.join(counted, ["query_id", "cand_id"]).join(known, "cand_id", "left_semi").select("query_id", "cand_id", "sim", "rank")
