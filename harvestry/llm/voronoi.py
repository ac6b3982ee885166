"""Exact top-k inner products by a Voronoi kNN join.

A vector x becomes (x, sqrt(M^2 - |x|^2)) with M the largest norm, a query (q, 0): the nearest are then those of the
largest inner product. Pivots split both into Voronoi cells. Summaries of each cell (its number of queries and their
largest pivot distance, the k + 1 smallest pivot distances of its data) bound the k-th distance of every query of a cell,
and with it the pivot distances that a partner can have; data go only to query groups whose bounds they meet. Groups
are cells put together, or parts of a large one; each group's data are dealt by hash into blocks, so that neither a cell
nor a vector that a third of all rows hold lands in one task. Blocks are solved with exact integer products and their
top k merged. In many dimensions without clusters the bounds exclude little, and the join is a blocked scan of the query set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PIVOTS = 32
LIMIT = float(1 << 53)


def _matrix(batch: pa.RecordBatch, scale: float, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(vec_ids, floor(scale * x) as doubles) of the valid rows of batch(vec_id, embedding); shorter vectors end in zeros."""
    ids, col = batch.column(0), batch.column(1)
    size = np.array(col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(size)), size)
    ok = np.array(ids.is_valid()) & np.array(col.is_valid())
    bad = ~np.isfinite(flat)
    ok[row[bad]] = False
    out = np.zeros((len(size), width or int(size.max(initial=0))))
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    flat[bad] = 0
    out[row, at] = np.clip(np.floor(scale * flat), -LIMIT, LIMIT)
    return ids.filter(pa.array(ok)).to_numpy(zero_copy_only=False).astype(np.int64), out[ok]


def _product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products; beyond 64 bits they stay at the limit."""
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1]
    if most < LIMIT:
        return (q @ x.T).astype(np.int64)
    if most < 2.0**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    wide = np.array([[sum(int(a) * int(b) for a, b in zip(u, v)) for v in x] for u in q], object).reshape(len(q), len(x))
    return np.clip(wide, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _distances(v: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    full = np.concatenate([v, extra[:, None]], axis=1)
    square = (full**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * full @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _top(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k largest values, ties to the left."""
    n = score.shape[1]
    least = np.partition(score, n - k, axis=1)[:, n - k] if n > k else np.full(len(score), np.iinfo(np.int64).min)
    row, col = np.nonzero(score >= least[:, None])
    order = np.lexsort((col, -score[row, col].astype(np.float64), row)) if np.abs(score).max(initial=0) < LIMIT else np.lexsort((col, ~score[row, col], row))
    row, col = row[order], col[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], col[rank < k]


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, pivots: int = PIVOTS) -> DataFrame:
    """Per query (row of vectors(vec_id, embedding) whose vec_id is divisible by `every`): query_id, rank, vec_id, score.

    Candidates are all rows but those with the query's vec_id; score is the inner product of floor(scale * x), ties go to
    the smaller vec_id. Rows with a null vec_id, a null vector or one holding a null or non-finite component take no part;
    shorter vectors count as if they ended in zeros; repeated rows are separate candidates, and queries that share a vec_id
    get one list. Other columns are ignored; without queries the result is empty.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null")

    def measure(batches):
        n = queries = width = norm = 0
        for batch in batches:
            ids, v = _matrix(batch, scale)
            n, queries = n + len(ids), queries + int((ids % every == 0).sum())
            width, norm = max(width, v.shape[1]), max(norm, float((v**2).sum(1).max(initial=0)))
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([queries]), pa.array([width]), pa.array([float(norm)])], ["n", "queries", "width", "norm"])

    whole = rows.mapInArrow(measure, "n long, queries long, width long, norm double").agg(F.sum("n").alias("n"), F.sum("queries").alias("queries"), F.max("width").alias("width"), F.max("norm").alias("norm")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not whole.queries:
        return empty
    n, width, norm = whole.n, max(1, whole.width), whole.norm
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).toArrow().combine_chunks().to_batches()  # `pivots` rows
    _, chosen = _matrix(sample[0], scale, width)
    if not len(chosen):
        chosen = np.zeros((1, width))
    extra = lambda v: np.sqrt(np.maximum(norm - (v**2).sum(1), 0))
    centre = np.unique(np.concatenate([chosen, extra(chosen)[:, None]], axis=1), axis=0)
    cells = len(centre)

    def summarise(batches):
        near: list[np.ndarray] = [np.zeros(0)] * cells
        count, far = np.zeros(cells, np.int64), np.zeros(cells)
        for batch in batches:
            ids, v = _matrix(batch, scale, width)
            if not len(ids):
                continue
            d = _distances(v, extra(v), centre)
            cell, own = d.argmin(1), d.min(1)
            for c in np.unique(cell):
                near[c] = np.sort(np.append(near[c], own[cell == c]))[: k + 1]
            q = ids % every == 0
            d = _distances(v[q], np.zeros(int(q.sum())), centre)
            np.add.at(count, d.argmin(1), 1)
            np.maximum.at(far, d.argmin(1), d.min(1))
        some = [c for c in range(cells) if count[c] or len(near[c])]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), pa.array(far[some]), pa.array([near[c].tolist() for c in some], pa.list_(pa.float64()))], ["cell", "queries", "far", "near"])

    parts = rows.mapInArrow(summarise, "cell int, queries long, far double, near array<double>")
    ranked = parts.select("cell", "queries", "far", F.posexplode_outer("near").alias("i", "d")).withColumn("first", F.col("i").isNull() | (F.col("i") == 0))
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy(F.col("d").asc_nulls_last())))
    summary = ranked.groupBy("cell").agg(
        F.sum(F.when(F.col("first"), F.col("queries"))).alias("queries"), F.max("far").alias("far"), F.collect_list(F.when(F.col("r") <= k + 1, F.col("d"))).alias("near")
    ).collect()  # one row for each cell
    queries, far = np.zeros(cells, np.int64), np.zeros(cells)
    near = [np.zeros(0)] * cells
    for r in summary:
        queries[r.cell], far[r.cell], near[r.cell] = r.queries or 0, r.far or 0, np.array(r.near or [], float)
    apart = np.sqrt(np.maximum((centre**2).sum(1)[:, None] + (centre**2).sum(1) - 2 * centre @ centre.T, 0))
    slack = 1e-6 * (1 + np.sqrt(norm))
    reach = np.full(cells, np.inf)
    for i in np.flatnonzero(queries):
        bounds = np.sort(np.concatenate([far[i] + apart[i, j] + near[j] for j in range(cells)]))
        if len(bounds) > k:
            reach[i] = bounds[k] + slack  # the query's own row may be among the first k
    size = int(np.clip(queries.sum() // 4, 256, 4096))
    first, ways, cell_group, groups = np.zeros(cells, np.int64), np.ones(cells, np.int64), [], 0
    fill, left = 0, [int(c) for c in np.flatnonzero(queries)]
    at = left[0]
    while left:  # neighbouring cells share a group
        at = min(left, key=lambda c: apart[at, c])
        left.remove(at)
        if queries[at] > size:
            groups += fill > 0
            first[at], ways[at] = groups, -(-queries[at] // size)
            groups, fill = groups + int(ways[at]), 0
        else:
            if fill + queries[at] > size:
                groups, fill = groups + 1, 0
            first[at] = groups
            fill += int(queries[at])
        cell_group.append(at)
    groups += fill > 0
    low, high = np.full((groups, cells), np.inf), np.full((groups, cells), -np.inf)
    for i in cell_group:
        for g in range(first[i], first[i] + ways[i]):
            low[g] = np.minimum(low[g], apart[i] - far[i] - reach[i])
            high[g] = np.maximum(high[g], apart[i] + far[i] + reach[i])
    blocks = max(1, round(n / np.clip(n // 64, 1024, 65536)))

    def deal(batches):
        for batch in batches:
            ids, v = _matrix(batch, scale, width)
            if not len(ids):
                continue
            d = _distances(v, extra(v), centre)
            cell, own = d.argmin(1), d.min(1)
            row, group = np.nonzero((own[:, None] >= low[:, cell].T - slack) & (own[:, None] <= high[:, cell].T + slack))
            salt = _scatter(ids)
            q = np.flatnonzero(ids % every == 0)
            cell = _distances(v[q], np.zeros(len(q)), centre).argmin(1)
            q_group = first[cell] + salt[q] // 7 % ways[cell]
            block = np.concatenate([salt[row] % blocks, np.tile(np.arange(blocks), len(q))])
            group = np.concatenate([group, np.repeat(q_group, blocks)])
            at, asks = np.concatenate([row, np.repeat(q, blocks)]), np.arange(len(row) + len(q) * blocks) >= len(row)
            data = v.astype(np.int64)
            data = data.astype(np.int16) if np.abs(v).max(initial=0) < 32768 else data
            for lo in range(0, len(at), 20_000):
                s = slice(lo, lo + 20_000)
                rows_ = data[at[s]]
                off = np.arange(len(rows_) + 1, dtype=np.int32) * (rows_.itemsize * width)
                packed = pa.Array.from_buffers(pa.binary(), len(rows_), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(rows_.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(group[s].astype(np.int32)), pa.array(block[s].astype(np.int32)), pa.array(asks[s]), pa.array(ids[at[s]]), packed], ["part", "block", "asks", "vec_id", "v"])

    def solve(table: pa.Table) -> pa.Table:
        asks = np.array(table.column("asks"))
        ids = table.column("vec_id").to_numpy()
        v = np.zeros((len(ids), width))
        for i, x in enumerate(table.column("v").to_pylist()):
            v[i] = np.frombuffer(x, np.int16 if len(x) == 2 * width else np.int64)
        order = np.argsort(ids[~asks], kind="stable")
        who, x = ids[~asks][order], v[~asks][order]
        ask, q = ids[asks], v[asks]
        out = []
        for lo in range(0, len(ask) if len(who) else 0, 256):
            score = _product(q[lo : lo + 256], x)
            own = ask[lo : lo + 256, None] == who[None, :]
            extra_ = int(own.sum(1).max(initial=0))
            row, col = _top(score, k + extra_)
            keep = ~own[row, col]
            out.append((ask[lo + row[keep]], who[col[keep]], score[row[keep], col[keep]]))
        a, b, c = (np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.int64())})

    local = rows.mapInArrow(deal, "part int, block int, asks boolean, vec_id long, v binary").groupBy("part", "block").applyInArrow(solve, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scatter(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) >> np.uint64(8)).astype(np.int64)
