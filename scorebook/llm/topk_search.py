"""Exact top-k search by inner product with a pivot table.

Components become ``floor(scale * x)``. The index holds, for every vector, its distances to ``n_pivots`` pivots. For a query q and a
vector x each pivot p bounds their distance from below by |d(q,p) - d(x,p)|, and the greatest such bound L gives
``q.x <= (|q|^2 + |x|^2 - L^2) / 2``. Within a block, candidates are scored in the order of that bound, some hundreds at a time, until
no bound reaches the k-th best score, so the result is exact. A start value for the k-th score comes from the query's scores
against the fitting sample, of at most ``sample`` vectors; it only saves work.

Queries and vectors meet in blocks: each group of ``query_rows`` queries against each block of ``block_rows`` vectors, dealt by a
hash of the row, so equal vectors or ids spread evenly. Blocks keep k rows per query, and a window over these gives the result.

A vector that is null, or has a null, infinite or NaN component, or no id, takes no part. Only vectors of equal dimension meet. Repeated
candidate rows count each; a query that repeats with the same vector is answered once, and no row with the query's id is its
candidate. Ties go to the smaller id. Scores beyond 64 bits are held at the ends of the range. Fewer than k candidates: all
are returned; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorebook.llm.common import map_batches, stored
from scorebook.session import ship_package


def usable(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``vid`` and ``vec``, the scaled and floored components as doubles, of the rows that take part."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vid"), F.col(f"`{vector_col}`").cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("vid").isNotNull() & F.col("vec").isNotNull() & finite)

    def make():
        def step(batch: pa.RecordBatch):
            col = batch.column("vec")
            at = col.offsets.to_numpy()
            x = np.floor(col.values.to_numpy(zero_copy_only=False) * scale).astype("<f8")
            yield pa.RecordBatch.from_arrays(
                [batch.column("vid"), pa.array(np.diff(at), pa.int32()),
                 pa.array([x[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], ["vid", "dim", "vec"])

        return step

    return map_batches(rows, make, "vid long, dim int, vec binary")


def table(rows, width: int) -> np.ndarray:
    """Rows of packed doubles as a matrix."""
    return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), width)


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * x @ p.T, 0))


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of x with q."""
    if not len(x) or x.shape[1] * np.abs(x).max(initial=0) * np.abs(q).max(initial=0) < 2**53:
        return np.rint(x @ q).astype(np.int64)
    b = [int(v) for v in q.tolist()]
    return np.array([max(-(2**63), min(2**63 - 1, sum(int(u) * v for u, v in zip(row, b)))) for row in x.tolist()], np.int64)


def far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """n rows, each as far as can be from those before it."""
    chosen, near = [0], distances(x, x[:1])[:, 0]
    while len(chosen) < min(n, len(x)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def best(s: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest scores, ties to the smaller id, in that order."""
    if len(s) > 4 * k:  # all that can be among the k best, ties included
        near = s >= np.partition(s, len(s) - k)[len(s) - k]
        s, v = s[near], v[near]
    keep = np.lexsort((v, ~s))[:k]
    return s[keep], v[keep]


def search_block(q: pd.DataFrame, x: pd.DataFrame, k: int, stripe: int = 16, at_once: int = 512) -> list[tuple[int, bytes, int, int]]:
    """The k best of a block for each query: (query id, query vector, vector id, score)."""
    dim, n_pivots = int(q.dim.iloc[0]), len(q.pivots.iloc[0]) // 8
    qv, xv = table(q.vec, dim), table(x.vec, dim)
    qd, xd = table(q.pivots, n_pivots).astype(np.float32), np.ascontiguousarray(table(x.pivots, n_pivots).T.astype(np.float32))
    qn, xn = (qv * qv).sum(1), (xv * xv).sum(1)
    # Halves of sums of squares, and more than single precision can be wrong by.
    slack = 1e-5 * (1 + qn[:, None].max(initial=0) + xn.max(initial=0))
    dense = dim * np.abs(xv).max(initial=0) * np.abs(qv).max(initial=0) < 2**24  # single precision is exact then
    xs, qs = (xv.astype(np.float32), qv.astype(np.float32)) if dense else (xv, qv)
    ids, q_ids, q_raw, floors = x.vid.to_numpy(), q.vid.to_numpy(), list(q.vec), q.floor.to_numpy()
    found = []
    for a in range(0, len(q), stripe):
        b = min(a + stripe, len(q))
        low, gap = np.zeros((b - a, len(x)), np.float32), np.empty((b - a, len(x)), np.float32)
        for p in range(n_pivots if slack < 1e25 else 0):  # beyond that, squares leave single precision
            np.subtract(qd[a:b, p, None], xd[p][None, :], out=gap)
            np.abs(gap, out=gap)
            np.maximum(low, gap, out=low)
        low *= low
        bound = (qn[a:b, None] + xn[None, :] - low) / 2 + slack
        block: np.ndarray | None = None
        for i in range(a, b):
            top, row, q_id = bound[i - a], qv[i].astype(xs.dtype), q_ids[i]
            first = np.argpartition(top, len(x) - at_once)[-at_once:] if len(x) > at_once else np.arange(len(x))
            some = first[(top[first] >= floors[i]) & (ids[first] != q_id)]
            best_s, best_v = best(scores(xs[some], row), ids[some], k)
            floor = best_s[-1] if len(best_s) == k else floors[i]
            top[first] = -np.inf  # scored already
            alive = np.flatnonzero((top >= floor) & (top > -np.inf))
            while len(alive):
                if len(alive) <= 8 * at_once:
                    some, alive = alive, alive[:0]
                    s = scores(xs[some], row)
                elif dense and len(best_s) == k:
                    # The bounds spare too little here: one product for all rows of the stripe costs less than picking.
                    block = qs[a:b] @ xs.T if block is None else block
                    some, alive = alive, alive[:0]
                    s = block[i - a, some]
                    some, s = some[s >= floor], np.rint(s[s >= floor]).astype(np.int64)
                else:
                    cut = np.argpartition(top[alive], len(alive) - 8 * at_once)
                    some, alive = alive[cut[-8 * at_once:]], alive[cut[:-8 * at_once]]
                    s = scores(xs[some], row)
                other = ids[some] != q_id
                best_s, best_v = best(np.concatenate([best_s, s[other]]), np.concatenate([best_v, ids[some[other]]]), k)
                if len(best_s) == k:
                    floor = best_s[-1]
                    alive = alive[top[alive] >= floor]
            found += [(int(q_id), q_raw[i], int(v), int(s)) for s, v in zip(best_s, best_v)]
    return found


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: int = 64,
          n_pivots: int = 32, sample: int = 2048, block_rows: int = 16384, query_rows: int = 2048) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best for every row where ``is_query`` (a condition on ``vid``) holds."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = stored(usable(vectors, id_col, vector_col, scale), "search-vectors")
    fit = rows.orderBy(F.xxhash64("vid"), "vid", "vec").limit(sample).collect()
    by_dim = {d: table([bytes(r["vec"]) for r in fit if r["dim"] == d], d) for d in {r["dim"] for r in fit} if d}
    held = spark.sparkContext.broadcast({d: (far_apart(x, n_pivots), x, np.array([r["vid"] for r in fit if r["dim"] == d]))
                                         for d, x in by_dim.items()})

    def indexed(with_floor: bool):
        def make():
            def step(batch: pa.RecordBatch):
                vid, dims, vec = batch.column("vid").to_numpy(), batch.column("dim").to_numpy(), batch.column("vec").to_pylist()
                pivots: list[bytes] = [b""] * len(vec)
                floor = np.full(len(vec), float("-inf"))
                for d in np.unique(dims):
                    if int(d) not in held.value:
                        continue
                    p, known, names = held.value[int(d)]
                    at = np.flatnonzero(dims == d)
                    x = table([vec[i] for i in at], int(d))
                    for i, row in zip(at, distances(x, p)):
                        pivots[i] = row.astype("<f8").tobytes()
                    if with_floor:
                        for i, q in zip(at, x):
                            s = scores(known[names != vid[i]], q)
                            if len(s) >= k:
                                floor[i] = float(np.partition(s, len(s) - k)[len(s) - k])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivots, pa.binary()), pa.array(floor)],
                                                 ["vid", "dim", "vec", "pivots", "floor"])

            return step

        return make

    schema = "vid long, dim int, vec binary, pivots binary, floor double"
    index = stored(map_batches(rows, indexed(False), schema).drop("floor"), "search-pivots")
    queries = stored(map_batches(rows.where(is_query).distinct(), indexed(True), schema), "search-queries")
    n_blocks = max(1, -(-rows.count() // block_rows))
    n_groups = max(1, -(-queries.count() // query_rows))
    # Each side is dealt by a hash of its rows and copied once for every block, or group, of the other.
    left = (queries.withColumn("g", F.pmod(F.xxhash64("vid", F.lit(1)), F.lit(n_groups)))
            .withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))))
    right = (index.withColumn("b", F.pmod(F.xxhash64("vid", F.monotonically_increasing_id()), F.lit(n_blocks)).cast("int"))
             .withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_groups - 1).cast("long")))))

    def meet(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        found = search_block(q, x, k) if len(q) and len(x) else []
        return pd.DataFrame({"query_id": pd.Series([f[0] for f in found], dtype="int64"), "query": pd.Series([f[1] for f in found], dtype=object),
                             "vec_id": pd.Series([f[2] for f in found], dtype="int64"), "score": pd.Series([f[3] for f in found], dtype="int64")})

    near = (left.groupBy("dim", "g", "b").cogroup(right.groupBy("dim", "g", "b"))
            .applyInPandas(meet, "query_id long, query binary, vec_id long, score long"))
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), F.asc("vec_id"))
    return (near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
