"""Exact top-k inner products by aggregation without random access (NRA).

Candidates and queries meet in blocks.  In a candidate block every dimension has a list of its vectors sorted by
value.  For a query the lists are read from the end that favours it, all to the same depth: a vector's
lower bound is what was read of it plus the worst that its unread dimensions can hold, its upper bound takes the
current list values instead.  Reading stops when neither an unseen vector nor anything beyond the candidates can
reach the k-th lower bound; the candidates' final scores are then resolved and the best k of each block
are merged into the best k of all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 8192
QUERY_BLOCK = 1024
BATCH = 128  # queries whose bounds are held at a time
STEPS = 12  # lists are first read to a twelfth, then twice as deep each time


def block_topk(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, vector, score) of the best k of one block for each query, ties to the smaller id; a vector is no answer to its own id.

    All queries read to the same depth at once, and those that may stop leave; positive weights read a list from its largest value, negative ones from
    its smallest.
    """
    n = len(x)
    out: list[tuple[int, int, int]] = []

    def answer(query: int, candidates: np.ndarray) -> None:
        score = x[candidates] @ q[query]  # integers: final scores of the candidates that are left
        best = np.lexsort((ids[candidates], -score))[:k]
        out.extend((int(query_ids[query]), int(ids[candidates[b]]), int(score[b])) for b in best)

    if n <= k + 1:
        for query in range(len(q)):
            answer(query, np.flatnonzero(ids != query_ids[query]))
        return out
    order = np.argsort(x, axis=0, kind="stable")
    place = np.empty(x.shape, np.int32)  # of a vector in the rising list of a dimension
    np.put_along_axis(place, order, np.arange(n, dtype=np.int32)[:, None], axis=0)
    known = x.astype(float)
    rising = np.take_along_axis(known, order, axis=0)
    positive, negative = np.maximum(q, 0).astype(float), np.minimum(q, 0).astype(float)
    parts = [np.arange(at, min(at + BATCH, len(q))) for at in range(0, len(q), BATCH)]
    depth = -(-n // STEPS)
    while parts:
        top, bottom = place >= n - depth, place < depth  # what is read of the lists from either end
        ends = rising[n - depth], rising[depth - 1]
        worst = [np.where(read, known, end).T for read, end in ((top, rising[0]), (bottom, rising[-1]))]
        best = [np.where(read, known, end).T for read, end in zip((top, bottom), ends, strict=True)]
        left = []
        for part in parts:
            own = positive[part], negative[part]
            lower = own[0] @ worst[0] + own[1] @ worst[1]
            front = own[0] @ ends[0] + own[1] @ ends[1]  # what an unseen vector can score at most
            slack = 1e-9 * (np.abs(lower).max(axis=1) + own[0] @ np.abs(ends[0]) - own[1] @ np.abs(ends[1]) + 1)
            itself = ids[None, :] == query_ids[part][:, None]
            lower[itself] = -np.inf
            bar = np.partition(lower, n - k, axis=1)[:, n - k]  # the k-th lower bound
            stops = (front < bar - slack) | (depth >= n)
            if stops.any():
                upper = own[0][stops] @ best[0] + own[1][stops] @ best[1]
                may = (upper >= (bar - slack)[stops, None]) & ~itself[stops]
                for query, row in zip(part[stops], may, strict=True):
                    answer(query, np.flatnonzero(row))
            if not stops.all():
                left.append(part[~stops])
        parts, depth = left, min(2 * depth, n)
    return out


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = np.floor(256.0 * column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float))
    return flat.astype(np.int64).reshape(len(column), width)


def topk(vectors: DataFrame, k: int, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows but itself, scored by the integer product of floor(256 x).

    ``is_query`` says which rows are queries (null: no).  Rows with a null id, a null vector or a null or
    non-finite component take no part; shorter vectors are filled up with zeros; repeated rows of an id count
    once (rows of one id with other vectors: the largest vector counts); fewer than k others give fewer answers.  Scores
    must fit a 64-bit integer.
    """
    v = F.col(vector_col)
    rows = vectors.where(
        F.col(id_col).isNotNull() & v.isNotNull()
        & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    ).select(F.col(id_col).alias("vec_id"), v.cast("array<double>").alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.groupBy("vec_id").agg(F.max(F.struct("x", "asks")).alias("r")).select("vec_id", "r.x", "r.asks")
    n, asked, width = rows.agg(F.count(F.lit(1)), F.count_if("asks"), F.max(F.size("x"))).first()
    width = max(width or 1, 1)
    rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("x"))))
    blocks, query_blocks = -(-n // BLOCK) or 1, -(-asked // QUERY_BLOCK) or 1
    place = lambda parts: F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    spread = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    candidates = rows.select("vec_id", "x", place(blocks).alias("c"), spread(query_blocks).alias("q"))
    queries = rows.where("asks").select("vec_id", "x", place(query_blocks).alias("q"), spread(blocks).alias("c"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            found = block_topk(
                left.column("vec_id").to_numpy(), _matrix(left.column("x"), width),
                right.column("vec_id").to_numpy(), _matrix(right.column("x"), width), k,
            )
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    local = candidates.groupBy("c", "q").cogroup(queries.groupBy("c", "q")).applyInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # k rows a block at most
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
