"""What the two vector searches share: valid vectors, index blocks, queries against blocks, merging."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import prepare

#: Rows of an index block: what one task holds in memory at a time.
BLOCK_ROWS = 16384
#: Queries that meet a block in one task. As many as a block has rows, which sends the least: each row goes once per chunk of queries, each
#: query once per block.
QUERY_ROWS = 16384


def usable(rows: DataFrame, id_col: str, vec_col: str, allow_zero: bool) -> DataFrame:
    """(id, v) without rows whose id or vector is null or whose vector holds a null or non-finite component (or is zero)."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    ok = F.col("v").isNotNull() & F.col("id").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    if not allow_zero:
        ok = ok & F.exists("v", lambda x: x != 0)
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(ok)


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list<double> column as a matrix; shorter vectors are filled with zeros, which change no inner product."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    sizes = np.diff(column.offsets.to_numpy()) if n else np.zeros(0, np.int64)
    width = max(int(sizes.max()) if n else 0, width or 0)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if n and (sizes == width).all():
        return flat.reshape(n, width)
    out = np.zeros((n, width))
    out[np.repeat(np.arange(n), sizes), np.concatenate([np.arange(s) for s in sizes]) if n else []] = flat
    return out


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, best first, ties to the smaller id: partition selection, then a sort of
    what reaches the k-th score (all ties of it)."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= kth)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def search_blocks(rows: DataFrame, queries: DataFrame, search, k: int, score_type: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k best candidates of each query over all rows: (query_id, rank, vec_id, score).

    `rows` and `queries` have (id, v). Rows are dealt to blocks by a hash of their id, queries to chunks; a copy of each
    chunk meets each block in one task (a stated query set against all rows, in blocks). `search(query_ids, query_matrix,
    ids, matrix)` yields (query position, candidate positions, scores) with at most k candidates each. The merge
    keeps k rows a query and block and ranks them with a grouped limit, so no task sees more than
    k rows of a query from a block.
    """
    spark = rows.sparkSession
    prepare(spark)
    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    n, m = rows.count(), queries.count()
    blocks, chunks = max(1, -(-n // block_rows)), max(1, -(-m // QUERY_ROWS))
    index = rows.select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "v")
    asked = queries.select(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(chunks)).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "v")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            ids, qids = left["id"].to_numpy(), right["id"].to_numpy()
            order, qorder = np.argsort(ids, kind="stable"), np.argsort(qids, kind="stable")
            a, b = matrix(left["v"]), matrix(right["v"])
            width = max(a.shape[1], b.shape[1])
            a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
            ids, qids, a, b = ids[order], qids[qorder], a[order], b[qorder]
            for q, at, scores in search(qids, b, ids, a):
                out.append((np.full(len(at), qids[q]), ids[at], scores))
        cols = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        kind = pa.int64() if score_type == "long" else pa.float64()
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2].astype(np.int64 if score_type == "long" else np.float64), kind)})

    found = index.groupBy("chunk", "block").cogroup(asked.groupBy("chunk", "block")).applyInArrow(run, f"query_id long, vec_id long, score {score_type}")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
