"""Exact top-k search: exhaustive term-at-a-time accumulation over postings.

Each component position is a term and each nonzero quantised component a posting. A block keeps, per term, the rows that have it and
their weights. The sparse query rows are taken in small groups; for each term the weighted postings are scattered
into the group's dense integer score arrays. A partition selection takes each query's best of the block,
and the blocks' results are merged by rank.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import best_of, search_blocks, usable

#: Score arrays held at a time (queries of a group).
GROUP = 32


def _exact(k: int):
    def search(qids, q, ids, a):
        if max(np.abs(q).max(initial=0), np.abs(a).max(initial=0)) * np.sqrt(max(1, a.shape[1])) >= 1 << 31:
            raise ValueError("components are too large for sums in 64 bits")
        q, a = q.astype(np.int64), a.astype(np.int64)
        postings = []
        for t in range(a.shape[1]):
            rows = np.flatnonzero(a[:, t])
            postings.append((rows, a[rows, t], len(rows) == len(ids)))
        for start in range(0, len(qids), GROUP):
            part = q[start : start + GROUP]
            scores = np.zeros((len(part), len(ids)), np.int64)
            for t, (rows, weights, every) in enumerate(postings):
                asked = np.flatnonzero(part[:, t])
                if not len(asked) or not len(rows):
                    continue
                if every:
                    for i in asked.tolist():
                        scores[i] += part[i, t] * weights
                else:
                    for i in asked.tolist():
                        scores[i, rows] += part[i, t] * weights
            for i in range(len(part)):
                own = np.searchsorted(ids, [qids[start + i], qids[start + i] + 1])
                at = best_of(scores[i], ids, k + int(own[1] - own[0]))
                at = at[ids[at] != qids[start + i]][:k]
                yield start + i, at, scores[i, at]

    return search


def exact_topk(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", query_filter=None, k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query among all other rows.

    Components become floor(scale * x). Ties go to the smaller id. Vectors that are null or hold null or
    non-finite components, and null ids, take no part; zero vectors do. Of repeated ids, the smallest vector asks, rows that share
    the query's id are not its candidates, and other repeated rows are ranked each. Vectors of different lengths meet as if
    filled with zeros. Products are summed in 64 bits: components beyond 2 ** 31 / sqrt(length) in size would wrap, so they raise. Other
    columns change nothing. An empty table gives an empty result.
    """
    valid = usable(rows, id_col, vec_col, allow_zero=True).select("id", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("double")).alias("v"))
    asked = valid.filter(query_filter if query_filter is not None else F.col("id") % 100 == 0)
    return search_blocks(valid, asked, _exact(k), k, "long")
