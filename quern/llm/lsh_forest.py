"""Approximate nearest neighbours: a forest of sorted arrays of long hash strings.

A tree hashes a vector to a string of BITS sign bits of random projections and keeps a block's strings in a sorted array; a subtree is a range
of that array. A query descends in each tree to its longest-prefix matches, by binary search. From there all trees ascend
together, one bit at a time: the shared prefix shrinks and the ranges widen until the trees hold enough distinct candidates.
The candidates are scored exactly on the original vectors.

For the largest inner product a vector x is hashed as (x, sqrt(M^2 - |x|^2)) with M the longest length, which makes the angle
follow the inner product. M is an aggregate over all rows; nothing is fitted to a sample.

TREES and SHARE are set for data without structure (random directions, lengths that differ), the hardest
case; measured recall is in the README.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import BLOCK_ROWS, best_of, search_blocks, usable

TREES = 64
BITS = 24
#: The ascent stops when the trees hold this share of the block's distinct vectors, and SMALL k of them at least: a row counts once
#: whatever the trees that hold it, copies of a vector count once. In a block of at most SMALL k distinct vectors every row is a candidate.
SHARE, SMALL = 0.65, 20
SEED = 20240607


def _strings(x: np.ndarray, top: float, trees: int, bits: int, extra: bool) -> np.ndarray:
    """(trees, rows) hash strings as integers, first bit highest."""
    rest = np.sqrt(np.maximum(top * top - (x * x).sum(1), 0.0)) if extra else np.zeros(len(x))
    planes = np.random.default_rng(SEED).standard_normal((x.shape[1] + 1, trees * bits)).astype(np.float32)
    signs = (np.column_stack([x, rest]).astype(np.float32) @ planes) > 0
    weights = (1 << np.arange(bits - 1, -1, -1)).astype(np.int64)
    return np.stack([signs[:, t * bits : (t + 1) * bits] @ weights for t in range(trees)])


def _forest(k: int, top: float, trees: int, bits: int, share: float):
    def distinct(kind, order, low, high):
        found = np.zeros(len(kind), bool)
        for t in range(trees):
            found[kind[order[t, low[t] : high[t]]]] = True
        return found.sum()

    def search(qids, q, ids, a):
        kinds, kind = np.unique(a, axis=0, return_inverse=True)
        kind = kind.reshape(-1)
        want = min(len(kinds), max(share * len(kinds), SMALL * k))
        strings = _strings(a, top, trees, bits, True)
        order = np.argsort(strings, axis=1, kind="stable")
        strings = np.take_along_axis(strings, order, 1)
        asked = _strings(q, top, trees, bits, False)
        low, high = np.empty((trees, len(q)), np.int64), np.empty((trees, len(q)), np.int64)
        left = np.arange(len(q))
        # Synchronous ascent: all trees use the same prefix length; a query leaves once it has enough.
        for length in range(bits, -1, -1):
            drop = bits - length
            for t in range(trees):
                prefix = (asked[t, left] >> drop) << drop
                low[t, left] = np.searchsorted(strings[t], prefix, "left")
                high[t, left] = np.searchsorted(strings[t], prefix + (1 << drop), "left")
            held = (high[:, left] - low[:, left]).sum(0)
            left = np.array([i for i, n in zip(left, held) if n < want or distinct(kind, order, low[:, i], high[:, i]) < want], np.int64)
            if not len(left):
                break
        hit = np.zeros(len(ids), bool)
        for i in range(len(qids)):
            hit[:] = False
            for t in range(trees):
                hit[order[t, low[t, i] : high[t, i]]] = True
            near = np.flatnonzero(hit & (ids != qids[i]))
            scores = np.einsum("ij,j->i", a[near], q[i])
            best = best_of(scores, ids[near], k)
            yield i, near[best], scores[best]

    return search


def nearest(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", query_filter=None, k: int = 20, trees: int = TREES, bits: int = BITS, share: float = SHARE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): up to k nearest found by inner product, nearest first, ties to the smaller id.

    Null, zero and non-finite vectors and null ids take no part. In blocks of at most SMALL k distinct vectors every
    row is a candidate, so small tables are exact. Scores are the double inner products of the original
    vectors. An empty table gives an empty result.
    """
    valid = usable(rows, id_col, vec_col, allow_zero=False)
    top = valid.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0] or 0.0
    asked = valid.filter(query_filter if query_filter is not None else F.col("id") % 20 == 0)
    return search_blocks(valid, asked, _forest(k, float(np.sqrt(top)), trees, bits, share), k, "double", block_rows)
