"""Operator 6, exact top-k search: Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are dealt into blocks by a hash of their id, so are queries, and each pair of blocks is one task: the stated query
set against all rows. Within a block every dimension has its list of rows by value. A query walks all its lists
from its better end at once, scores each row it meets in full, and stops when no row further down can beat its
k-th result: the sum of its components times the values reached is less than that. Ties make it walk on, so they go to the
smaller id. The blocks' results meet in one top-k per query.

Components become floor(scale * x) and scores are integers: exact in float64 below 2**53, else in Python integers.

Defined results: null vectors, null ids and vectors with null or non-finite components take no part; only vectors
of as many components as the query's are candidates; rows with the query's own id are the query's own; of several
query rows with one id the smallest vector asks; repeated rows of other ids are candidates each; components
beyond +-2**62 count as that, scores beyond a long as the nearest long; an empty table gives no rows; of further
columns none is read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK, QUERY_BLOCK, FIRST_DEPTH = 8192, 4096, 16


class SortedLists:
    """A block of integer vectors, its rows by id, with a list of rows by value for each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], vectors[order]
        self.down = np.argsort(-self.rows, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(self.rows, self.down.T, axis=0).T.copy()

    def top(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (id, score), the query's own id left out."""
        n = len(self.ids)
        used = np.flatnonzero(query)
        lists, weights, front = self.down[used], query[used], query[used] > 0
        seen = self.ids == query_id
        found, scores, depth, step = np.zeros(0, np.int64), self.rows[:0] @ query, 0, FIRST_DEPTH
        while depth < n:
            to = min(n, depth + step)
            met = np.zeros(n, bool)
            if len(used):
                met[lists[front, depth:to]] = True
                met[lists[~front, n - to : n - depth]] = True
            else:  # every score is 0
                met[depth:to] = True
            met &= ~seen
            seen |= met
            new = np.flatnonzero(met)
            if len(new):
                found, scores = np.concatenate([found, new]), np.concatenate([scores, self.rows[new] @ query])
                if len(found) > k:
                    kth = np.partition(scores, len(scores) - k)[len(scores) - k] if scores.dtype != object else sorted(scores)[-k]
                    few = np.flatnonzero(scores >= kth)
                    best = few[np.lexsort((found[few], -scores[few]))][:k] if scores.dtype != object else np.array(sorted(few, key=lambda i: (-scores[i], found[i]))[:k])
                    found, scores = found[best], scores[best]
            reached = np.where(front, self.values[used, to - 1], self.values[used, n - to])
            if len(found) >= k and (reached * weights).sum() < scores.min():
                break
            depth, step = to, step * 2
        order = sorted(range(len(found)), key=lambda i: (-scores[i], found[i]))
        return [(int(self.ids[found[i]]), int(scores[i])) for i in order]


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), np.int64).reshape(len(vectors), len(vectors.iloc[0]))


def _search(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            queries, rows = _matrix(left["vector"]), _matrix(right["vector"])
            most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, rows.shape[1])
            kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else object
            lists = SortedLists(right["vec_id"].to_numpy(np.int64), rows.astype(kind))
            for query_id, query in zip(left["vec_id"].to_numpy(np.int64), queries.astype(kind), strict=True):
                out += [(int(query_id), v, max(-(2**63), min(2**63 - 1, s))) for v, s in lists.top(query_id, query, k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by `every`, against all rows."""
    x = F.col("embedding")
    usable = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    far = float(2**62)
    whole = F.transform(x, lambda v: F.greatest(F.lit(-far), F.least(F.lit(far), v.cast("double") * scale)))
    whole = F.transform(whole, lambda v: F.floor(v).cast("bigint"))
    rows = vectors.where(usable).select(F.col("vec_id").cast("bigint").alias("vec_id"), whole.alias("vector")).withColumn("dims", F.size("vector"))
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"), F.min_by("dims", "vector").alias("dims"))
    n, q = rows.count(), asked.count()
    blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-q // QUERY_BLOCK))
    block, query_block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(query_blocks))
    left = asked.withColumn("query_block", query_block).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    right = rows.withColumn("block", block).withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)).cast("array<bigint>")))
    key = ["block", "query_block", "dims"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_search(k), "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
