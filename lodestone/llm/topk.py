"""Exact top-k by inner product over an impact-ordered index, score at a time.

Vectors are small integers. Candidates are dealt into blocks; inside a block every dimension has its postings
ordered by value, so that for a query weight w they are ordered by impact w * v, measured from the least impact of that
dimension in the block. A query's segments (the postings of one dimension between two levels of a common
impact scale) are taken in descending impact and added to accumulators. After a level, an
unseen posting adds at most the level's lower edge, so accumulator and accumulator plus the sum of these
bounds enclose every score. Levels stop only on proof: when no more candidates than `few` can still be among
the k best. All that can are scored exactly, ties included.

Each query meets every block once (queries x blocks, in blocks); the k best of each block go into a
final top k. Ties go to the smaller id. Defined results: null vectors, vectors holding null or a
non-finite component and rows with a null id take no part; a query never finds rows with its own id; with fewer
candidates, fewer rows return; repeated rows are candidates each; vectors of another length than the query have no
score with it. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.tables import written


class Block:
    """The postings of up to some thousands of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors.astype(np.int64)
        self.order = np.argsort(self.vectors, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(self.vectors.T, self.order, axis=1)
        self.most = int(np.abs(self.vectors).max(initial=0))
        # half as wide where no impact can overflow it
        self.narrow = self.sorted.astype(np.int32) if self.most < 1 << 31 else None

    def top(self, own: int, query: np.ndarray, k: int, levels: int = 3, few: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of every candidate that can be among the k best; at least all of the k best."""
        n, dims = self.vectors.shape
        able = self.ids != own
        edge = np.where(query >= 0, self.sorted[:, 0], self.sorted[:, -1]) * query
        most = np.where(query >= 0, self.sorted[:, -1], self.sorted[:, 0]) * query - edge
        largest = int(np.abs(query).max(initial=0))
        fits = self.narrow is not None and 2 * dims * self.most * largest < 1 << 31
        values = self.narrow if fits else self.sorted
        acc = np.zeros(n, dtype=values.dtype)
        start = np.full(dims, n)
        up = query >= 0
        for level in range(levels - 1, -1, -1):
            floor = int(most.max(initial=0)) * level // levels
            for d in np.flatnonzero((most >= floor) & (query != 0)).tolist():
                w, e = int(query[d]), int(edge[d])
                # postings with impact >= floor that were not taken yet: the high end for w > 0, the low end for w < 0
                if up[d]:
                    to = int(np.searchsorted(self.sorted[d], -((-(floor + e)) // w), side="left"))
                    span = slice(to, start[d])
                else:
                    to = n - int(np.searchsorted(self.sorted[d], (floor + e) // w, side="right"))
                    span = slice(n - start[d], n - to)
                if span.start < span.stop:
                    acc[self.order[d, span]] += values[d, span] * values.dtype.type(w) - values.dtype.type(e)
                start[d] = min(start[d], to)
            if level == 0:
                rest = 0
            else:
                rest = int(np.minimum(most, max(0, floor - 1))[start > 0].sum())
            lower = acc[able]
            if len(lower) <= k:
                possible = able
                if level:
                    continue
            else:
                kth = np.partition(lower, len(lower) - k)[len(lower) - k]
                possible = able & (acc + rest >= kth)
            if level == 0 or possible.sum() <= max(few, k):
                break
        at = np.flatnonzero(possible)
        return self.ids[at], self.vectors[at] @ query


def _pairs(k: int):
    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        for dims, part in right.groupby(right["v"].map(len)) if len(right) else ():
            mine = left[left["v"].map(len) == dims] if len(left) else left
            if not len(mine) or not dims:
                continue
            block = Block(part["vec_id"].to_numpy(), np.stack(part["v"].to_numpy()))
            for own, query in zip(mine["vec_id"], mine["v"], strict=True):
                ids, scores = block.top(int(own), np.asarray(query, dtype=np.int64), k)
                best = np.lexsort((ids, -scores))[:k]
                out["query_id"] += [int(own)] * len(best)
                out["vec_id"] += ids[best].tolist()
                out["score"] += scores[best].tolist()
        return pd.DataFrame(out).astype("int64")

    return run


def quantised(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of each component, usable rows only."""
    x = F.transform(vector_col, lambda e: e.cast("double"))
    usable = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null").where(usable).select("vec_id", F.transform("x", lambda e: F.floor(e * scale)).alias("v"))


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, *, block_rows: int = 8192, least_tasks: int = 8, query_rows: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score) over (vec_id, v array<long>) candidates and queries.

    A task has one block of candidates and one part of the queries. A query costs a block's dimensions, not its rows, in
    steps, so blocks are full and a small table's tasks come from dealing out its queries.
    """
    candidates, queries = written(candidates), written(queries)
    blocks = max(1, -(-candidates.count() // block_rows))
    parts = max(-(-queries.count() // query_rows), -(-least_tasks // blocks))
    deal = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), F.col("vec_id"), F.col("v")), F.lit(n)).cast("int")
    left = queries.withColumn("part", deal(parts, 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # repeated rows would meet in one block: the row number deals them out
    right = candidates.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(_pairs(k), "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
