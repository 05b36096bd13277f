"""Exact top-k by inner product with no-random-access aggregation of sorted lists.

Components are turned into integers, floor(1024 * x). Candidates and queries are dealt to
blocks by a hash of their ids; each pair of a query block and a candidate block is one
task. A task holds, for each dimension, its candidates sorted by component. For one query
the best contributions come first at one end of each list, by the sign of the query's
component. The lists are read in parallel from there, deeper each turn, and a candidate's
score lies between what was read of it plus the worst rest and what was read of it plus
the lists' present fronts. A candidate whose upper bound is below the k-th best lower
bound cannot qualify; reading stops when few others are left, and their scores are
completed. The tasks' winners are ranked per query, first where they lie.

Vectors that are null or hold a null or non-finite component take no part, neither as query
nor as candidate; a shorter vector counts as filled up with zeros. Equal scores go to the
smaller id. Rows that share a query's id are all its own and no candidates for it; of such
rows the largest vector asks. Repeated candidates rank as often as they come. Rows with a
null id take no part. Empty tables give an empty result. Only the id and vector columns
are read. Scores are 64-bit integers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES = 4096  # per block
QUERIES = 512  # per block
SCALE = 1024


def integer_vectors(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and v, the integer components, of the rows that take part."""
    given = vectors.select(F.col("vec_id").cast("long"), F.col(vector).cast("array<double>").alias("x"))
    fit = F.forall("x", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    whole = F.transform("x", lambda c: F.floor(c * SCALE).cast("long"))
    return given.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & fit).select("vec_id", whole.alias("v"))


def _matrix(rows, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


class SortedLists:
    """The candidates of a block as one sorted list per dimension."""

    def __init__(self, values: np.ndarray):
        self.values = values  # candidates x dimensions
        order = np.argsort(values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(values, order, axis=0)
        self.order, self.lists = np.ascontiguousarray(order.T), np.ascontiguousarray(self.sorted.T)

    def survivors(self, query: np.ndarray, k: int) -> np.ndarray:
        """Candidates that may be among the k best (every one that could tie included)."""
        n, width = self.values.shape
        if n <= 4 * k or not width:
            return np.arange(n)
        dims = np.flatnonzero(query)
        q = query[dims]
        forward = q < 0  # small components contribute most
        worst = (q * np.where(forward, self.sorted[-1, dims], self.sorted[0, dims])).astype(np.float64)
        read = np.zeros(n)  # contributions read so far
        hidden = np.ones((len(dims), n))  # 1 where a list has not yet shown the candidate
        alive = np.arange(n)
        depth, step = 0, max(2 * k, n // 8)
        while depth < n and len(alive) > 4 * k:
            stop = min(n, depth + step)
            for row, (j, ascending) in enumerate(zip(dims, forward, strict=True)):
                at = slice(depth, stop) if ascending else slice(n - stop, n - depth)
                ids = self.order[j, at]
                read[ids] += q[row] * self.lists[j, at]
                hidden[row, ids] = 0
            edge = (q * np.where(forward, self.sorted[stop - 1, dims], self.sorted[n - stop, dims])).astype(np.float64)
            rest = hidden if len(alive) == n else hidden[:, alive]
            low, high = read[alive] + worst @ rest, read[alive] + edge @ rest
            bar = np.partition(low, len(low) - k)[len(low) - k]
            alive = alive[high >= bar]
            depth, step = stop, step * 2
        return alive

    def best(self, query: np.ndarray, k: int, skip: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the k best, without those flagged in skip (at most a few)."""
        found = self.survivors(query, k + int(skip.sum()))
        found = found[~skip[found]]
        scores = self.values[found] @ query
        first = np.lexsort((ids[found], -scores))[:k]
        return found[first], scores[first]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, candidates: int = CANDIDATES,
           per_task: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of ``vectors`` for each row of
    ``queries``; both as from ``integer_vectors``."""
    asked = queries.groupBy("vec_id").agg(F.max("v").alias("v")).withColumnRenamed("vec_id", "query_id")
    c_blocks = max(1, -(-vectors.count() // candidates))
    q_blocks = max(1, -(-asked.count() // per_task))
    left = asked.select(
        F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).alias("qb"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(c_blocks - 1).cast("long"))).alias("cb"), "query_id", "v")
    right = vectors.select(  # also by the vector: rows that repeat an id spread
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))).alias("qb"),
        F.pmod(F.xxhash64("vec_id", "v"), F.lit(c_blocks)).alias("cb"), "vec_id", "v")

    def cell(asks: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asks) and len(rows):
            width = max(max(map(len, asks["v"])), max(map(len, rows["v"])))
            lists, ids = SortedLists(_matrix(rows["v"], width)), rows["vec_id"].to_numpy()
            for name, query in zip(asks["query_id"], _matrix(asks["v"], width), strict=True):
                at, scores = lists.best(query, k, ids == name, ids)
                out.append(pd.DataFrame({"query_id": name, "vec_id": ids[at], "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    tasks = c_blocks * q_blocks  # stated, or small cells would be put together in one task
    left, right = (side.repartition(tasks, "qb", "cb") for side in (left, right))
    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(
        cell, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
