"""Exact ranked lexical search with ball trees over sparse document vectors.

A document's vector has an integer impact for each of its terms, an item's vector the terms'
weights times their repeats; the score is their inner product. Only terms of items matter, so
items are taken in blocks of bounded size, and documents are vectors over the terms of a block.

1. Counting. One pass over the whole texts leaves each document's length and its counts of item
   terms; their sums are the corpus statistics (documents, terms, documents by term).
2. Trees. Documents with similar rare terms are brought together; each task cuts its documents
   into trees of bounded size. A node is split by its distances from two far members. Its centroid is
   midway between the extremes of its vectors; for each of ``PARTS`` groups of terms it has the radius
   around the centroid within the group: a ball in each of the groups' subspaces. One ball in the whole
   space excludes nothing here, as an item's few terms meet the spread of all others (measured: half of
   all rows scored with 1,024 groups and leaves of 16, a tenth with 4,096 and 4).
3. Search. An item's inner product with any member is at most <q, centroid> + the sum over the
   groups of |q| times radius. Nodes are opened best-first, and a subtree is left out once its
   bound is below the tenth score found so far, by this tree or an earlier one of the task. Bounds are floating-point numbers,
   raised by more than the rounding error of all operations; scores at leaves are 64-bit integers, and
   a subtree whose bound equals the tenth score is opened, as it may hold a smaller id.
4. The best of all trees are ranked by score and id.

Null and empty texts, and texts without terms, have no vector and are not counted among the
documents. Repeated rows are documents (or items) of their own; rows without id come last among
equal scores. Texts of any length are read whole. Ties go to the smaller id. An item without
terms in any document has no rows, an empty table gives none. Only the named columns are read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternfold.llm.common import release, stage

K1_MILLI, SCALE, PART_OF_LENGTH = 1000, 1_000_000_000, 75  # of the impact
ITEM_BYTES = 1 << 20  # of the items of a block; one larger item is a block of its own
CELLS = 1 << 23  # numbers in a tree's matrix
LEAF = 4
PARTS = 4096
NO_ID = (1 << 63) - 1

_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM).split()


def weight(documents: int, having: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * having + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    """The integer impact of terms that occur tf times in documents of n terms."""
    m = 100 - PART_OF_LENGTH + (PART_OF_LENGTH * n * documents) // all_terms
    return (SCALE * tf) // (K1_MILLI * tf + 8 * m)


class BallTree:
    """A tree over the rows of an integer matrix, and best-first search in it."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.rows, self.ids = rows, ids
        self.parts = min(PARTS, max(1, rows.shape[1]))
        self.part = np.arange(rows.shape[1]) % self.parts
        self.children: list[tuple[int, int] | None] = []
        self.members: list[np.ndarray] = []
        centers, radii = [], []
        todo = [(np.arange(len(rows)), -1, 0)]
        while todo:
            inside, parent, side = todo.pop()
            at = len(self.members)
            if parent >= 0:
                both = self.children[parent] or (at, at)
                self.children[parent] = (at, both[1]) if side == 0 else (both[0], at)
            own = rows[inside].astype(np.float64)
            center = (own.max(axis=0) + own.min(axis=0)) / 2
            apart = (own - center) ** 2
            within = np.zeros((len(inside), self.parts))
            for start in range(0, rows.shape[1], self.parts):
                some = apart[:, start : start + self.parts]
                within[:, : some.shape[1]] += some
            centers.append(center)
            radii.append(np.sqrt(within.max(axis=0)))
            self.members.append(inside)
            self.children.append(None)
            if len(inside) > leaf:
                todo += [(half, at, k) for k, half in enumerate(self._halves(own, apart.sum(axis=1), inside))]
        self.centers, self.radii = np.stack(centers), np.stack(radii)

    @staticmethod
    def _halves(own: np.ndarray, apart: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearer to a member far from the centroid, or to one far from that; halved where that tells nothing."""
        one = own[int(np.argmax(apart))]
        from_one = ((own - one) ** 2).sum(axis=1)
        other = own[int(np.argmax(from_one))]
        order = np.argsort(from_one - ((own - other) ** 2).sum(axis=1), kind="stable")
        cut = len(inside) // 2
        return inside[order[:cut]], inside[order[cut:]]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products of each query (rows) with all members of each node."""
        q = queries.astype(np.float64)
        norms = np.zeros((len(q), self.parts))
        for start in range(0, q.shape[1], self.parts):
            some = q[:, start : start + self.parts] ** 2
            norms[:, : some.shape[1]] += some
        raw = q @ self.centers.T + np.sqrt(norms) @ self.radii.T
        # each result is a sum of at most columns + parts products of numbers that are not negative
        return raw * (1 + (queries.shape[1] + self.parts + 16) * 2.0**-50) + 1

    def search(self, terms: np.ndarray, weights: np.ndarray, bounds: list[float], best: list[tuple[int, int]], k: int) -> int:
        """Puts members into ``best``, a heap of (score, -id), k at most. The number of rows scored is returned."""
        opened, queue = 0, [(-bounds[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound < (best[0][0] if len(best) == k else 1):
                break
            if self.children[node] is not None:
                for child in self.children[node]:
                    heapq.heappush(queue, (-bounds[child], child))
                continue
            inside = self.members[node]
            opened += len(inside)
            scores = self.rows[np.ix_(inside, terms)].astype(np.int64) @ weights
            least = best[0][0] if len(best) == k else 1
            for i in np.flatnonzero(scores >= least).tolist():
                found = (int(scores[i]), -int(self.ids[inside[i]]))
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
        return opened


def _counted(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms), ids and tf of the terms of the block, key (the rarest-looking of them)."""
    terms = docs.sparkSession.sparkContext.broadcast(number)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64()))])

    def run(batches):
        get = terms.value.get
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for i, text in enumerate(batch.column(1)):
                words = terms_of(text.as_py() or b"")
                if words:
                    found = Counter(map(get, words))
                    found.pop(None, None)
                    named = sorted(found)
                    rows.append((ids[i], len(words), named, [found[t] for t in named]))
                if len(rows) == 2000 or (rows and i == batch.num_rows - 1):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return stage(text.mapInArrow(run, "doc_id long, n long, ids array<int>, tf array<long>"), "term-counts")


def _document_frequencies(counted: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term of the block occurs: a table as large as the block's terms."""
    out = np.zeros(size, np.int64)
    for row in counted.select(F.explode("ids").alias("id")).groupBy("id").count().toLocalIterator():
        out[row.id] = row["count"]
    return out


def _item_blocks(items: DataFrame):
    """Lists of (item_id, terms), each of bounded size, one after another."""
    held, size = [], 0
    text = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    for row in text.toLocalIterator():
        found = Counter(terms_of(bytes(row.text or b"")))
        more = sum(len(t) + 16 for t in found)
        if held and size + more > ITEM_BYTES:
            yield held
            held, size = [], 0
        held.append((row.item_id, found))
        size += more
    if held:
        yield held


def _search_block(docs: DataFrame, items: list, k: int, leaf: int, cells: int) -> DataFrame:
    """item_id, place (of the item in the block), doc_id, score, and scored: rows each tree's search looked at."""
    spark = docs.sparkSession
    names = sorted(set().union(*[found for _, found in items]))
    number = {t: i for i, t in enumerate(names)}
    counted = _counted(docs, number)
    sums = counted.agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
    documents, all_terms = sums.documents, sums.terms or 1
    having = _document_frequencies(counted, len(names))
    weights = np.array([weight(documents, int(h)) for h in having], np.int64)
    # columns of the matrices: terms that some document has, rarest first
    order = np.argsort(having, kind="stable")
    order = order[having[order] > 0]
    column = np.full(len(names), -1, np.int64)
    column[order] = np.arange(len(order))
    sent = []
    for item, found in items:
        at = sorted((int(column[number[t]]), int(weights[number[t]]) * r) for t, r in found.items() if column[number[t]] >= 0)
        sent.append((item, np.array([a for a, _ in at], np.int64), np.array([w for _, w in at], np.int64)))
    shared = spark.sparkContext.broadcast((sent, column))
    width = len(order)
    per_tree = max(1, cells // max(1, width))
    at_once = max(1, min(256, cells // max(1, width)))
    schema = pa.schema([("item_id", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64()), ("scored", pa.int64())])

    def near(batches):
        """A key that brings documents of like terms together: the rarest and the second rarest."""
        column = shared.value[1]
        for batch in batches:
            ids = batch.column(2)
            flat, ends = column[ids.flatten().to_numpy()], ids.offsets.to_numpy()
            key = np.full(batch.num_rows, -1, np.int64)
            for i, (a, b) in enumerate(zip((ends[:-1] - ends[0]).tolist(), (ends[1:] - ends[0]).tolist(), strict=True)):
                if b > a:
                    low = np.sort(flat[a:b])[:2]
                    key[i] = (int(low[0]) << 24) + (int(low[1]) if len(low) > 1 else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], names=["doc_id", "n", "ids", "tf", "near"])

    def run(batches):
        queries, column = shared.value
        best: list[list] = [[] for _ in queries]
        scored = np.zeros(len(queries), np.int64)
        held: list[tuple] = []

        def tree():
            rows = np.zeros((len(held), width), np.int32)  # impacts are a million at most
            for i, (_, n, ids, tf) in enumerate(held):
                rows[i, column[ids]] = impacts(tf, np.int64(n), documents, all_terms)
            made = BallTree(rows, np.array([NO_ID if d is None else d for d, *_ in held], np.int64), leaf)
            held.clear()
            for start in range(0, len(queries), at_once):
                some = queries[start : start + at_once]
                dense = np.zeros((len(some), width))
                for i, (_, at, w) in enumerate(some):
                    dense[i, at] = w
                for i, (bound, (_, at, w)) in enumerate(zip(made.bounds(dense).tolist(), some, strict=True), start):
                    if len(at):
                        scored[i] += made.search(at, w, bound, best[i], k)

        for batch in batches:
            batch = batch.to_pydict()
            for d, n, ids, tf in zip(batch["doc_id"], batch["n"], batch["ids"], batch["tf"], strict=True):
                if ids:
                    held.append((d, n, np.array(ids, np.int64), np.array(tf, np.int64)))
                if len(held) == per_tree:
                    tree()
        if held:
            tree()
        rows = [(queries[i][0], i, None if -d == NO_ID else -d, s, int(scored[i]) if j == 0 else 0)
                for i, heap in enumerate(best) for j, (s, d) in enumerate(heap)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    keyed = counted.where("size(ids) > 0").mapInArrow(near, "doc_id long, n long, ids array<int>, tf array<long>, near long")
    dealt = keyed.repartitionByRange("near", "doc_id").sortWithinPartitions("near", "doc_id")
    found = dealt.select("doc_id", "n", "ids", "tf").mapInArrow(run, "item_id long, place int, doc_id long, score long, scored long")
    result = stage(found, "found")
    release(counted)
    return result


def search(docs: DataFrame, items: DataFrame, k: int = 10, leaf: int = LEAF, cells: int = CELLS, statistics: bool = False) -> DataFrame:
    """item_id, rank, doc_id, score of each item's k best documents. With ``statistics`` also
    scored: how many documents were scored for the item, all others were left out by bounds.
    Jobs run in here, one pass over the documents for each block of items; the result reads staged tables."""
    spark = docs.sparkSession
    parts = [_search_block(docs, block, k, leaf, cells).withColumn("block", F.lit(i)) for i, block in enumerate(_item_blocks(items))]
    empty = spark.createDataFrame([], "item_id long, place int, doc_id long, score long, scored long, block int")
    found = empty
    for part in parts:
        found = found.unionByName(part)
    of_item = Window.partitionBy("block", "place")
    rank = F.row_number().over(of_item.orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())).alias("rank")
    columns = ["item_id", "rank", "doc_id", "score"]
    if statistics:
        found = found.withColumn("scored", F.sum("scored").over(of_item))
        columns.append("scored")
    return found.select("block", "place", "item_id", rank, *columns[2:]).where(F.col("rank") <= k).select(*columns)
