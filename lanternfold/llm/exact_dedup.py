"""Exact duplicates by distributed most-significant-digit radix partitioning.

Texts are compared as UTF-8 bytes after lower-casing A-Z. The first digit is the length in
bytes, the next ones are runs of successive bytes, each longer than the one before. Groups
are split digit by digit until they hold one text or the text has ended; texts that end
together in one group are equal. No digest takes part in the decision.

1. Every batch of rows is radix-split where it lies. Of equal texts one stays as their
   representative (the largest id) with the number of its copies; only representatives
   move on. A text with a third of all rows leaves one row per batch.
2. Representatives are dealt to tasks by length and first bytes. A cell's share is the
   number of bytes a task may get, all bytes over the number of partitions. Cells within
   their share are split to the end in one task. Larger ones (fewer than there are
   partitions, so their list is small by construction) are salted to several tasks, which
   each split and merge what they hold; what is left is dealt anew by longer first bytes
   until nothing is.

Null and empty texts are equal. Repeated rows count as often as they come, and one of rows
that are alike in id too is the one kept; rows with a null id count as copies and rank
below all others (a group of such rows alone has a null keep_id). An empty table gives an empty result. Only the id and text columns are read.
Staged tables, not caches, carry the rounds.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfold.llm.common import release, row_of, stage

FIRST = 24  # bytes of the first digit after the length
WIDER = 8  # each next digit is this many times as long
FEW = 16  # representatives that a cell may always hold
LEAST = -(2**63)  # stands for a null id


def split_equal(texts: list[bytes], at: int = 0, width: int = FIRST) -> list[list[int]]:
    """Groups of equal texts as positions, by radix-splitting on length and then on runs of bytes."""
    todo, done = [], []
    by_length = defaultdict(list)
    for i, text in enumerate(texts):
        by_length[len(text)].append(i)
    todo += [(members, at, width) for members in by_length.values()]
    while todo:
        members, at, width = todo.pop()
        if len(members) == 1 or at >= len(texts[members[0]]):
            done.append(members)
            continue
        cells = defaultdict(list)
        for i in members:
            cells[texts[i][at : at + width]].append(i)
        todo += [(cell, at + width, width * WIDER) for cell in cells.values()]
    return done


_MEMBERS = "doc_id long, rep long, keep long, n long, sha string, text binary, number long"
_LINKS = "rep long, top long, keep long, n long, text binary"


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _collapse(docs: DataFrame) -> DataFrame:
    """Every row (doc_id, text, number) with ``rep``, a number of its representative; the representative's own row
    also has its id (``keep``), the number of copies it stands for and the text."""
    names = ["doc_id", "rep", "keep", "n", "sha", "text", "number"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64()]

    def run(batches):
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = [LEAST if i is None else i for i in batch.column(0).to_pylist()]
            given = batch.column(0).to_pylist()
            texts = [(t or b"").lower() for t in batch.column(1).to_pylist()]  # bytes: A-Z only
            numbers = batch.column(2).to_pylist()
            rows = []
            for members in split_equal(texts):
                text = texts[members[0]]
                sha = hashlib.sha256(text).hexdigest()
                best = max(members, key=lambda i: (ids[i], i))
                rows += [(given[i], at, None, None, sha, None, numbers[i]) for i in members if i != best]
                rows.append((given[best], at, ids[best], len(members), sha, text, numbers[best]))
                at += 1
            if rows:
                yield _batch(rows, names, types)

    return docs.mapInArrow(run, _MEMBERS)


def _merge(cells: DataFrame) -> DataFrame:
    """Each representative with the one that stands for its equals in the same cell.

    Rows come sorted by cell, so a task holds one cell's texts at a time. Texts are passed
    on only from cells that another round has to look at.
    """
    names, types = ["rep", "top", "keep", "n", "text"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def settle(rows):
        out, texts = [], [r[2] for r in rows]
        for members in split_equal(texts):
            best = max(members, key=lambda i: (rows[i][1], rows[i][0]))
            top, keep, text, _, again = rows[best]
            out += [(rows[i][0], top, None, None, None) for i in members if i != best]
            out.append((top, top, keep, sum(rows[i][3] for i in members), text if again else None))
        return out

    def run(batches):
        cell, rows, out = None, [], []
        for batch in batches:
            for size, head, part, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (size, head, part) != cell:
                    out += settle(rows)
                    cell, rows = (size, head, part), []
                    if len(out) >= 2000:
                        yield _batch(out, names, types)
                        out = []
                rows.append(row)
        out += settle(rows)
        if out:
            yield _batch(out, names, types)

    return cells.mapInArrow(run, _LINKS)


def _given(docs: DataFrame, number) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), number.alias("number"))


def duplicates(docs: DataFrame, share: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row.

    Jobs run while the rounds are set up; the result reads staged tables. ``share``
    replaces the bytes that a task may get.
    """
    return _numbered(_given(docs, F.lit(None).cast("long")), share).drop("number")


def _numbered(docs: DataFrame, share: int | None = None) -> DataFrame:
    """The same for rows (doc_id, text, number), with the number of each."""
    spark = docs.sparkSession

    def digits(frame: DataFrame, width: int) -> DataFrame:
        return frame.withColumns({"size": F.octet_length("text"), "head": F.substring("text", 1, width)})

    members = stage(digits(_collapse(docs), FIRST), "radix")
    rows = members.where("n IS NOT NULL").select("rep", "keep", "n", "text", "size", "head")
    if share is None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        share = max(1, total // max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2))
    width, links, settled = FIRST, None, None
    while True:
        counts = rows.groupBy("size", "head").agg(F.count("*").alias("held"))
        bytes_held = F.col("size").cast("long") * F.col("held")
        parts = F.least(F.ceil(bytes_held / share), F.floor(F.col("held") / (FEW // 2))).cast("long")
        # each holds more than a partition's share, so there are fewer of them than partitions
        heavy = stage(counts.where((bytes_held > share) & (F.col("held") > FEW)).select("size", "head", parts.alias("parts")),
                      "radix-heavy")
        cells = rows.join(F.broadcast(heavy), ["size", "head"], "left").select(
            "size", "head", F.coalesce(F.pmod(F.xxhash64("rep", F.lit(width)), F.col("parts")), F.lit(0)).alias("part"),
            "rep", "keep", "text", "n", F.col("parts").isNotNull().alias("again"))
        dealt = cells.repartition("size", "head", "part").sortWithinPartitions("size", "head", "part")
        found = stage(_merge(dealt), "radix-round")
        step = found.select("rep", "top")
        if links is None:
            links = step
        else:  # representatives of earlier rounds follow theirs
            moved = step.select(F.col("rep").alias("top"), F.col("top").alias("to"))
            links = links.join(moved, "top", "left").select("rep", F.coalesce("to", "top").alias("top"))
        ended = found.where("n IS NOT NULL AND text IS NULL").select("top", "keep", "n")
        settled = ended if settled is None else settled.unionByName(ended)
        if heavy.isEmpty():
            break
        width *= WIDER
        rows = digits(found.where("text IS NOT NULL").select(F.col("top").alias("rep"), "keep", "n", "text"), width)
    # what is left is narrow: the texts are not needed any more
    narrow = stage(members.select("doc_id", "rep", "sha", "n", "number"), "radix-members")
    release(members)
    groups = links.join(settled.withColumnRenamed("n", "group_size").withColumnRenamed("keep", "best"), "top")
    keep = F.when(F.col("best") != LEAST, F.col("best"))
    return narrow.join(groups, "rep").select(
        "doc_id", keep.alias("keep_id"), "group_size",
        (F.col("n").isNotNull() & (F.col("rep") == F.col("top"))).alias("kept"), F.col("sha").alias("text_sha256"), "number")


def unique(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their columns, whatever their names; of rows alike in id and text one.
    Rows are numbered in a staged table, and the numbers of those that stay choose from it."""
    rows = stage(docs.select(row_of(docs), F.monotonically_increasing_id().alias("number")), "numbered")
    given = rows.select(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), "number")
    kept = _numbered(_given(given, F.col("number"))).where("kept").select("number")
    return rows.join(kept, "number", "left_semi").select("row.*")
