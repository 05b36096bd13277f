"""Packing by power-of-two decomposition.

A document of n ids is cut into pieces as the binary digits of n say: as many pieces of
the longest length as fit, then one piece for each 1 among the lower digits, longest
first. Every piece is a sequence of its own, so no sequence holds ids of two documents,
and as every length is a power of two nothing is padded. Sequences of equal length form
a bucket and are numbered one after another, bucket by bucket, so that a reader takes
batches of one length from a range of ids.

Null text counts as empty; an empty document is one piece that holds the closing id.
Repeated rows are packed as often as they come; a null document id stays null. An empty
table gives an empty result. Only the id and text columns are read.

Nothing is shuffled: a task numbers its pieces by bucket, and the tasks' counts (one row
per task and length) become offsets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternfold.llm.common import WordEncoder, stage

LONGEST = 4096
END_ID = 2


def lengths_of(n: int, longest: int) -> list[int]:
    """Piece lengths of a document of n ids, longest first; ``longest`` is a power of two."""
    pieces = [longest] * (n // longest)
    rest, size = n % longest, longest
    while rest:
        size >>= 1
        if rest & size:
            pieces.append(size)
            rest ^= size
    return pieces


def cut(docs: DataFrame, tokenizer: str, longest: int = LONGEST, end_id: int = END_ID) -> DataFrame:
    """Pieces with their ids: doc_id, start, length, ids (little-endian unsigned 32-bit),
    doc_tokens, bucket (log2 of length), task and nth (number in the task's bucket)."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
              ("doc_tokens", pa.int64()), ("bucket", pa.int32()), ("task", pa.int32()), ("nth", pa.int64())]
    schema = pa.schema(fields)
    close = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder, task, counts = WordEncoder(tokenizer), TaskContext.get().partitionId(), {}
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first in range(0, len(texts), 512):
                rows: list[tuple] = []
                some = encoder.encode([t or "" for t in texts[first : first + 512]])
                for name, ids in zip(names[first : first + 512], some, strict=True):
                    ids += close
                    n, start = len(ids) // 4, 0
                    for size in lengths_of(n, longest):
                        bucket = size.bit_length() - 1
                        nth = counts.get(bucket, 0)
                        counts[bucket] = nth + 1
                        rows.append((name, start, size, ids[4 * start : 4 * (start + size)], n, bucket, task, nth))
                        start += size
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, start long, length long, ids binary, doc_tokens long, bucket int, task int, nth long")


def number(pieces: DataFrame) -> DataFrame:
    """Gives pieces of ``cut`` a sequence_id (buckets one after another, longest first) and
    their offset in it. Stages the pieces, so that the numbers belong to one set of rows."""
    kept = stage(pieces, "pieces")
    counts = kept.groupBy("bucket", "task").agg(F.count("*").alias("n"))
    order = Window.orderBy(F.desc("bucket"), "task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("bucket", "task", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("first"))
    numbered = kept.join(F.broadcast(firsts), ["bucket", "task"])  # a row per task and length at most
    return numbered.withColumn("sequence_id", F.col("first") + F.col("nth")).withColumn(
        "offset", F.lit(0).cast("long")).drop("first", "nth", "task")


def pack(docs: DataFrame, tokenizer: str, longest: int = LONGEST, end_id: int = END_ID) -> DataFrame:
    """Sequences with their ids, one row per piece."""
    return number(cut(docs, tokenizer, longest, end_id))


def digest(docs: DataFrame, tokenizer: str, longest: int = LONGEST, end_id: int = END_ID) -> DataFrame:
    """``pack`` with a checksum of each piece in place of its ids."""
    pieces = cut(docs, tokenizer, longest, end_id).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return number(pieces).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")
