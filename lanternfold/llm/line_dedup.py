"""Line dedup over range-partitioned hashes.

A line's key is the line without white space at its ends, A-Z lower-cased. Keys that are
long enough and occur in enough documents keep their lines only in the document with the
largest id. The result is a keep bitmap per document, not text: 64 lines to a word, and
only words in which a line goes are stored, so a document that loses nothing has no row.

Lines become rows of two 64-bit hashes of the key (together 128 bits), document and
position. These are range-partitioned by hash and sorted by hash, document (largest first)
and position, so that a pass over a partition meets a key's first occurrence, the one that
stays, before the others. Keys with more than about a 2,400th of all lines are found by a
frequent-items sketch of fixed size (it names at most 2,500) and counted
with partial sums, so that none of them meets in one task; their totals, no more rows than
the sketch names, are sent to where the lines are.

Null and empty texts are one empty line. Rows with the same id are one document; a null id
is one too and ranks below all others. Repeated rows get equal results. An empty table
gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternfold.llm.common import ascii_lower, stage

SPACE = " \t\n\x0b\x0c\r"
LONG, MANY = 20, 3
NAMED, TRACKED = 2_500, 10_000
NO_ID = -(2**63)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _rows(docs: DataFrame) -> DataFrame:
    """doc, row (tells texts with the same id apart) and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("row"), "text")


def _keyed(rows: DataFrame, long: int) -> DataFrame:
    lines = rows.select("doc", "row", F.posexplode_outer(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc", "row", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= long)
    return keys.select("doc", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def keep_bitmaps(docs: DataFrame, long: int = LONG, many: int = MANY) -> DataFrame:
    """doc, row and ``keep``, a map from word number to 64 keep bits, of documents that lose a line."""
    lines = stage(_keyed(_rows(docs), long), "lines")
    top = lines.agg(F.expr(f"approx_top_k(h1, {NAMED}, {TRACKED})").alias("top")).select(F.explode("top.item").alias("h1"))
    named = F.broadcast(stage(top, "frequent"))  # at most NAMED rows

    # the many keys: sorted runs
    rest = lines.join(named, "h1", "left_anti").repartitionByRange("h1", "h2")
    run = Window.partitionBy("h1", "h2")
    ordered = rest.withColumn("nth", F.dense_rank().over(run.orderBy(F.desc("doc"))))
    gone = ordered.withColumn("held", F.max("nth").over(run)).where((F.col("held") >= many) & (F.col("nth") > 1))

    # the few frequent ones: sums
    often = lines.join(named, "h1", "left_semi")
    totals = often.groupBy("h1", "h2").agg(F.count_distinct("doc").alias("held"), F.max("doc").alias("last"))
    gone_often = often.join(F.broadcast(totals.where(F.col("held") >= many)), ["h1", "h2"]).where("doc < last")

    spots = gone.select("doc", "row", "pos").unionByName(gone_often.select("doc", "row", "pos"))
    words = spots.groupBy("doc", "row", F.expr("pos div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(pos % 64 as int))")).alias("drop"))
    return words.groupBy("doc", "row").agg(
        F.map_from_entries(F.collect_list(F.struct("word", F.bitwise_not("drop")))).alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text of every row."""
    joined = _rows(docs).join(bitmaps, ["doc", "row"], "left")
    dense = F.expr("""CASE WHEN keep IS NOT NULL THEN
        transform(sequence(0L, array_max(map_keys(keep))), w -> coalesce(keep[w], -1L)) END""")
    lined = joined.select("doc_id", "text", dense.alias("bits"), F.split("text", "\n", -1).alias("lines"))
    kept = F.expr("""CASE WHEN bits IS NOT NULL THEN
        filter(lines, (line, i) -> coalesce(getbit(get(bits, i div 64), i % 64), 1) = 1) END""")
    cut = lined.select("doc_id", "text", F.size("lines").alias("n"), kept.alias("kept"))
    return cut.select(
        "doc_id", F.col("n").cast("long").alias("n_lines"),
        F.when(F.col("kept").isNull(), 0).otherwise(F.col("n") - F.size("kept")).cast("long").alias("n_dropped"),
        F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n")).alias("text"))


def without_repeats(docs: DataFrame, long: int = LONG, many: int = MANY) -> DataFrame:
    """Documents without repeated lines."""
    return apply_bitmaps(docs, keep_bitmaps(docs, long, many))
