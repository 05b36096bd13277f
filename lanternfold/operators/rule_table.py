"""Screening and topic rules kept as a table of any size: (rule, phrase) rows.

The table is cut into shards of bounded size by hash. A shard's automaton is made once in each task and every
text is read once by it, however many rules it has; a table within the bound is one shard.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfold.functions.automaton import Automaton

SHARD_BYTES = 16 << 20  # of phrases sent to all tasks at a time
ROWS = 256  # texts, or phrases, that a task holds as Python objects


def matches(texts: DataFrame, key: str, text: str, rules: DataFrame, style: str = "name", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``key, rule``: each rule with a phrase in the row's text, once per row. Null texts and phrases match nothing."""
    spark = texts.sparkSession
    table = rules.select(F.col("rule").cast("string").alias("rule"), F.col("phrase").cast("string").alias("phrase")).where(
        "rule IS NOT NULL AND phrase IS NOT NULL").distinct()
    held = table.agg(F.sum(F.octet_length("rule") + F.octet_length("phrase"))).first()[0] or 0
    shards = max(1, math.ceil(held / shard_bytes))
    rows = texts.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType
    out = None
    for shard in range(shards):
        part = table.where(F.pmod(F.xxhash64("phrase"), F.lit(shards)) == shard)
        sink = pa.BufferOutputStream()
        held_rows = part.toArrow()  # shard_bytes of them, about
        with pa.ipc.new_stream(sink, held_rows.schema) as stream:
            stream.write_table(held_rows)
        sent = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())

        def run(batches, sent=sent):
            automaton = Automaton((pair for part in pa.ipc.open_stream(sent.value) for at in range(0, part.num_rows, ROWS)
                                   for pair in zip(*[c.to_pylist() for c in part.slice(at, ROWS).columns])), style)
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    some = batch.slice(at, ROWS)
                    found = [automaton.rules_in(t.as_py()) for t in some.column(1)]
                    of = pa.array([i for i, rules in enumerate(found) for _ in rules], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [some.column(0).take(of), pa.array([r for rules in found for r in rules], pa.string())], names=["key", "rule"])

        made = rows.mapInArrow(run, f"key {kind.simpleString()}, rule string")
        out = made if out is None else out.unionByName(made)
    if shards > 1:  # a rule may have phrases in several shards
        out = out.distinct()
    return out.withColumnRenamed("key", key)
