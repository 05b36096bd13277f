"""Token counts by an exact length histogram.

Documents are encoded once and counted by source and encoded length. Sums over the
histogram then answer, for every context limit: how many documents and tokens there are,
any quantile of length, and how many tokens are left when documents are cut at the limit.

Null and empty texts have length 0. Null sources are a group of their own. An empty table
gives an empty histogram. Only the columns named are read. Rows meet by length, and equal
lengths are counted in the tasks first, so a hot source costs what its lengths cost.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternfold.llm.common import WordEncoder, stage

STEP = 1024  # lengths summed together before their totals are


def encoded_lengths(docs: DataFrame, tokenizer: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``keep`` and ``length``, a row per document."""
    kept = docs.select(*keep, F.col("text").cast("string").alias("__text"))

    def run(batches):
        encoder = WordEncoder(tokenizer)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            lengths = [len(ids) // 4 for i in range(0, len(texts), 512)
                       for ids in encoder.encode([t or "" for t in texts[i : i + 512]])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keep))] + [pa.array(lengths, pa.int64())], names=[*keep, "length"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]]
    return kept.mapInArrow(run, ", ".join([*fields, "length long"]))


def histogram(docs: DataFrame, tokenizer: str, by: tuple[str, ...] = ("source",)) -> DataFrame:
    """by..., length, n_docs: one row for each length that occurs. Staged, as its readers read it twice."""
    counted = encoded_lengths(docs, tokenizer, by).groupBy(*by, "length").agg(F.count("*").alias("n_docs"))
    return stage(counted, "lengths")


def with_sums(counted: DataFrame, by: tuple[str, ...] = ("source",)) -> DataFrame:
    """Adds to each length: docs_le and tokens_le (documents up to this length and their
    tokens), docs_gt (longer ones) and truncated_tokens (all tokens with this length as limit).

    Sums are taken within steps of lengths and then over the steps' totals.
    """
    cells = counted.withColumn("step", (F.col("length") / STEP).cast("long"))
    within = Window.partitionBy(*by, "step").orderBy("length")
    steps = cells.groupBy(*by, "step").agg(
        F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("length")).alias("tokens"))
    before = Window.partitionBy(*by).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    steps = steps.select(
        *by, "step", F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("docs0"),
        F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("tokens0"), F.sum("docs").over(whole).alias("docs_all"))
    same = [F.col(f"c.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*by, "step")]
    joined = cells.alias("c").join(steps.alias("s"), same).select("c.*", "docs0", "tokens0", "docs_all")
    summed = joined.withColumn("docs_le", F.col("docs0") + F.sum("n_docs").over(within)).withColumn(
        "tokens_le", F.col("tokens0") + F.sum(F.col("n_docs") * F.col("length")).over(within))
    gone = F.col("docs_all") - F.col("docs_le")
    return summed.select(*by, "length", "n_docs", "docs_le", "tokens_le", gone.alias("docs_gt"),
                         (F.col("tokens_le") + gone * F.col("length")).alias("truncated_tokens"))


def truncated_total(counted: DataFrame, limit: int) -> Column:
    """Aggregate over a histogram: tokens left when every document is cut at ``limit``."""
    return F.coalesce(F.sum(F.col("n_docs") * F.least(F.col("length"), F.lit(limit))), F.lit(0)).alias("tokens")


def quantile(sums: DataFrame, q: float, by: tuple[str, ...] = ("source",)) -> DataFrame:
    """The smallest length that at least a share q of the documents do not exceed."""
    reached = F.col("docs_le") >= q * (F.col("docs_le") + F.col("docs_gt"))
    return sums.groupBy(*by).agg(F.min(F.when(reached, F.col("length"))).alias("length"))
