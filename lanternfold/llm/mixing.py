"""Mixing sources to target weights by temperature.

Each source's share of all tokens is raised to an exponent between 0 and 1 and normalised:
1 keeps the natural mix, 0 makes all sources equal. The exponent is bisected for the
flattest mix within a repetition limit (no source is read more than ``max_repeats`` times
as often as the least read one), or for the mix with a given entropy. A budget of tokens
gives each source its quota; without one the budget is the smallest that reads every
document at least once, so that mixing repeats small sources and loses nothing.

A source is read in passes, each in its own order, by a digest of id, text digest and pass;
the last pass ends where the quota does. The quota of every source is spread evenly over
blocks, so every block holds the mix, and within a block documents are ordered by digest.

A document's tokens are its words, runs of ``[^\\x20\\x09-\\x0D]``, and one closing token;
null and empty texts have the closing one only. A null source is a source. Rows alike in
id, source and text move together (``n_rows`` tells how many). An empty table gives an
empty mix. Only id, text and source are read.

Running totals come from cells of a pass's order: totals per cell, then sums over cells,
then sums within. A hot source has as many cells as its rows ask for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternfold.llm.common import row_of, stage

MAX_REPEATS = 2.0
BLOCK_TOKENS = 1_000_000
STEPS = 60
PER_CELL = 20_000
WORD = "[^\\x20\\x09-\\x0D]+"


def units(docs: DataFrame) -> DataFrame:
    """doc_id, row, source, tokens and n_rows: what is mixed. Staged."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.md5(text.cast("binary")).alias("row"), (F.regexp_count(text, F.lit(WORD)) + 1).cast("long").alias("words"))
    return stage(rows.groupBy("doc_id", "row", "source").agg(
        F.sum("words").alias("tokens"), F.count("*").alias("n_rows")), "units")


def weights(mixed: DataFrame, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None,
            budget: int | None = None) -> DataFrame:
    """source, tokens, docs, share, alpha, weight, quota and total (the budget): one row per source.

    The bisection runs over one row that holds the shares of all sources as an array.
    """
    if (max_repeats is None) == (target_entropy is None):
        raise ValueError("give max_repeats or target_entropy")
    by_source = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    one = by_source.agg(F.sort_array(F.collect_list("tokens")).alias("t"), F.sum("tokens").alias("all"))
    one = one.where("`all` > 0").select("all", F.expr("transform(t, x -> x / `all`)").alias("p"))
    if target_entropy is None:  # the flattest mix within the limit
        fine = f"power(array_min(p) / array_max(p), {{a}} - 1D) <= {float(max_repeats)}D"
    else:  # entropy falls as the exponent grows
        raised = "aggregate(p, 0D, (n, x) -> n + power(x, {a}))"
        fine = (f"ln({raised}) - aggregate(p, 0D, (n, x) -> n + power(x, {{a}}) * {{a}} * ln(x)) / {raised}"
                f" <= {float(target_entropy)}D")
    middle = "((s.lo + s.hi) / 2D)"
    search = f"""aggregate(sequence(1, {STEPS}), named_struct('lo', 0D, 'hi', 1D), (s, i) ->
        CASE WHEN {fine.format(a=middle)} THEN named_struct('lo', s.lo, 'hi', {middle})
        ELSE named_struct('lo', {middle}, 'hi', s.hi) END).hi"""
    alpha = f"CASE WHEN {fine.format(a='0D')} THEN 0D ELSE {search} END"
    found = one.select("all", "p", F.expr(alpha).alias("alpha")).select(
        "all", "alpha", F.expr("aggregate(p, 0D, (s, x) -> s + power(x, alpha))").alias("norm"),
        F.expr("aggregate(p, 0D, (s, x) -> s + power(x, alpha))  / power(array_max(p), alpha - 1D)").alias("cover"))
    row = found.first()  # four numbers
    if row is None:
        row = {"all": 1, "alpha": 1.0, "norm": 1.0, "cover": 1.0}
    total = float(budget) if budget is not None else row["cover"] * row["all"]
    weighted = by_source.select(
        "source", "tokens", "docs", (F.col("tokens") / F.lit(row["all"])).alias("share"),
        F.lit(row["alpha"]).alias("alpha"), F.lit(total).alias("total")).withColumn(
        "weight", F.pow("share", "alpha") / F.lit(row["norm"]))
    quota = "cast(round(total * weight, 0) as bigint)"
    if budget is None:  # rounding must not lose a document
        quota = f"greatest(tokens, {quota})"
    return weighted.select("source", "tokens", "docs", "share", "alpha", "weight", F.expr(quota).alias("quota"),
                           F.col("total").cast("long").alias("total"))


def realise(mixed: DataFrame, weighted: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, row, source, n_rows, copy, tokens, block and position of every document read:
    ``copy`` is the pass, ``position`` its place in the block."""
    quotas = weighted.select(
        F.col("source").alias("s"), F.col("tokens").alias("whole"), "quota",
        F.expr(f"greatest(1L, ceil(total / {int(block_tokens)}D))").alias("blocks"),
        F.expr(f"cast(greatest(0, ceil(log2(docs / {PER_CELL}D))) as int)").alias("bits"))
    passes = F.expr("CASE WHEN quota > 0 THEN sequence(0L, (quota - 1) div whole) ELSE array() END")
    read = mixed.join(quotas, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "row", "source", "n_rows", "tokens", "whole", "quota", "blocks", "bits", F.explode(passes).alias("copy"))
    order = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "row", F.col("copy").cast("string")).cast("binary"))
    keyed = read.withColumn("order", order).withColumn(
        "cell", F.expr("shiftright(cast(conv(substring(order, 1, 8), 16, 10) as bigint), 32 - bits)"))
    kept = stage(keyed, "passes")
    cells = kept.groupBy("source", "copy", "cell").agg(F.sum("tokens").alias("held"))
    before = Window.partitionBy("source").orderBy("copy", "cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = cells.select(F.col("source").alias("s"), F.col("copy").alias("c"), F.col("cell").alias("l"),
                         F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "copy", "cell").orderBy("order", "doc_id", "row")
    placed = kept.withColumn("upto", F.sum("tokens").over(within.rowsBetween(Window.unboundedPreceding, 0))).join(
        bases, F.col("source").eqNullSafe(F.col("s")) & (F.col("copy") == F.col("c")) & (F.col("cell") == F.col("l")))
    inside = placed.withColumn("stop", F.col("base") + F.col("upto")).where(F.col("stop") <= F.col("quota"))
    blocked = inside.withColumn("block", F.expr(
        "least(blocks - 1, cast(floor((stop - tokens) * (blocks / quota)) as bigint))"))
    return blocked.withColumn("position", F.row_number().over(
        Window.partitionBy("block").orderBy("order", "doc_id", "row", "source"))).select(
        "doc_id", "row", "source", "n_rows", "copy", "tokens", "block", "position")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows to read; options as for ``weights``."""
    mixed = units(docs)
    return realise(mixed, weights(mixed, **options))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as the mix reads it, with their columns, whatever their names.
    A task writes whole blocks, each in its order, so that who reads the files one after another reads the mix."""
    read = mix(docs, **options).select("doc_id", F.col("row").alias("digest"), "source", "block", "position")
    rows = docs.select(row_of(docs), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("digest"))
    joined = rows.alias("d").join(read.alias("t"), (
        F.col("d.row.doc_id").cast("long").eqNullSafe(F.col("t.doc_id")) & (F.col("d.digest") == F.col("t.digest"))
        & F.col("d.row.source").cast("string").eqNullSafe(F.col("t.source")))).select("d.row", "t.block", "t.position")
    return joined.repartition("block").sortWithinPartitions("block", "position").select("row.*")
