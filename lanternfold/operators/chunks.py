"""Sections -> chunks and drops, as folds over each page's own arrays.

The greedy packer resets on its own running total, so it cannot be a window sum.
It is a fold that carries only block start positions and one counter; the lines
themselves are sliced once afterwards, which keeps the work linear in the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfold import rules
from lanternfold.functions.arrays import at, let, unnest
from lanternfold.functions.memo import per_session
from lanternfold.functions.text import (
    joined_words, line_words, split_sentences, strip,
)
from lanternfold.operators.sections import OVERVIEW
from lanternfold.rules import FUNDS, RulePack

CLOSED = -1  # running total of a block that takes no further line


def block_starts(counts: Column) -> Column:
    """Greedy packing on word counts -> index of each block's first line."""

    def step(acc: Column, w: Column) -> Column:
        long_line = w > rules.MAX_WORDS
        fresh = long_line | (acc["words"] == CLOSED) | (acc["words"] + w > rules.TARGET_WORDS)
        return F.struct(
            F.when(fresh, F.concat(acc["starts"], F.array(acc["next"])))
            .otherwise(acc["starts"]).alias("starts"),
            F.when(long_line, F.lit(CLOSED)).when(fresh, w).otherwise(acc["words"] + w).alias("words"),
            (acc["next"] + 1).alias("next"),
        )

    zero = F.struct(
        F.array().cast("array<int>").alias("starts"),
        F.lit(CLOSED).alias("words"),
        F.lit(0).alias("next"),
    )
    return F.aggregate(counts, zero, step, lambda acc: acc["starts"])


def _open_long_line(block: Column) -> Column:
    """An over-long line becomes its sentences, unless one of those is over-long too."""
    pieces = split_sentences(at(block, F.lit(0)))
    return F.when(
        (F.size(block) == 1) & (line_words(at(block, F.lit(0))) > rules.MAX_WORDS),
        let(pieces, lambda p: F.when(
            F.forall(p, lambda x: line_words(x) <= rules.MAX_WORDS), p).otherwise(block)),
    ).otherwise(block)


def pack_lines(lines: Column) -> Column:
    """``array<string>`` -> ``array<array<string>>`` of about TARGET_WORDS words each."""
    starts = block_starts(F.transform(lines, line_words))
    return let(starts, lambda s: F.transform(s, lambda first, j: _open_long_line(
        F.slice(lines, first + 1, F.coalesce(at(s, j + 1), F.size(lines)) - first))))


def overlap_tail(block: Column, overlap: int = rules.OVERLAP_WORDS) -> Column:
    """Whole lines from the end of a block, fewer than ``overlap`` words in total.

    The last line is always looked at; reaching ``overlap`` costs the earliest line.
    A line has a word at least, so only the last ``overlap + 1`` lines can matter.
    """
    last = F.slice(F.reverse(block), 1, overlap + 1)

    def step(acc: Column, line: Column) -> Column:
        w = line_words(line)
        stop = acc["done"] | ((acc["words"] + w > overlap) & (acc["lines"] > 0))
        return F.struct(
            F.when(stop, acc["lines"]).otherwise(acc["lines"] + 1).alias("lines"),
            F.when(stop, acc["words"]).otherwise(acc["words"] + w).alias("words"),
            stop.alias("done"),
        )

    zero = F.struct(F.lit(0).alias("lines"), F.lit(0).alias("words"), F.lit(False).alias("done"))
    kept = F.aggregate(last, zero, step, lambda acc: F.when(
        acc["words"] < overlap, acc["lines"]).otherwise(acc["lines"] - 1))
    return let(kept, lambda n: F.when(n > 0, F.slice(block, F.size(block) - n + 1, n))
               .otherwise(F.array().cast("array<string>")))


def section_blocks(lines: Column) -> Column:
    """One block for a section that fits, else packed blocks with overlap."""
    total = F.aggregate(F.transform(lines, line_words), F.lit(0), lambda a, w: a + w)
    with_overlap = let(pack_lines(lines), lambda blocks: F.transform(blocks, lambda b, j: F.when(
        j > 0, F.concat(overlap_tail(at(blocks, j - 1)), b)).otherwise(b)))
    return F.when(total <= rules.MAX_WORDS, F.array(lines)).otherwise(with_overlap)


def is_stop_phrase(text: Column, pack: RulePack = FUNDS) -> Column:
    """Navigation chrome, or one word said again and again. ``text``: collapsed lines."""
    flat = F.btrim(F.replace(F.lower(text), F.lit("\n"), F.lit(" ")), F.lit(" .:|"))
    return let(flat, lambda t: t.isin(*pack.stop_phrases) | t.rlike(r"\A([^ ]+)(?: \1)+\z"))


def drop_reason(heading: Column, text: Column, body: Column, min_words: int, pack: RulePack) -> Column:
    stop = is_stop_phrase(body, pack) | ((heading != OVERVIEW) & is_stop_phrase(text, pack))
    short = (joined_words(text) < min_words) & ~F.lower(strip(heading)).isin(*pack.fact_headings)
    return F.when(stop, F.lit("boilerplate")).when(short, F.lit(f"under {min_words} words"))


@per_session
def _blocks(pack: RulePack, min_words: int) -> Column:
    def candidates(section: Column) -> Column:
        def candidate(block: Column) -> Column:
            body = strip(F.array_join(block, "\n"))
            heading = F.when(section["heading"] == "", F.lit(OVERVIEW)).otherwise(section["heading"])

            def judged(b: Column) -> Column:
                text = F.when(heading != OVERVIEW, F.concat(heading, F.lit("\n"), b)).otherwise(b)
                return let(text, lambda t: F.struct(
                    heading.alias("heading"), b.alias("body"), t.alias("text"),
                    drop_reason(heading, t, b, min_words, pack).alias("reason")))

            return let(body, judged)
        return F.transform(section_blocks(section["lines"]), candidate)

    return F.flatten(F.transform("sections", candidates))


def chunk_pages(sections: DataFrame, pack: RulePack = FUNDS, min_words: int = rules.MIN_WORDS) -> DataFrame:
    """Adds ``blocks``: every candidate chunk of the page with its drop reason (NULL = kept)."""
    return sections.withColumn("blocks", _blocks(pack, min_words))


@per_session
def _reasons(pack: RulePack, min_words: int) -> Column:
    def candidates(section: Column) -> Column:
        heading = F.when(section["heading"] == "", F.lit(OVERVIEW)).otherwise(section["heading"])

        def reason(block: Column) -> Column:
            def judged(b: Column) -> Column:
                return drop_reason(heading, F.when(heading != OVERVIEW, F.concat(heading, F.lit("\n"), b)).otherwise(b), b, min_words, pack)
            return let(strip(F.array_join(block, "\n")), judged)
        return F.transform(section_blocks(section["lines"]), reason)

    return F.flatten(F.transform("sections", candidates))


def candidate_reasons(sections: DataFrame, pack: RulePack = FUNDS, min_words: int = rules.MIN_WORDS) -> DataFrame:
    """``reasons`` of a page's candidate chunks (NULL = kept), without their texts."""
    return sections.select(_reasons(pack, min_words).alias("reasons"))


def chunk_id(url: Column, index: Column) -> Column:
    return F.substr(F.sha1(F.concat(url, F.lit("#"), index.cast("string"))), F.lit(1), F.lit(16))


def kept_chunks(chunked: DataFrame) -> DataFrame:
    """One row per kept chunk; the index counts kept chunks only."""
    carried = [c for c in ("page_no", "url", "title", "scheme", "fetched_at", "first") if c in chunked.columns]
    kept = F.filter("blocks", lambda b: b["reason"].isNull())
    return (
        unnest(chunked, kept, "chunk_index", "b", *carried)
        .select(
            chunk_id(F.col("url"), F.col("chunk_index")).alias("id"),
            *carried,
            F.col("b.heading").alias("heading"),
            "chunk_index",
            F.col("b.text").alias("text"),
            joined_words(F.col("b.text")).alias("word_count"),
        )
    )


def dropped_chunks(chunked: DataFrame) -> DataFrame:
    gone = F.filter("blocks", lambda b: b["reason"].isNotNull())
    return unnest(chunked, gone, "drop_no", "b", "url").select(
        "url", "drop_no",
        F.col("b.reason").alias("reason"),
        F.substr(F.col("b.body"), F.lit(1), F.lit(120)).alias("text"),
    )


def page_counts(chunked: DataFrame) -> DataFrame:
    """Sections, kept and dropped per page, without exploding anything."""
    kept = F.size(F.filter("blocks", lambda b: b["reason"].isNull()))
    return chunked.select(
        "url",
        F.size("sections").alias("sections"),
        kept.alias("chunks"),
        (F.size("blocks") - kept).alias("dropped"),
    )


def empty_pages(chunked: DataFrame) -> DataFrame:
    """Pages that were read but gave no chunk."""
    return page_counts(chunked).filter(F.col("chunks") == 0).select("url")
