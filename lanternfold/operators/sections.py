"""Pages -> title, lines, sections. One row per page all the way: nothing is shuffled."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfold.functions.arrays import at, let
from lanternfold.functions.html import parse_page
from lanternfold.functions.memo import per_session
from lanternfold.functions.text import strip
from lanternfold.operators.facts import is_heading, pair_tagged, tag_lines
from lanternfold.rules import FUNDS, UNKNOWN_SCHEME, RulePack

OVERVIEW = "Overview"


def fetch_columns(pages: DataFrame, fetched_at: str) -> DataFrame:
    """Raw pages -> documents: title, cleaned text, marked lines and one fetch stamp."""
    parsed = pages.withColumn("_page", parse_page(F.col("html")))
    return parsed.select(
        *[c for c in pages.columns if c != "html"],
        F.col("_page.title").alias("title"),
        F.array_join("_page.plain", "\n").alias("text"),
        F.col("_page.marked").alias("marked"),
        F.lit(fetched_at).alias("fetched_at"),
    )


def scheme_of(url: Column, pack: RulePack = FUNDS) -> Column:
    """Scheme of a page address, by a constant map from the pack."""
    if not pack.url_schemes:
        return F.lit(UNKNOWN_SCHEME)
    pairs = {u.rstrip("/"): s for u, s in pack.url_schemes.items()}
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])
    return F.coalesce(table[F.rtrim(url, F.lit("/"))], F.lit(UNKNOWN_SCHEME))


def assemble_sections(lines: Column) -> Column:
    """Lines -> ``array<struct<heading, lines>>``; a heading without lines disappears."""
    marks = F.filter(
        F.transform(lines, lambda x, i: F.when(is_heading(x), i)), lambda i: i.isNotNull()
    )

    def cut(starts: Column) -> Column:
        return F.transform(starts, lambda s, j: let(
            F.coalesce(at(starts, j + 1), F.size(lines)) - s - 1,
            lambda n: F.struct(
                F.when(s < 0, F.lit(OVERVIEW))
                .otherwise(strip(F.substr(at(lines, s), F.lit(4)))).alias("heading"),
                F.slice(lines, s + 2, n).alias("lines"),
            ),
        ))

    sections = let(F.concat(F.array(F.lit(-1)), marks), cut)
    return F.filter(sections, lambda s: F.size(s["lines"]) > 0)


@per_session
def _sections(pack: RulePack) -> Column:
    return let(tag_lines(F.col("marked"), pack), lambda tagged: let(pair_tagged(tagged), assemble_sections))


def to_sections(documents: DataFrame, pack: RulePack = FUNDS) -> DataFrame:
    """Adds ``sections`` (and ``scheme`` unless the input already carries one)."""
    out = documents.withColumn("sections", _sections(pack)).drop("marked")
    if "scheme" not in out.columns:
        out = out.withColumn("scheme", scheme_of(F.col("url"), pack))
    return out
