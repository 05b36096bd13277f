"""Label / value pairing on the lines of a page.

A label line never counts as a value or a qualifier, so a line is consumed by at
most one label above it. Pairing is therefore a look at two neighbours on each
side, written over the page's own line array: no shuffle, no ordering column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanternfold import rules
from lanternfold.functions.arrays import at, let
from lanternfold.functions.text import SPACE, strip, word_count
from lanternfold.rules import FUNDS, RulePack

# What a figure, a placeholder and a bare date look like on a card.
NUMERIC_VALUE = (
    rf"(?iu)^(?:[₹$€£][{SPACE}]*)?[\p{{Nd}}][\p{{Nd}},.]*%?[{SPACE}]*(?:cr\.?|lakh|cr)?\z"
    r"|^\p{Nd}{1,2}[/-]\p{Nd}{1,2}[/-]\p{Nd}{2,4}\z"
    r"|^n/?a\z|^nil\z|^none\z|^not applicable\z"
)
AS_ON_DATE = r"^\(?\p{Nd}{1,2}[/-]\p{Nd}{1,2}[/-]\p{Nd}{2,4}\)?\z"


def is_heading(line: Column) -> Column:
    return F.startswith(line, F.lit("## "))


def is_label(line: Column, pack: RulePack = FUNDS) -> Column:
    return F.rtrim(F.lower(strip(line)), F.lit(":")).isin(*pack.label_lines)


def looks_like_value(line: Column, pack: RulePack = FUNDS) -> Column:
    """Short, unpunctuated and not chrome. A bare date passes; see ``is_value``."""
    text = strip(line)
    return (
        (F.length(text) <= rules.MAX_VALUE_CHARS)
        & (line != "")
        & ~is_heading(line)
        & (word_count(text) <= rules.MAX_VALUE_WORDS)
        & ~F.lower(text).isin(*pack.not_values)
        & ~is_label(text, pack)
        & (~text.rlike(r"[.:;]\z") | text.rlike(NUMERIC_VALUE))
    )


def is_bare_date(line: Column) -> Column:
    return (F.length(strip(line)) <= rules.MAX_VALUE_CHARS) & strip(line).rlike(AS_ON_DATE)


def is_value(line: Column, dated: Column, pack: RulePack = FUNDS) -> Column:
    """``dated``: the label above is an inception date, so a bare date is its value."""
    return looks_like_value(line, pack) & (dated | ~is_bare_date(line))


def is_qualifier(line: Column, pack: RulePack = FUNDS) -> Column:
    """A short lower-case continuation of a label that is not itself a value."""
    return _can_qualify(line) & ~is_label(line, pack) & ~is_value(line, F.lit(False), pack)


def _can_qualify(line: Column) -> Column:
    return (
        (F.length(line) <= rules.MAX_QUALIFIER_CHARS)
        & line.rlike(r"^\p{Ll}")
        & (word_count(line) <= rules.MAX_QUALIFIER_WORDS)
    )


def tag_lines(lines: Column, pack: RulePack = FUNDS) -> Column:
    """``array<struct>``: each line with its label / value / qualifier flags."""

    def tag(x: Column) -> Column:
        looks = F.struct(x.alias("line"), is_label(x, pack).alias("label"), looks_like_value(x, pack).alias("fits"))

        def finish(s: Column) -> Column:
            value = s["fits"] & ~is_bare_date(s["line"])
            return F.struct(
                s["line"].alias("line"),
                s["label"].alias("label"),
                (s["label"] & F.contains(F.lower(s["line"]), F.lit("inception"))).alias("dated"),
                value.alias("value"),
                s["fits"].alias("dated_value"),
                (~s["label"] & _can_qualify(s["line"]) & ~value).alias("qualifier"),
            )

        return let(looks, finish)

    return F.transform(lines, tag)


def _yes(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def pair_tagged(tagged: Column) -> Column:
    """Lines with every label joined to its qualifier and value."""

    def value_for(label: Column, candidate: Column) -> Column:
        return _yes(F.when(label["dated"], candidate["dated_value"]).otherwise(candidate["value"]))

    def join_up(row: Column, i: Column) -> Column:
        one, two = at(tagged, i + 1), at(tagged, i + 2)
        before, two_before = at(tagged, i - 1), at(tagged, i - 2)
        qualified = _yes(one["qualifier"])
        built = (
            F.when(qualified & value_for(row, two),
                   F.concat(row["line"], F.lit(" "), one["line"], F.lit(": "), two["line"]))
            .when(qualified, F.concat(row["line"], F.lit(" "), one["line"]))
            .when(value_for(row, one), F.concat(row["line"], F.lit(": "), one["line"]))
            .otherwise(row["line"])
        )
        consumed = (
            _yes(before["label"]) & (_yes(row["qualifier"]) | value_for(before, row))
        ) | (
            _yes(two_before["label"]) & _yes(before["qualifier"]) & value_for(two_before, row)
        )
        return F.when(row["label"], built).when(consumed, F.lit(None)).otherwise(row["line"])

    return F.filter(F.transform(tagged, join_up), lambda x: x.isNotNull())
