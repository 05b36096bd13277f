"""Text expressions. All run inside the JVM; none needs Python at run time.

Python text rules (Unicode whitespace, digits and word characters) are spelled
out as explicit classes, so results do not depend on the JVM's defaults.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters str.split() / str.splitlines() separate on.
SPACE = r"\p{IsWhite_Space}\x{1c}-\x{1f}"
SPACE_CHARS = "".join(map(chr, (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
LINE_BREAK = r"\r\n|[\n\x0b\f\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
WORD = r"\p{L}\p{N}_"
EDGE = rf"(?:(?<![{WORD}])(?=[{WORD}])|(?<=[{WORD}])(?![{WORD}]))"
EDGE_BEFORE = rf"(?<![{WORD}])"
EDGE_AFTER = rf"(?![{WORD}])"


def java_regex(pattern: str, ignore_case: bool = False, any_edge: bool = False) -> str:
    """Rewrite a Python ``str`` pattern so Java reads \\b \\s \\d \\w as Python does.

    A \\b that opens the pattern, a group or an alternative stands before a word
    character and any other one behind it, so one look-around is enough.
    ``any_edge`` is for patterns where that does not hold.
    """
    out = []
    in_class = False
    i = 0
    while i < len(pattern):
        pair = pattern[i:i + 2]
        if pair == r"\b":
            opens = i == 0 or pattern[i - 1] in "(|:"
            out.append(EDGE if any_edge else EDGE_BEFORE if opens else EDGE_AFTER)
        elif pair == r"\s":
            out.append(SPACE if in_class else f"[{SPACE}]")
        elif pair == r"\d":
            out.append(r"\p{Nd}")
        elif pair == r"\w":
            out.append(WORD if in_class else f"[{WORD}]")
        elif pair == r"\S":
            out.append(f"[^{SPACE}]")
        elif pair.startswith("\\"):
            out.append(pair)
        else:
            if pattern[i] == "[":
                in_class = True
            elif pattern[i] == "]":
                in_class = False
            out.append(pattern[i])
            i += 1
            continue
        i += 2
    return ("(?iu)" if ignore_case else "") + "".join(out)


def any_of(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def name_regex(name: str) -> str:
    """A multi-word name, with any run of spaces or hyphens between its words."""
    words = [re.escape(w) for w in re.split(r"[\s-]+", name)]
    return r"\b" + r"[\s-]+".join(words) + r"\b"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def collapse(c: Column) -> Column:
    """Trim, and turn every whitespace run into one blank."""
    return F.btrim(F.regexp_replace(c, rf"[{SPACE}]+", " "), F.lit(" "))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(rf"[^{SPACE}]+"))


def line_words(c: Column) -> Column:
    """Word count of an already collapsed, non-empty line: its blanks and one."""
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1


def joined_words(c: Column) -> Column:
    """Word count of collapsed lines joined by line feeds."""
    return line_words(F.replace(c, F.lit("\n"), F.lit(" ")))


def clean_lines(c: Column) -> Column:
    """Lines of a text, each collapsed, blank ones dropped."""
    return F.filter(F.transform(F.split(c, LINE_BREAK), collapse), lambda x: x != "")


def split_sentences(c: Column) -> Column:
    """Break before a capital or an opening bracket that follows . ! or ?"""
    parts = F.split(c, rf"(?<=[.!?])[{SPACE}]+(?=[A-Z(])")
    return F.filter(parts, lambda x: strip(x) != "")


def phrase_text(c: Column) -> Column:
    """Lower-cased ASCII words of a text, each between single blanks.

    One pass; every phrase test on it is then a plain substring search.
    """
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), F.lit(" "))


def has_phrase(prepared: Column, phrases) -> Column:
    """Whole-word match of any phrase on ``phrase_text``; the last word may take an s."""
    found = F.lit(False)
    for phrase in phrases:
        tokens = re.findall(r"[a-z0-9]+", phrase.lower())
        if tokens:
            needle = " " + " ".join(tokens)
            # most phrases are nowhere in a text, which one search tells
            found = found | (F.contains(prepared, F.lit(needle)) & (
                F.contains(prepared, F.lit(needle + " ")) | F.contains(prepared, F.lit(needle + "s "))))
    return found


def numbers(c: Column) -> Column:
    """Distinct figures of a text, compared on digits alone (grouping commas dropped)."""
    found = F.regexp_extract_all(c, F.lit(java_regex(r"\d[\d,]*(?:\.\d+)?")), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(""))))


def slug(url: Column) -> Column:
    bare = F.replace(F.replace(url, F.lit("https://www."), F.lit("")), F.lit("https://"), F.lit(""))
    flat = F.regexp_replace(F.regexp_replace(bare, r"\A/+|/+\z", ""), "/", "_")
    return F.when(flat == "", F.lit("home")).otherwise(flat)


def match_spans(c: Column, pattern: str) -> Column:
    """All matches as ``array<struct<gap, text>>``: gap = characters since the last match.

    Splitting on a pattern and extracting it walk the text the same way, so the
    pieces between matches give the offsets the regex functions do not return.
    """
    gaps = F.split(c, pattern, -1)
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("text")))
    return F.filter(pairs, lambda p: p["text"].isNotNull())
