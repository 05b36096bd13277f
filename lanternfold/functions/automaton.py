"""Many phrases in one pass over each text: an Aho-Corasick automaton made of a table of rules.

Two ways to read a phrase, the same as for the few phrases of a rule pack:
``name``: its words in this order with any run of spaces and hyphens between, between word edges, in any case;
``phrase``: its words of a-z and 0-9, whatever stands between, the last word may take an s.
Both come down to one prepared text in which every phrase is a plain substring.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

_GAP = re.compile(r"[\s-]+")
_WORDS = re.compile(r"[a-z0-9]+")


def _folded(c: str) -> str:
    up = c.upper()
    return (up if len(up) == 1 else c).lower()[0]


class _Fold(dict):
    """Case folding character by character, so that positions stay."""

    def __missing__(self, key: int) -> str:
        self[key] = _folded(chr(key))
        return self[key]


_FOLD = _Fold()


def _word(c: str) -> bool:
    return c == "_" or unicodedata.category(c)[0] in "LN"


def prepared(text: str, style: str) -> str:
    if style == "name":
        return _GAP.sub(" ", text).translate(_FOLD)
    return " " + " ".join(_WORDS.findall(text.lower())) + " "


def needles(phrase: str, style: str) -> list[str]:
    """The substrings that stand for a phrase; none for a phrase without words."""
    if style == "name":
        found = _GAP.sub(" ", phrase).translate(_FOLD)
        return [found] if found else []
    words = " ".join(_WORDS.findall(phrase.lower()))
    return [f" {words} ", f" {words}s "] if words else []


class Automaton:
    """``rules`` are (rule, phrase) pairs, read once; rules may share phrases. Beside the automaton nothing is
    kept of them but one tuple for each set of rules that share a phrase."""

    def __init__(self, rules: Iterable[tuple[str, str]], style: str = "name"):
        import ahocorasick

        if style not in ("name", "phrase"):
            raise ValueError(f"no style {style!r}")
        self.style = style
        self.found = ahocorasick.Automaton()
        kept: dict[tuple, tuple] = {}
        for rule, phrase in rules:
            for needle in needles(phrase, style):
                _, named = self.found.get(needle, (0, ()))
                if rule not in named:
                    value = (len(needle), tuple(sorted({*named, rule})))
                    self.found.add_word(needle, kept.setdefault(value, value))
        if len(self.found):
            self.found.make_automaton()

    def rules_in(self, text: str | None) -> list[str]:
        """The rules with a phrase in the text, each once, sorted."""
        if not text or not len(self.found):
            return []
        at = prepared(text, self.style)
        seen: set[str] = set()
        for last, (size, rules) in self.found.iter(at):
            if not seen.issuperset(rules) and (self.style == "phrase" or self._edges(at, last + 1 - size, last + 1)):
                seen.update(rules)
        return sorted(seen)

    @staticmethod
    def _edges(text: str, start: int, stop: int) -> bool:
        """Whether no word goes on before or behind a match."""
        return not (start > 0 and _word(text[start - 1])) and not (stop < len(text) and _word(text[stop]))
