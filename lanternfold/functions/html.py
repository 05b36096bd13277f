"""HTML page -> title and text lines: the one step that needs a parser, so the one Python UDF.

Everything after it (pairing, sectioning, chunking) is array expressions in the JVM.
"""

from __future__ import annotations

import html as entities
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternfold.rules import NOISE_MARKERS, NOISE_TAGS

_TOKEN = re.compile(
    r"[^<]++|</?[a-zA-Z][^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+>"
    r"|</?[a-zA-Z][^>]*+>|<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<",
    re.S,
)
_NAME = re.compile(r"</?([^\s/>]+)")
_MARKED = re.compile(r"""(?:^|[\s"'/])(class|id)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
# Elements whose content is not markup; for the last two it is still text.
_RAW_END = {t: re.compile(rf"</{t}\b", re.I) for t in ("script", "style", "iframe", "title", "textarea")}
_TEXT_ONLY = frozenset(("title", "textarea"))
_VOID = frozenset("area base br col embed hr img input link meta param".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4"))
_SIDE_TEXT = frozenset(("rt", "rp", "template"))  # ruby and template text is not page text
_ENDS_P = frozenset(
    "p div ul ol dl table form hr pre center address fieldset h1 h2 h3 h4 h5 h6".split()
)
# Open element -> start tags that close it when it is innermost.
_CLOSED_BY = {
    "p": _ENDS_P,
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
    "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "head": {"body"},
    **{f"h{i}": {f"h{j}" for j in range(1, 7)} for i in range(1, 7)},
}
# An end tag does not close through an element that binds tighter.
_BINDING = {"p": 10, "div": 150, "td": 160, "th": 160, "tr": 170, "tbody": 180, "thead": 180,
            "tfoot": 180, "table": 190, "head": 200, "body": 200, "html": 220}


def _is_marked(tag: str) -> bool:
    found: dict[str, str] = {}
    for name, value in _MARKED.findall(tag):
        found.setdefault(name.lower(), entities.unescape(value.strip("\"'")))
    text = f"{found.get('class', '')} {found.get('id', '')}".lower()
    return any(marker in text for marker in NOISE_MARKERS)


def read_page(page: str) -> tuple[str, list[str], list[str]]:
    """Return (title, plain lines, lines with headings written as ``## text``)."""
    stack: list[str] = []
    mute = side = None  # stack depth at which a noise / side-text subtree began
    pending: list[str] = []
    plain: list[str] = []
    marked: list[str] = []
    heading: tuple[int, list[str]] | None = None
    title: tuple[int, list[str]] | None = None
    title_parts: list[str] | None = None
    h1: tuple[int, list[str]] | None = None
    h1_parts: list[str] | None = None

    def flush() -> None:
        if not pending:
            return
        text = entities.unescape("".join(pending))
        pending.clear()
        if not text or mute is not None:
            return
        if title is not None:
            title[1].append(text)
        if side is not None:
            return
        lines = [line for raw in text.splitlines() if (line := " ".join(raw.split()))]
        plain.extend(lines)
        if h1 is not None:
            h1[1].append(text.strip())
        if heading is not None:
            heading[1].extend(lines)
        else:
            marked.extend(lines)

    def close_to(depth: int) -> None:
        nonlocal mute, side, heading, title, title_parts, h1, h1_parts
        del stack[depth:]
        if mute is not None and depth <= mute:
            mute = None
        if side is not None and depth <= side:
            side = None
        if title is not None and depth <= title[0]:
            title_parts, title = title[1], None
        if h1 is not None and depth <= h1[0]:
            h1_parts, h1 = h1[1], None
        if heading is not None and depth <= heading[0]:
            if heading[1]:
                marked.append("## " + " ".join(heading[1]))
            heading = None

    pos = 0
    while (token := _TOKEN.match(page, pos)) is not None:
        text = token.group()
        pos = token.end()
        if text[0] != "<" or text == "<":
            pending.append(text)
            continue
        if text[1] in "!?":
            flush()
            continue
        name = _NAME.match(text).group(1).lower()
        if text[1] == "/":
            if name not in stack:
                continue
            depth = len(stack) - 1 - stack[::-1].index(name)
            bond = _BINDING.get(name, 100)
            if any(_BINDING.get(inner, 100) > bond for inner in stack[depth + 1:]):
                continue
            flush()
            close_to(depth)
            continue
        flush()
        while stack and name in _CLOSED_BY.get(stack[-1], ()):
            close_to(len(stack) - 1)
        raw = ""
        if name in _RAW_END and not text.endswith("/>"):
            end = _RAW_END[name].search(page, pos)
            stop = end.start() if end else len(page)
            raw, pos = page[pos:stop], stop
        if name in _VOID or text.endswith("/>"):
            continue
        depth = len(stack)
        stack.append(name)
        if mute is not None:
            continue
        if name in NOISE_TAGS or ("=" in text and _is_marked(text)):
            mute = depth
        elif name in _SIDE_TEXT:
            side = depth if side is None else side
        elif name in _HEADINGS:
            heading = heading or (depth, [])
            if name == "h1" and h1 is None and h1_parts is None:
                h1 = (depth, [])
        elif name == "title" and title is None and title_parts is None:
            title = (depth, [])
        if name in _TEXT_ONLY:
            pending.append(raw)
    flush()
    close_to(0)

    name = title_parts[0].strip() if title_parts and len(title_parts) == 1 else ""
    return name or "".join(h1_parts or []), plain, marked


PAGE_TYPE = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("plain", T.ArrayType(T.StringType())),
    T.StructField("marked", T.ArrayType(T.StringType())),
])


@F.pandas_udf(PAGE_TYPE)
def _parse(pages: pd.Series) -> pd.DataFrame:
    rows = [read_page(page) if page is not None else ("", [], []) for page in pages]
    return pd.DataFrame(rows, columns=["title", "plain", "marked"])


# Parsing dominates an ingest. Declared this way, a filter on a parsed column is
# applied to the result instead of being pushed down with a second parse.
_read_pages = _parse.asNondeterministic()


def parse_page(html: Column) -> Column:
    """``struct<title, plain, marked>`` of one page."""
    return _read_pages(html)
