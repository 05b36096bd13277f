"""Main text of web pages by wrapper induction.

Pages of one host share a template. One page per host (the one nearest a usual length)
serves as the host's pattern, and every page's tree is aligned with it by simple tree
matching. Nodes of the pattern are slots; so are the paths of tags and labels of all pages, by
which the pattern grows by what its page lacks. A content that a slot has on most of the host's
pages, or one of few that it has in turn, is template; any other content of the slot is
kept. Pages that agree in nearly all of their text count as one, so neither copies nor near
copies of a page make anything look constant; texts of a few words that most pages of the host share
do not count for that, so that menus do not make near copies of short stories. A page is aligned
once: what it holds is kept, and which of it is template follows by a join.

A page's text is what its content slots and unaligned nodes hold, within its article elements
where they hold two thirds of it, else within main where that holds text and no less than the
articles, else anywhere; without what names itself as menu, header, footer,
sidebar, notice, advert, form, script, style or comments, by its element or by a whole token
of its class, id or role; of an article's header the headings stay, and a paragraph of an article goes only
for tokens that name an advert, a comment or the like. Such a token never cuts the page, its body, main, headings, or what
holds most of the page's text: on most of the host's pages that have a node of that path,
or, where they are few, on the page itself if no article or main stands beside it. Blocks are the texts between
block elements, in page order: character references decoded, white space turned into one
space, empty ones left out, joined by an empty line.

Null and empty pages have an empty text. Pages without a host in their address form one
group, as does a null address. Repeated rows give repeated results; an empty table an
empty one. Only page_id, url and html are read. Hosts with more than a task's share of the
pages (fewer than there are partitions) are dealt to several tasks, with a copy of their
pattern each; statistics are partial sums. Nothing is kept per host but its pattern and its
constant contents, each of them on at least a hundredth of its pages.
"""

from __future__ import annotations

import gc
import re
from contextlib import contextmanager
from html import unescape
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfold.llm.common import release, stage

USUAL = 6_000  # characters of html; the page nearest to it is the host's pattern
FEW_PAGES, MOST = 5, 0.5  # a content is constant from so many pages on, on this share of the host's
IN_TURN, VALUES = 20, 0.1  # or in a slot with so many pages and at most this many contents per page,
RECURS = 0.01  # if it is on 1 / VALUES pages and on this share of the host's
ARTICLE_PAGES, ARTICLE_MOST = 20, 0.8  # within an article
SCOPE = 2 / 3  # share of a page's varying text in its articles from which on nothing else is its text
FEW_WORDS = 12  # a shorter text that most pages of a host share does not make them near copies
BANDS, PICKS = 8, 12  # pages with one equal band count as one: likely from nine tenths of their text on

_TOKEN = re.compile(
    # possessive: a tag that does not end is told in one pass over what is left of the page
    r"[^<]++|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<!--.*?(?:-->|\Z)|<[!?/][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<", re.S)
_BEGUN = re.compile(r"<[a-zA-Z/!?]")
_CLASS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noscript xmp".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table "
    "tbody td tfoot th thead tr ul".split())
_INLINE_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
                "th": ("td", "th"), "option": ("option",)}
_HOLDS = frozenset("ul ol dl table body html article section div".split())  # an implied end looks no further up
_OUT_TAGS = frozenset("nav header footer aside form script style noscript template iframe button select textarea head "
                      "svg canvas object menu dialog".split())
_NEVER_MARKED = frozenset("#root html body main h1 h2 h3 h4 h5 h6".split())
_OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb "
    "breadcrumbs header footer sidebar aside cookie cookies consent notice notices alert popup modal newsletter subscribe "
    "comment comments reply replies disqus share sharing social related recommended widget form login signup search "
    "complementary contentinfo".split())


# In an article's paragraph these say what it is about, not what it is.
_IN_ARTICLE = frozenset("header footer search form login signup alert menu navigation notice notices sharing social related".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Node:
    __slots__ = ("tag", "label", "out", "marked", "children", "nodes", "own")

    def __init__(self, tag: str, label: str = "", out: bool = False, marked: bool = False):
        self.tag, self.label, self.out, self.marked = tag, label, out, marked
        self.children: list = []  # texts and nodes
        self.nodes: list[Node] = []
        self.own: str | None = None  # text, once asked for


@contextmanager
def _uncollected():
    """Trees have no cycles: a search for some among their nodes, every few hundred of them, finds nothing."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class _Remembered(dict):
    """What a function tells of a bounded number of keys. Tasks begin with none."""

    MOST = 16_384

    def __init__(self, tell):
        super().__init__()
        self.tell = tell

    def __missing__(self, key):
        if len(self) >= self.MOST:
            self.clear()
        told = self[key] = self.tell(key)
        return told

    def __reduce__(self):
        return _Remembered, (self.tell,)


def _named(attributes: str) -> tuple[str, frozenset[str]]:
    """Class, id and role in lower case, and the words of them that name something else than text."""
    marks = " ".join(v.strip("\"'") for v in _CLASS.findall(attributes)).lower()
    return marks, _OUT_WORDS.intersection(marks.split())


_SHORT = 200  # characters of attributes that are remembered
_NAMED = _Remembered(_named)


def parse(html: str) -> Node:
    """The tree of a page; tags left open end where their parents or the next block does."""
    root = Node("#root")
    stack = [root]
    articles: list[tuple[int, Node]] = []  # open ones, with their depth
    at, size = 0, len(html)
    last = html.rfind(">") + 1  # no tag ends behind it
    while at < size:
        if at >= last:
            unfinished = _BEGUN.search(html, at)
            stack[-1].children.append(html[at : unfinished.start()] if unfinished else html[at:])
            break
        if html[at] != "<":
            stop = html.find("<", at)
            stop = size if stop < 0 else stop
            stack[-1].children.append(html[at:stop])
            at = stop
            continue
        m = _TOKEN.match(html, at)
        at = m.end()
        closing, name, attributes, late_closing, late_name, late_attributes = m.groups()
        name = name or late_name
        if not name:
            if m.group() == "<":
                stack[-1].children.append("<")
            continue
        tag = name.lower()
        if closing or late_closing:
            if stack[-1].tag == tag:
                stack.pop()
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag.lstrip("#") == tag:
                    del stack[i:]
                    break
            continue
        if tag in _BLOCKS and len(stack) > 1:  # a block ends an open paragraph
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in _BLOCKS:
                    break
        for i in range(len(stack) - 1, 0, -1) if tag in _INLINE_ENDS else ():
            if stack[i].tag in _INLINE_ENDS[tag]:
                del stack[i:]
                break
            if stack[i].tag in _HOLDS:
                break
        attributes = attributes or late_attributes or ""
        if "=" not in attributes:
            marks, told = "", ()
        else:
            marks, told = _NAMED[attributes] if len(attributes) <= _SHORT else _named(attributes)
        while articles and (len(stack) <= articles[-1][0] or stack[articles[-1][0]] is not articles[-1][1]):
            articles.pop()
        marked = bool(told) and tag not in _NEVER_MARKED and not (tag == "p" and articles and told <= _IN_ARTICLE)
        node = Node(tag, marks, tag in _OUT_TAGS, marked)
        stack[-1].children.append(node)
        stack[-1].nodes.append(node)
        if tag in _RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
            stop = end.start() if end else size
            node.children.append(html[at:stop])
            at = html.find(">", stop) + 1 if end else size
            at = at or size
        elif tag not in _VOID and not attributes.endswith("/"):
            if tag == "article":
                articles.append((len(stack), node))
            elif tag == "header" and articles:
                node.tag = "#header"  # of an article: its headings are text
            stack.append(node)
    return root


def own_text(node: Node) -> str:
    """A node's text without that of nodes below it, white space made one space."""
    if node.own is None:
        if len(node.children) == len(node.nodes):
            node.own = ""
        else:
            node.own = " ".join(unescape(" ".join([c for c in node.children if isinstance(c, str)])).split())
    return node.own


class _Shapes:
    """Trees by their shape: nodes of equal tags, labels and children have one number, and scores
    of pairs of numbers are remembered."""

    REMEMBERED = 4_000_000  # gains of one list's shapes; more are computed again

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.kinds: list[tuple] = []
        self.below: list[tuple] = []
        self.sizes: list[int] = []
        self.scores: dict[tuple[int, int], int] = {}

    def of(self, root: Node) -> dict[int, int]:
        """Numbers of the nodes of a tree by their identity."""
        out, order = {}, [root]
        for node in order:
            order.extend(node.nodes)
        for node in reversed(order):
            below = tuple(out[id(c)] for c in node.nodes)
            kind = (node.tag, node.label)
            number = self.known.setdefault((kind, below), len(self.sizes))
            if number == len(self.sizes):
                self.kinds.append(kind)
                self.below.append(below)
                self.sizes.append(1 + sum(self.sizes[b] for b in below))
            out[id(node)] = number
        return out

    def gain(self, x: int, y: int) -> int | None:
        """The number of nodes matched in the best matching of two trees, None if it is still to be computed."""
        if x == y:
            return self.sizes[x]
        if self.kinds[x] != self.kinds[y]:
            return 0
        if not self.below[x] or not self.below[y]:
            return 1
        return self.scores.get((x, y))

    def score(self, x: int, y: int) -> int:
        todo = [(x, y)]
        while todo:
            x, y = todo[-1]
            if self.gain(x, y) is not None:
                todo.pop()
                continue
            xs, ys = self.below[x], self.below[y]
            head, tail = ends(xs, ys)
            middle = xs[head : len(xs) - tail], ys[head : len(ys) - tail]
            others = set(middle[1])
            missing = [(a, b) for a in set(middle[0]) for b in others if self.gain(a, b) is None]
            if missing:
                todo.extend(missing)
                continue
            same = sum(self.sizes[a] for a in xs[:head]) + sum(self.sizes[a] for a in xs[len(xs) - tail :])
            if len(middle[0]) * len(middle[1]) <= self.FEW:
                best = self._few_best(*middle)
            else:
                for row in self._rows(*middle):
                    pass
                best = int(row[-1])
            self.scores[x, y] = 1 + same + best
        return self.gain(x, y)

    def _gains(self, ys):
        """Of a shape, what it gains with each of ``ys``."""
        others, known = list(dict.fromkeys(ys)), {}
        places = {y: i for i, y in enumerate(others)}
        at = np.array([places[y] for y in ys], np.int64)

        def gains(x: int) -> np.ndarray:
            if x not in known:
                if len(known) * len(ys) > self.REMEMBERED:
                    known.clear()
                known[x] = np.array([self.gain(x, y) for y in others], np.int64)[at]
            return known[x]

        return gains

    @staticmethod
    def _next(row: np.ndarray, gains: np.ndarray) -> np.ndarray:
        best = row.copy()
        np.maximum(best[1:], row[:-1] + gains, out=best[1:])
        return np.maximum.accumulate(best, out=best)

    def _rows(self, xs, ys):
        """Rows of the table of best matchings of the first of ``xs`` with the first of ``ys``."""
        row = np.zeros(len(ys) + 1, np.int64)
        yield row
        if len(ys):
            gains = self._gains(ys)
            for x in xs:
                row = self._next(row, gains(x))
                yield row

    FEW = 64  # pairs of two short lists, whose table is made at once

    def _few_best(self, xs, ys) -> int:
        row = [0] * (len(ys) + 1)
        for x in xs:
            above, row = row, [0]
            for j, y in enumerate(ys):
                row.append(max(row[j], above[j + 1], above[j] + self.gain(x, y)))
        return row[-1]

    def _few(self, xs, ys) -> list[tuple[int, int]]:
        gains = [[self.gain(x, y) for y in ys] for x in xs]
        rows = [[0] * (len(ys) + 1)]
        for of in gains:
            above, row = rows[-1], [0]
            for j, gain in enumerate(of):
                row.append(max(row[j], above[j + 1], above[j] + gain))
            rows.append(row)
        out, i, j = [], len(xs), len(ys)
        while i and j:
            gain = gains[i - 1][j - 1]
            if gain and rows[i][j] == rows[i - 1][j - 1] + gain:
                i, j = i - 1, j - 1
                out.append((i, j))
            elif rows[i][j] == rows[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return out

    def pairs(self, xs, ys) -> list[tuple[int, int]]:
        """Places in two lists of trees that a best matching pairs. Some rows of the table are kept, the others made again."""
        if not len(xs) or not len(ys):
            return []
        if len(xs) == len(ys) == 1:
            return [(0, 0)] if self.gain(xs[0], ys[0]) else []
        if len(xs) * len(ys) <= self.FEW:
            return self._few(xs, ys)
        step, gains = max(64, isqrt(len(xs)) + 1), self._gains(ys)
        kept = [row for i, row in enumerate(self._rows(xs, ys)) if i % step == 0]
        out, i, j = [], len(xs), len(ys)
        while i and j:
            first = (i - 1) // step * step
            rows = [kept[first // step]]
            for x in xs[first:i]:
                rows.append(self._next(rows[-1], gains(x)))
            while i > first and j:
                row, above, gain = rows[i - first], rows[i - first - 1], gains(xs[i - 1])[j - 1]
                if gain and row[j] == above[j - 1] + gain:
                    i, j = i - 1, j - 1
                    out.append((i, j))
                elif row[j] == above[j]:
                    i -= 1
                else:
                    j -= 1
        return out


def ends(xs, ys) -> tuple[int, int]:
    """How many trees at the head and at the tail of two lists have equal shapes. They match each other
    in some best matching: no match counts more than that of a whole tree."""
    least = min(len(xs), len(ys))
    head = tail = 0
    while head < least and xs[head] == ys[head]:
        head += 1
    while tail < least - head and xs[-1 - tail] == ys[-1 - tail]:
        tail += 1
    return head, tail


def matching(a: Node, b: Node, known: tuple[_Shapes, dict[int, int]] | None = None) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching of two trees: the number of matched nodes and their pairs.
    ``known`` has shapes and their numbers of the first tree."""
    shapes = known[0] if known else _Shapes()
    first, second = known[1] if known else shapes.of(a), shapes.of(b)
    score = shapes.score(first[id(a)], second[id(b)])
    if not score:
        return 0, []
    out, todo = [], [(a, b)]
    while todo:
        a, b = todo.pop()
        out.append((a, b))
        xs, ys = a.nodes, b.nodes
        if not xs or not ys:
            continue
        if first[id(a)] == second[id(b)]:
            todo += zip(xs, ys, strict=True)
            continue
        mine, other = [first[id(x)] for x in xs], [second[id(y)] for y in ys]
        head, tail = ends(mine, other)
        todo += zip(xs[:head], ys[:head], strict=True)
        todo += zip(xs[len(xs) - tail :], ys[len(ys) - tail :], strict=True)
        if head + tail < min(len(xs), len(ys)):
            todo += [(xs[head + i], ys[head + j]) for i, j in shapes.pairs(mine[head : len(xs) - tail], other[head : len(ys) - tail])]
    return score, out


def aligned(pattern: Node, page: Node, known: tuple[_Shapes, dict[int, int]] | None = None) -> list[tuple[Node, Node]]:
    """Pairs of nodes of the pattern and of the page."""
    return matching(pattern, page, known)[1]


def slots(pattern: Node) -> dict[int, int]:
    """Number of each node of a pattern, by its identity, in page order."""
    out, todo = {}, [pattern]
    while todo:
        node = todo.pop()
        out[id(node)] = len(out)
        todo.extend(reversed(node.nodes))
    return out


def paths(page: Node) -> dict[int, int]:
    """Number of the path of tags and labels from the root to each node, by the node's identity."""
    out, todo = {id(page): 0}, [page]
    digest = xxhash.xxh64_intdigest
    while todo:
        node = todo.pop()
        if node.nodes:
            above = out[id(node)]
            for below in node.nodes:
                out[id(below)] = digest(f"{below.tag} {below.label}", above)
            todo.extend(node.nodes)
    return out


def lengths(page: Node, template: set[int] = frozenset(), cut: set[int] = frozenset()) -> dict[int, int]:
    """Characters of text in and below each node, by its identity, without elements that are out,
    nodes in ``cut`` and own text of nodes in ``template``."""
    order, sums = [page], {}
    for node in order:
        if not node.out and id(node) not in cut:
            order.extend(node.nodes)
    for node in reversed(order):
        if node.out or id(node) in cut:
            sums[id(node)] = 0
        else:
            own = 0 if id(node) in template else len(own_text(node))
            sums[id(node)] = own + sum(sums[id(n)] for n in node.nodes)
    return sums


def marks(page: Node) -> list[tuple[Node, bool]]:
    """Marked nodes that are not below an element that is out, and whether they hold most of the page's text."""
    found, todo = [], [page]
    while todo:
        node = todo.pop()
        if not node.out:
            if node.marked:
                found.append(node)
            todo.extend(node.nodes)
    sums = lengths(page) if found else {}
    return [(node, sums[id(node)] > sums[id(page)] / 2) for node in found]


def cuts(page: Node, known: dict[int, bool] | None = None, found: list | None = None) -> set[int]:
    """Identities of marked nodes to cut. ``known`` tells by path whether such nodes hold most of a page's text."""
    found = marks(page) if found is None else found
    if not found:
        return set()
    places = paths(page) if known else {}
    voted = {id(node): known.get(places[id(node)]) if known else None for node, _ in found}
    cut = {id(node) for node, most in found if not (most if voted[id(node)] is None else voted[id(node)])}
    unsure = {id(node) for node, most in found if most and voted[id(node)] is None}
    if unsure:
        sums = lengths(page, cut=cut | unsure)
        if any(sums[id(n)] for tag in ("article", "main") for n in _elements(page, tag, cut | unsure)):
            cut |= unsure
    return cut


def _elements(page: Node, tag: str, cut: set[int]) -> list[Node]:
    """The outermost elements of a kind that are neither out nor cut, in page order."""
    found, todo = [], [page]
    while todo:
        at = todo.pop()
        if at.out or id(at) in cut:
            continue
        if at.tag == tag:
            found.append(at)
        else:
            todo.extend(reversed(at.nodes))
    return found


def _scope(page: Node, template: set[int], cut: set[int]) -> list[Node]:
    """The elements that hold a page's text."""
    articles, mains = _elements(page, "article", cut), _elements(page, "main", cut)
    if not articles and not mains:
        return [page]
    sums = lengths(page, template, cut)
    told, held = (sum(sums[id(n)] for n in nodes) for nodes in (articles, mains))
    if told and told >= SCOPE * sums[id(page)]:
        return articles
    return mains if held and held >= told else [page]


def main_text(page: Node, template: set[int], known: dict[int, bool] | None = None, marked: list | None = None) -> str:
    """The text of a page's articles, main or whole without nodes whose identity is in ``template``."""
    cut = cuts(page, known, marked)
    blocks, run = [], []

    def close():
        text = " ".join(unescape("".join(run)).split())
        run.clear()
        if text:
            blocks.append(text)

    todo: list = _scope(page, template, cut)[::-1]
    while todo:
        at = todo.pop()
        if at is None:
            close()
        elif not isinstance(at, str) and at.tag == "#header":
            close()
            todo.extend(reversed(headings(at, cut)))
        elif isinstance(at, str):
            run.append(at)
        elif at.out or id(at) in cut:
            if at.tag in _BLOCKS:
                close()
        elif at.tag == "br":
            run.append(" ")
        else:
            block = at.tag in _BLOCKS or at.tag[0] == "#"
            if block:
                close()
                todo.append(None)
            gone = id(at) in template
            todo.extend(c for c in reversed(at.children) if not (gone and isinstance(c, str)))
    close()
    return "\n\n".join(blocks)


def headings(node: Node, cut: set[int]) -> list[Node]:
    """The headings below a node, without what is out or cut, in page order."""
    found, todo = [], list(reversed(node.nodes))
    while todo:
        at = todo.pop()
        if at.out or id(at) in cut:
            continue
        if at.tag in _HEADINGS:
            found.append(at)
        else:
            todo.extend(reversed(at.nodes))
    return found


def _articles(page: Node, cut: set[int]) -> set[int]:
    """Identities of nodes within an article of a page, or its main element if it has none."""
    out, todo = set(), _elements(page, "article", cut) or _elements(page, "main", cut)
    while todo:
        node = todo.pop()
        out.add(id(node))
        todo.extend(node.nodes)
    return out


def _hosted(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"))


def _dealt(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages with host and part, and the pattern of every host and part."""
    spark = pages.sparkSession
    hosted = _hosted(pages)
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    away = F.abs(F.length("html") - USUAL)
    chosen = hosted.groupBy("host").agg(
        F.count("*").alias("n"), F.min_by(F.col("html"), F.struct(away, F.col("page_id"), F.xxhash64("html"))).alias("pattern"))
    chosen = stage(chosen, "patterns")
    share = max(1, (chosen.agg(F.sum("n")).first()[0] or 0) // partitions)
    large = chosen.where(F.col("n") > share).select("host", F.ceil(F.col("n") / share).cast("long").alias("parts"))
    dealt = hosted.join(F.broadcast(large), "host", "left").withColumn(  # fewer rows than partitions
        "part", F.coalesce(F.pmod(F.xxhash64("page_id", F.length("html")), F.col("parts")), F.lit(0))).drop("parts").withColumn(
        "page", F.xxhash64("html", F.length("html")))
    copies = chosen.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("n") / share)).cast("long")).select(
        "host", "pattern", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return dealt, copies


class _Patterns:
    """The parsed pattern of the host at hand: rows of a host follow one another."""

    SHAPES = 100_000  # shapes and scores remembered from page to page

    def __init__(self):
        self.html, self.tree, self.slots, self.shapes = None, None, {}, None

    def of(self, html: str):
        if html != self.html:
            self.html, self.tree = html, parse(html)
            self.slots, self.shapes = slots(self.tree), None
        if self.shapes is None or len(self.shapes[0].sizes) + len(self.shapes[0].scores) > self.SHAPES:
            shapes = _Shapes()
            self.shapes = shapes, shapes.of(self.tree)
        return self.tree, self.slots, self.shapes


_SEEDS = np.arange(1, BANDS * PICKS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _signed(value: int) -> int:
    return value - (1 << 63)


def weighed(texts: list[str]) -> tuple[list[int], list[float]]:
    """Prints of a set of texts and their weights: the root of the length, negative for texts of a few words."""
    out = {_signed(xxhash.xxh64_intdigest(t)): len(t) ** 0.5 * (1 if t.count(" ") >= FEW_WORDS - 1 else -1) for t in texts}
    return list(out), list(out.values())


def bands(prints: np.ndarray, weights: np.ndarray) -> list[int]:
    """Weighted min-hashes of a set of prints in bands."""
    if not len(prints):
        return []
    prints = prints.astype(np.int64).view(np.uint64) + np.uint64(1 << 63)
    mixed = prints[:, None] ^ _SEEDS
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
    draws = -np.log(((mixed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights[:, None]
    picks = prints[draws.argmin(axis=0)].reshape(BANDS, PICKS)
    return [_signed(xxhash.xxh64_intdigest(row.tobytes())) for row in picks]


def holders(page: Node) -> list[Node]:
    """The nodes with text of their own, in a fixed order."""
    out, todo = [], [page]
    while todo:
        node = todo.pop()
        todo.extend(node.nodes)
        if own_text(node):
            out.append(node)
    return out


_PLACES = _Remembered(xxhash.xxh64_intdigest)  # numbers of places


def contents(tree: Node, numbers: dict[int, int], shapes, page: Node, cut: set[int], at: dict[int, int]) -> list[tuple[int, int, bool, int]]:
    """Nodes of a page with text of their own, by their number among ``holders``: place (path, and slot if aligned), whether it
    is within an article, place and content. ``at`` has the paths of the page's nodes."""
    inner, out = _articles(page, cut), []
    slot_of = {id(node): numbers[id(slot)] for slot, node in aligned(tree, page, shapes)}
    for number, node in enumerate(holders(page)):
        known, text = id(node), node.own
        within = known in inner
        place = _PLACES[f"path {at[known]} {within}"]
        out.append((number, _signed(place), within, _signed(xxhash.xxh64_intdigest(text, place))))
        if known in slot_of:
            place = _PLACES[f"{slot_of[known]} {within}"]
            out.append((number, _signed(place), within, _signed(xxhash.xxh64_intdigest(text, place))))
    return out


def _texts(page: Node, cut: set[int]) -> list[str]:
    """Texts of a page's nodes without those that name themselves as something else."""
    out, todo = [], [page]
    while todo:
        node = todo.pop()
        if not node.out and id(node) not in cut:
            if text := own_text(node):
                out.append(text)
            todo.extend(node.nodes)
    return out


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values a sorted array has; sorted once for all pages of a host, where ``np.isin`` sorts for each."""
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values if len(ordered) else np.zeros(len(values), bool)


def _told_apart(seen: DataFrame) -> DataFrame:
    """host, page and label: one label for pages that share a band. Bands are of a page's texts without those
    of a few words that most pages of the host share: menus and the like make no near copies, however short the stories."""
    pages = seen.select("host", "part", "page", "prints", "weights").dropDuplicates(["host", "page"])
    sizes = pages.groupBy("host").agg(F.count("*").alias("all"))
    short = F.filter(F.arrays_zip("prints", "weights"), lambda x: x["weights"] < 0)
    counts = pages.select("host", F.explode(short).alias("x")).groupBy("host", F.col("x.prints").alias("print")).agg(F.count("*").alias("n"))
    shared = counts.where(F.col("n") >= FEW_PAGES).join(sizes, "host").where(F.col("n") >= MOST * F.col("all"))
    common = shared.groupBy("host").agg(F.collect_list("print").alias("common"))  # of a page's texts twice as many at most
    parts = seen.select("host", "part").distinct().join(common, "host")

    def run(batches):
        of, gone = None, None
        for batch in batches:
            out = []
            for host, part, prints, weights, common in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), batch.column(4), batch.column(5), strict=True):
                if (host, part) != of:
                    of, gone = (host, part), np.sort(common.values.to_numpy()) if common.is_valid else np.zeros(0, np.int64)
                prints, weights = prints.values.to_numpy(), weights.values.to_numpy()
                kept = ~_among(prints, gone)
                out.append(bands(prints[kept], np.abs(weights[kept])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.list_(pa.int64()))], names=["host", "page", "bands"])

    banded = stage(pages.join(parts, ["host", "part"], "left").select("host", "part", "page", "prints", "weights", "common").mapInArrow(
        run, "host string, page long, bands array<long>"), "bands")
    each = banded.select("host", "page", F.posexplode("bands").alias("band", "value"))
    shared = each.groupBy("host", "band", "value").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1")
    joined = each.join(shared.drop("n"), ["host", "band", "value"]).groupBy("host", "page").agg(F.min("first").alias("first"))
    return banded.select("host", "page").join(joined, ["host", "page"], "left").select(
        "host", "page", F.coalesce("first", "page").alias("label"))


def read_pages(dealt: DataFrame, patterns: DataFrame) -> DataFrame:
    """What every page has: prints of its texts, places and contents of its nodes, marked nodes. Each page is aligned once."""
    fields = {"host": pa.string(), "part": pa.int64(), "page": pa.int64(), "prints": pa.list_(pa.int64()), "weights": pa.list_(pa.float32()),
              "nodes": pa.list_(pa.int32()), "places": pa.list_(pa.int64()), "inner": pa.list_(pa.bool_()), "keys": pa.list_(pa.int64()),
              "marks": pa.list_(pa.int64()), "most": pa.list_(pa.bool_())}

    def row(known, host, part, number, pattern, html):
        page = parse(html)
        marked = marks(page)
        cut = cuts(page, None, marked)
        at = paths(page)
        found = contents(*known.of(pattern), page, cut, at)
        return (host, part, number, *weighed(_texts(page, cut)), *(zip(*found, strict=True) if found else ((),) * 4),
                [_signed(at[id(node)]) for node, _ in marked], [most for _, most in marked])

    def read(batches):
        known = _Patterns()
        for batch in batches:
            with _uncollected():
                rows = [row(known, *values) for values in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, fields.values(), strict=True)], names=list(fields))

    paired = dealt.join(patterns, ["host", "part"]).select("host", "part", "page", "pattern", "html")
    return stage(paired.mapInArrow(
        read, "host string, part long, page long, prints array<long>, weights array<float>, nodes array<int>, places array<long>, "
              "inner array<boolean>, keys array<long>, marks array<long>, most array<boolean>"), "seen")


def induce(seen: DataFrame) -> DataFrame:
    """host, template, the places and contents that are constant, and voted, by path whether its marked nodes hold most."""
    labels = stage(_told_apart(seen), "labels")
    all_pages = labels.groupBy("host").agg(F.count_distinct("label").alias("all"))
    labelled = seen.select("host", "page", "places", "inner", "keys", "marks", "most").join(labels, ["host", "page"])
    rows = labelled.select("host", "label", F.explode(F.arrays_zip("places", "inner", "keys")).alias("at"))
    counts = rows.groupBy("host", F.col("at.places").alias("place"), F.col("at.inner").alias("within"), F.col("at.keys").alias("key")).agg(
        F.count_distinct("label").alias("most"))
    places = counts.groupBy("host", "place").agg(F.sum("most").alias("pages"), F.count("*").alias("contents"))
    often = counts.where(F.col("most") >= FEW_PAGES).join(places.where(F.col("pages") >= FEW_PAGES), ["host", "place"]).join(all_pages, "host")
    outer = ~F.col("within") & (
        (F.col("most") >= MOST * F.col("all"))
        | ((F.col("pages") >= IN_TURN) & (F.col("contents") <= VALUES * F.col("pages"))
           & (F.col("most") >= 1 / VALUES) & (F.col("most") >= RECURS * F.col("all"))))
    inner = F.col("within") & (F.col("most") >= ARTICLE_PAGES) & (F.col("most") >= ARTICLE_MOST * F.col("all"))
    template = often.where(outer | inner).groupBy("host").agg(F.collect_list("key").alias("template"))
    marked = labelled.select("host", "label", F.explode(F.arrays_zip("marks", "most")).alias("at")).groupBy(
        "host", F.col("at.marks").alias("path"), "label").agg(F.max("at.most").alias("most"))
    votes = marked.groupBy("host", "path").agg(F.count("*").alias("n"), F.count_if("most").alias("most")).where(
        F.col("n") >= FEW_PAGES).join(all_pages, "host").where(F.col("n") >= RECURS * F.col("all"))
    voted = votes.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("path", F.col("most") > F.col("n") / 2))).alias("voted"))
    return template.join(voted, "host", "full_outer")


def _dropped(seen: DataFrame, templates: DataFrame) -> DataFrame:
    """host, page and gone, the numbers of the nodes whose content is template: of pages that have some."""
    parts = seen.select("host", "part").distinct().join(templates.where("template IS NOT NULL").select("host", "template"), "host")

    def run(batches):
        of, template = None, None
        for batch in batches:
            out = []
            for host, part, nodes, keys, gone in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *batch.columns[3:], strict=True):
                if (host, part) != of:
                    of, template = (host, part), np.sort(gone.values.to_numpy())
                out.append(np.unique(nodes.values.to_numpy()[_among(keys.values.to_numpy(), template)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.list_(pa.int32()))], names=["host", "page", "gone"])

    pages = seen.select("host", "part", "page", "nodes", "keys").dropDuplicates(["host", "page"])
    joined = pages.join(parts, ["host", "part"]).select("host", "part", "page", "nodes", "keys", "template")
    return joined.mapInArrow(run, "host string, page long, gone array<int>").where("size(gone) > 0")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""
    dealt, patterns = _dealt(pages)
    seen = read_pages(dealt, patterns)
    # The pages are shuffled again below. Spark removes the files of the first shuffle when the driver has collected what names them.
    pages.sparkSession._jvm.System.gc()
    templates = stage(induce(seen), "templates")
    gone = stage(_dropped(seen, templates), "gone")
    release(seen)

    def read(batches):
        of, voted = None, {}
        for batch in batches:
            texts = []
            with _uncollected():
                for host, html, numbers, votes in zip(*[c.to_pylist() for c in batch.columns[2:]], strict=True):
                    if of != host:
                        voted, of = {k + (1 << 63): v for k, v in votes or ()}, host
                    page = parse(html)
                    held = holders(page) if numbers else ()
                    texts.append(main_text(page, {id(held[i]) for i in numbers or ()}, voted))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    votes = templates.where("voted IS NOT NULL").select("host", "voted").join(patterns.select("host", "part"), "host").drop("pattern")
    told = dealt.join(gone, ["host", "page"], "left").join(votes, ["host", "part"], "left")
    return told.select("page_id", "url", "host", "html", "gone", "voted").mapInArrow(read, "page_id long, url string, text string")
