"""Conversations as training text, with a loss mask aligned to token offsets.

A conversation is rendered whole: each turn between the two markers of its role, other roles
by name. Control strings (the markers and the special tokens of the tokenizer) that occur inside
a text or a role get one more ``~`` after their first character, also where they have some
already; taking one away gives the text back. No two control strings overlap, which is checked, so none
can arise where a text meets a marker. The rendered text is encoded once, with offsets. A token counts for the loss if its
span meets the span of a text of the trained role; both lists of spans are sorted, so each token
finds its turn by binary search. Markers are tokens of their own, so no token reaches from one
turn into another.

A conversation longer than ``SEGMENT`` characters is rendered and encoded in several rows, cut
between turns; as markers are whole tokens the ids are those of one row. So memory stays bounded
however long a conversation is; its rows do meet in one task, in order, because its digest is of all.

Turns come by turn number, ties by role and text, null numbers first. Null text and null role
are empty. Repeated rows are turns of their own. Rows without conversation id are one conversation
whose id is null. A turn of any length is rendered whole. An empty table gives an empty result. Only the four named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT = 1 << 20

FORMATTED = ("conv_id long, segment int, text string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>")
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


@dataclass(frozen=True)
class Template:
    """How turns are marked, and which role is trained."""

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {
        "user": ("[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("<s>", "</s>")})
    other: tuple[str, str, str] = ("<|role|>", "<|text|>", "<|end|>")
    trained: str = "assistant"

    def markers(self) -> list[str]:
        return [m for pair in self.marks.values() for m in pair] + list(self.other)


class Renderer:
    """Renders turns and reads them back."""

    def __init__(self, template: Template, special: list[str]):
        self.template = template
        controls = sorted({*template.markers(), *special})
        if len(set(template.markers())) < len(template.markers()):
            raise ValueError("two markers are equal")
        for c in controls:
            if len(c) < 2 or "~" in c:
                raise ValueError(f"no control string: {c!r}")
            for d in controls:
                if any(c[i:].startswith(d) or d.startswith(c[i:]) for i in range(1, len(c))) or (c != d and d.startswith(c)):
                    raise ValueError(f"control strings overlap: {c!r}, {d!r}")
        either = "|".join(f"{re.escape(c[0])}(?=~*{re.escape(c[1:])})" for c in controls)
        self._add = re.compile(either)
        self._first = re.compile("|".join(f"{re.escape(c[0])}~+{re.escape(c[1:])}" for c in controls))
        self._marker = re.compile("|".join(re.escape(m) for m in template.markers()))
        self._role = {pair[0]: role for role, pair in template.marks.items()}

    def escape(self, text: str) -> str:
        return self._add.sub(lambda m: m[0] + "~", text)

    def unescape(self, text: str) -> str:
        return self._first.sub(lambda m: m[0][0] + m[0][2:], text)

    def render(self, role: str, text: str) -> tuple[str, int, int]:
        """The marked turn, and where in it the text starts and ends."""
        text = self.escape(text)
        if role in self.template.marks:
            head, tail = self.template.marks[role]
        else:
            opening, middle, tail = self.template.other
            head = opening + self.escape(role) + middle
        return head + text + tail, len(head), len(head) + len(text)

    def parse(self, rendered: str) -> list[tuple[str, str]]:
        """The (role, text) pairs of a rendered text."""
        turns: list[tuple[str, str]] = []
        marks = [(m[0], m.start(), m.end()) for m in self._marker.finditer(rendered)]
        i = at = 0
        opening, middle, closing = self.template.other
        while i < len(marks):
            mark, start, end = marks[i]
            if start != at:
                raise ValueError("text outside of turns")
            if mark == opening:
                role, i = self.unescape(rendered[end : marks[i + 1][1]]), i + 1
                if marks[i][0] != middle:
                    raise ValueError("a role has no end")
                end, tail = marks[i][2], closing
            else:
                role = self._role[mark]
                tail = self.template.marks[role][1]
            last, start, at = marks[i + 1]
            if last != tail:
                raise ValueError("a turn has no end")
            turns.append((role, self.unescape(rendered[end:start])))
            i += 2
        if at != len(rendered):
            raise ValueError("text outside of turns")
        return turns


def overlaps(starts: np.ndarray, ends: np.ndarray, span_starts: np.ndarray, span_ends: np.ndarray) -> np.ndarray:
    """Which sorted token spans meet one of the sorted, separate turn spans."""
    if not len(span_starts):
        return np.zeros(len(starts), bool)
    at = np.searchsorted(span_ends, starts, side="right")
    inside = at < len(span_starts)
    return inside & (span_starts[np.minimum(at, len(span_starts) - 1)] < ends) & (starts < ends)


class _Encoder:
    def __init__(self, path: str, template: Template):
        from tokenizers import AddedToken, Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenizer.add_special_tokens([AddedToken(m, special=True, normalized=False) for m in template.markers()])
        self.renderer = Renderer(template, special)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        out = []
        for text, found in zip(texts, self.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
            spans = np.array(found.offsets, np.int32).reshape(-1, 2)
            starts, ends = spans[:, 0], spans[:, 1]
            reach = np.concatenate([[0], np.maximum.accumulate(ends)])
            if reach[-1] != len(text) or (starts > reach[:-1]).any():
                raise ValueError("the tokenizer drops characters; use one whose tokens cover the text")
            out.append((np.array(found.ids, np.int32), starts, ends))
        return out


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *[len(a) for a in arrays]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, arrays[0][:0]]), kind))


def format_conversations(rows: DataFrame, tokenizer: str, template: Template | None = None, segment: int = SEGMENT) -> DataFrame:
    """conv_id, segment, text, ids, starts, ends (of each token, in code points of text), loss.
    Rows of a conversation follow one another in order."""
    template = template or Template()
    names = [f.split()[0] for f in FORMATTED.split(", ")]

    def run(batches):
        encoder = _Encoder(tokenizer, template)
        renderer = encoder.renderer
        ready: list[tuple] = []
        held = 0
        conv, number, parts, spans, size, begun = None, 0, [], [], 0, False

        def close():
            nonlocal number, parts, spans, size, held
            if parts:
                ready.append((conv, number, "".join(parts), spans))
                held += size
                number, parts, spans, size = number + 1, [], [], 0

        def out():
            nonlocal ready, held
            encoded = encoder.encode([r[2] for r in ready])
            masks = []
            for (_, starts, ends), row in zip(encoded, ready, strict=True):
                turns = np.array(row[3], np.int64).reshape(-1, 2)
                masks.append(overlaps(starts, ends, turns[:, 0], turns[:, 1]))
            columns = [pa.array([r[0] for r in ready], pa.int64()), pa.array([r[1] for r in ready], pa.int32()),
                       pa.array([r[2] for r in ready], pa.string()),
                       *[_lists([e[i] for e in encoded], pa.int32()) for i in range(3)], _lists(masks, pa.bool_())]
            ready, held = [], 0
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for at, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not begun or at != conv:
                    close()
                    conv, number, begun = at, 0, True
                turn, start, end = renderer.render(role, text)
                if size and size + len(turn) > segment:
                    close()
                if role == template.trained and end > start:
                    spans.append((size + start, size + end))
                parts.append(turn)
                size += len(turn)
                if len(ready) >= 256 or held > segment:
                    yield out()
        close()
        if ready:
            yield out()

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), *text)
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


def digest(formatted: DataFrame, tokenizer: str, template: Template | None = None) -> DataFrame:
    """What the formatted rows say when read back: the turns from the text, the trained text from
    the mask. Takes the rows of a conversation in order, as ``format_conversations`` gives them."""
    template = template or Template()
    names = [f.split()[0] for f in DIGEST.split(", ")]

    def run(batches):
        renderer = _Encoder(tokenizer, template).renderer
        conv, begun, done = None, False, []
        turns = loss = None
        n_turns = n_loss = n_chars = 0

        def close():
            if begun:
                done.append((conv, n_turns, turns.hexdigest(), n_loss, loss.hexdigest(), n_chars))

        for batch in batches:
            done = []
            for row in range(batch.num_rows):
                at, text = batch.column(0)[row].as_py(), batch.column(2)[row].as_py()
                if not begun or at != conv:
                    close()
                    conv, begun = at, True
                    turns, loss, n_turns, n_loss, n_chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                found = renderer.parse(text)
                turns.update("".join(f"{r}\n{t}\n" for r, t in found).encode())
                n_turns += len(found)
                n_chars += len(text)
                starts, ends = (batch.column(c)[row].values.to_numpy() for c in (4, 5))
                mask = batch.column(6)[row].values.to_numpy(zero_copy_only=False)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                    trained = renderer.unescape(text[starts[i] : ends[j - 1]])
                    loss.update(trained.encode())
                    n_loss += len(trained)
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, d, strict=True)) for d in done], schema=_DIGEST)
        done = []
        close()
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(names, d, strict=True)) for d in done], schema=_DIGEST)

    return formatted.mapInArrow(run, DIGEST)


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                     ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
