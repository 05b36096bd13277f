"""What several operators share: reading, staging, the word-level encoder."""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfold.session import release, stage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

__all__ = ["LOWER", "UPPER", "WordEncoder", "ascii_lower", "release", "row_of", "stage", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column):
    """Lower-case A-Z and nothing else."""
    return F.translate(column, UPPER, LOWER)


def row_of(df: DataFrame, columns=None):
    """The row as one column ``row``, so that no helper column can clash with a name of the input."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in columns or df.columns]).alias("row")


# How a word-level tokenizer file cuts text before it encodes the pieces.
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The same cut for lower-cased Latin-1 text.
_LETTERS = "a-zªµºß-öø-ÿ"
_NUMBERS = "0-9²³¹¼½¾"
_SPACE = r"\t-\r \x85\xa0"
_RUNS = re.compile(f"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBERS}]|[^{_SPACE}{_LETTERS}{_NUMBERS}]+")


class WordEncoder:
    """Token ids of texts, by a tokenizer file, with a bounded memory of words.

    A tokenizer that lower-cases, cuts text into runs of letters, single digits and runs
    of other signs, and marks each run's last token, never joins text across runs. So the
    ids of a text are those of its runs in order; runs recur, and each is encoded once and
    then looked up. Unknown runs are encoded many at a time and told apart by the marks.
    This covers Latin-1 text; other texts, texts that may spell a special token, and other
    kinds of tokenizer are encoded whole.
    """

    KEEP = 350_000  # runs remembered
    LONG = 48  # longer ones are encoded, but not remembered

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        suffix = parts["model"].get("end_of_word_suffix")
        self.by_run = bool(suffix) and json.dumps(_CUT)[1:-1] in json.dumps(parts["pre_tokenizer"]) and (
            "Lowercase" in json.dumps(parts["normalizer"]))
        if self.by_run:
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
            self.special = [t["content"].lower() for t in parts["added_tokens"]]
        self.known: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _learn(self, runs: list[str]) -> None:
        for start in range(0, len(runs), 2000):
            some = runs[start : start + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some):
                self.known.update(zip(some, self._ids(some), strict=True))
                continue
            raw, at = ids.tobytes(), 0
            for run, stop in zip(some, (stops * 4).tolist(), strict=True):
                self.known[run] = raw[at:stop]
                at = stop

    def _cut(self, text: str) -> list[str] | None:
        """The runs of a text, None if it has to be encoded whole."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        low = text.lower()
        return None if any(s in low for s in self.special) else _RUNS.findall(low)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        if not self.by_run:
            return self._ids(texts)
        out: list[bytes] = []
        for start in range(0, len(texts), 256):
            if len(self.known) > self.KEEP:
                self.known = {}
            some = texts[start : start + 256]
            cuts = [self._cut(t) for t in some]
            new = list(set().union(*[c for c in cuts if c]).difference(self.known))
            self._learn(new)
            whole = iter(self._ids([t for t, c in zip(some, cuts, strict=True) if c is None]))
            look = self.known.__getitem__
            out += [next(whole) if c is None else b"".join(map(look, c)) for c in cuts]
            for run in new:
                if len(run) > self.LONG:
                    del self.known[run]
        return out
