"""Quality classifier: logistic regression over hashed word n-grams, fitted by
follow-the-regularised-leader updates.

A text's features are its words and pairs of neighbouring words, once by their letters
(A-Z lower-cased) and once by their shape (kinds of characters of the whole word in order, runs shortened) and once by
whether a pair is one word twice, hashed to ``2**bits`` slots. A slot's value is its count over the square root of all
counts, so a score is one sparse dot product: the sum of the weights at the text's slots.

Fitting takes labelled rows with a text, at most about ``most`` of them: above that, those
whose id hashes under the matching share. The rows are dealt to ``shards`` tasks; each
runs the per-coordinate updates over its rows in a fixed order, and the shards' weights are
averaged. Weights at most fill the table of 2**bits slots, whatever the input's size.
Scoring covers every row and whole texts.

Null and empty texts have no features but the constant one and get its score. Labels other
than 0 and 1 are not used; ids with several labels count by their mean, rounded; rows with
a null id are scored, never learned from. With no labelled row every score is 0.5. Only
the id and text columns are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternfold.llm.common import row_of

BITS = 18
MOST = 20_000
SHARDS = 6
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5
CUT = 0.3
FOLDS = 5

_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(29)


def _shape(word: str) -> str:
    out: list[str] = []
    for c in word:
        kind = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "l" if c.isalpha() else c
        if out[-2:] != [kind, kind]:
            out.append(kind)
    return "".join(out)


class Features:
    """Slots of texts; remembers the hashes of words within a task."""

    KEEP = 300_000

    def __init__(self, bits: int = BITS):
        self.down = np.uint64(64 - bits)
        self.known: dict[str, tuple[int, int]] = {}

    def _hashes(self, word: str) -> tuple[int, int]:
        # 32 bits each; mixing spreads them over the slots
        return zlib.crc32(word.lower().encode()), zlib.crc32(b"\0" + _shape(word).encode())

    def slots(self, text: str) -> np.ndarray:
        """One slot per occurrence of a feature; the constant feature is slot 0."""
        words, known = text.split(), self.known
        if not words:
            return np.zeros(1, np.int64)
        if len(known) > self.KEEP:
            known.clear()
        for word in set(words).difference(known):
            known[word] = self._hashes(word)
        pairs = np.array([known[w] for w in words], np.uint64)
        found = [np.zeros(1, np.uint64)]
        for column in (0, 1):
            one = pairs[:, column] * _MIX + np.uint64(column + 1)
            two = (one[:-1] ^ (one[:-1] >> _SHIFT)) * _ODD + one[1:] * _MIX
            for values in (one, two):
                found.append(((values ^ (values >> _SHIFT)) * _ODD) >> self.down)
        again = int((pairs[1:, 0] == pairs[:-1, 0]).sum())  # pairs of one word twice, whatever the word
        found.append(np.full(again, _MIX >> self.down))
        return np.concatenate(found).astype(np.int64)


def fit_rows(rows, bits: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights after passes over (text, label) rows in their order."""
    features = Features(bits)
    seen = []
    for text, label in rows:
        slots = features.slots(text)
        at, counts = np.unique(slots, return_counts=True)
        seen.append((at.astype(np.int32), (counts / np.sqrt(len(slots))).astype(np.float32), float(label)))
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(zs, ns):
        return np.where(np.abs(zs) <= L1, 0.0, (np.sign(zs) * L1 - zs) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    for _ in range(epochs):
        for at, x, label in seen:
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            more = g * g
            z[at] = zs + g - (np.sqrt(ns + more) - np.sqrt(ns)) / ALPHA * w
            n[at] = ns + more
    return weights(z, n)


def fit(docs: DataFrame, labels: DataFrame, bits: int = BITS, most: int = MOST, shards: int = SHARDS) -> np.ndarray:
    """Weights learned from the labelled documents: labels has doc_id and quality."""
    told = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(
        F.round(F.avg("quality")).cast("int").alias("label"))
    share = min(1.0, most / max(1, told.count()))
    deal = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    chosen = told.where(deal < int(share * (1 << 20)))  # about `most` rows of 12 bytes
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(
        F.broadcast(chosen), "doc_id").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)))

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        # in the order of a checksum: ids may follow the labels
        order = sorted(range(len(frame)), key=lambda i: (zlib.crc32(str(frame["doc_id"].iat[i]).encode()), i))
        w = fit_rows(((frame["text"].iat[i], frame["label"].iat[i]) for i in order), bits)
        at = np.flatnonzero(w)
        return pd.DataFrame({"slot": at, "weight": w[at] * len(frame), "rows": 0}).pipe(
            lambda f: pd.concat([f, pd.DataFrame({"slot": [-1], "weight": [0.0], "rows": [len(frame)]})]))

    parts = rows.groupBy("shard").applyInPandas(learn, "slot long, weight double, rows long")
    summed = parts.groupBy("slot").agg(F.sum("weight").alias("weight"), F.sum("rows").alias("rows")).toPandas()
    total = max(1, int(summed["rows"].sum()))
    model = np.zeros(1 << bits)
    found = summed[summed["slot"] >= 0]
    model[found["slot"].to_numpy()] = found["weight"].to_numpy() / total
    return model


def score(docs: DataFrame, model: np.ndarray, keep: tuple[str, ...] = ("doc_id",), out: str = "score") -> DataFrame:
    """The columns of ``keep``, whatever their names, and the score (0 to 1) of every row."""
    weights = docs.sparkSession.sparkContext.broadcast(model.astype(np.float32))
    bits = len(model).bit_length() - 1
    given = docs.select(row_of(docs, keep), F.col("text").cast("string").alias("text"))

    def run(batches):
        features, w = Features(bits), weights.value
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                slots = features.slots(text or "")
                found.append(float(w[slots].sum(dtype=np.float64)) / np.sqrt(len(slots)))
            scores = 1 / (1 + np.exp(-np.clip(np.array(found, np.float64), -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["row", "score"])

    schema = T.StructType([given.schema["row"], T.StructField("score", T.DoubleType())])
    return given.mapInArrow(run, schema).select("row.*", F.col("score").alias(out))


def accepted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the classifier does not reject, with their columns, whatever their names."""
    model = fit(docs, labels.where(~held_out()), **options)
    whole = docs.select(row_of(docs), "text")
    return score(whole, model, ("row",)).where(F.col("score") >= CUT).select("row.*")


def held_out(doc_id="doc_id"):
    """The fold never learned from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; learns outside the held-out fold."""
    model = fit(docs, labels.where(~held_out()), **options)
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= CUT).cast("int").alias("predicted"))
