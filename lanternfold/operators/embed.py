"""Text -> unit vectors.

An embedder turns a text column into ``array<float>``. The default one needs no
model files: each word is a signed one-hot vector picked by its hash, the words
are mean-pooled and the result is scaled to unit length. Words are found in the
JVM; each distinct one of an Arrow batch is hashed once, the scatter-add and the scaling are
one numpy call.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternfold.settings import Settings

VECTOR = T.ArrayType(T.FloatType())


class Embedder(Protocol):
    dim: int
    name: str

    def encode(self, text: Column) -> Column: ...


def mean_pool(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean over the unmasked positions of ``[row, position, dim]``."""
    weight = mask[..., None].astype(hidden.dtype)
    return (hidden * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-9)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; a zero row stays zero."""
    length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def words(text: Column, window: int | None = None) -> Column:
    """``array<string>``: the lower-cased words of a text. With a window, words beyond it are left out."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return tokens if window is None else F.slice(tokens, 1, window)


def hash_tokens(text: Column, dim: int, window: int | None = None) -> Column:
    """``array<int>``: position of each word's one-hot vector, negative for sign -1 (1-based)."""

    def code(token: Column) -> Column:
        hashed = F.conv(F.substr(F.md5(token), F.lit(1), F.lit(8)), 16, 10).cast("bigint")
        place = (hashed % dim + 1).cast("int")
        return F.when(F.floor(hashed / dim) % 2 == 0, place).otherwise(-place)

    return F.transform(words(text, window), code)


def _cells(tokens: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Position (0-based) and sign of each word, as ``hash_tokens`` has them."""
    coded = tokens.dictionary_encode()
    hashed = np.array([int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big") for w in coded.dictionary.to_pylist()], np.int64)
    at = coded.indices.to_numpy()
    return (hashed % dim)[at], (1 - 2 * (hashed // dim % 2))[at]


@dataclass(frozen=True)
class HashingEmbedder:
    """``max_length`` words count; all of them where it is None."""

    dim: int = 384
    name: str = "feature-hashing"
    max_length: int | None = None

    def encode(self, text: Column) -> Column:
        dim = self.dim

        @F.arrow_udf(VECTOR)
        def pool(tokens: pa.Array) -> pa.Array:
            n = len(tokens)
            sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy().astype(np.int64)
            place, sign = _cells(tokens.flatten(), dim)
            total = np.bincount(np.repeat(np.arange(n), sizes) * dim + place, weights=sign, minlength=n * dim).reshape(n, dim)
            mean = total / np.maximum(sizes, 1)[:, None]
            flat = pa.array(unit_rows(mean).astype(np.float32).reshape(-1))
            return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), flat)

        return pool(words(text, self.max_length))


def length_groups(lengths: np.ndarray, batch: int) -> list[np.ndarray]:
    """Rows in groups of at most ``batch``, shortest first, so that rows padded to the longest of their
    group are padded little, whatever the order they came in."""
    order = np.argsort(lengths, kind="stable")
    return [order[i : i + batch] for i in range(0, len(order), batch)]


def padding_share(lengths: np.ndarray, groups: list[np.ndarray]) -> float:
    """The share of all positions that is padding when each group is as wide as its longest row."""
    cells = sum(len(g) * int(lengths[g].max()) for g in groups)
    return 1 - float(lengths.sum()) / cells if cells else 0.0


def _tokenizer(path: str, max_length: int | None):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_padding()
    if max_length is None:
        found.no_truncation()
    else:
        found.enable_truncation(max_length=max_length)
    return found


SHARE_CHARS = 1 << 18  # of the texts encoded at a time: an encoding takes a hundred times its text


def _shares(texts: pd.Series) -> Iterator[list[str]]:
    """The texts of a batch in their order, at most so many characters together unless one text has more."""
    some, held = [], 0
    for text in texts:
        text = "" if text is None or text is pd.NA or text != text else text
        if some and held + len(text) > SHARE_CHARS:
            yield some
            some, held = [], 0
        some.append(text)
        held += len(text)
    if some:
        yield some


@dataclass(frozen=True)
class PieceEmbedder:
    """Word pieces of a public tokenizer file within the window, as hashed signed one-hot vectors, mean-pooled.

    Needs the tokenizer file on every node, and no model."""

    tokenizer: str
    dim: int = 384
    max_length: int = 256
    name: str = "word-pieces"

    def window(self, text: Column) -> Column:
        """``struct<tokens, ids>``: how many ids the whole text has, and those that the embedder looks at."""
        path, max_length = self.tokenizer, self.max_length

        @F.pandas_udf("tokens int, ids array<int>")
        def cut(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            tokenizer = _tokenizer(path, None)
            for texts in parts:
                tokens, ids = np.zeros(len(texts), np.int32), []
                for some in _shares(texts):
                    for found in tokenizer.encode_batch(some, add_special_tokens=False):
                        tokens[len(ids)] = len(found)
                        ids.append(np.array(found.ids[:max_length], np.int32))
                yield pd.DataFrame({"tokens": tokens, "ids": pd.Series(ids, dtype=object)})

        return cut(text)

    def encode(self, text: Column) -> Column:
        dim = self.dim

        @F.pandas_udf(VECTOR)
        def pool(windows: pd.DataFrame) -> pd.Series:
            vectors = []
            for start in range(0, len(windows), 512):
                ids = windows["ids"].iloc[start : start + 512]
                sizes = ids.str.len().to_numpy(np.int64)
                flat = np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                place, sign = (flat >> np.uint64(20)) % np.uint64(dim), 1.0 - 2.0 * (flat >> np.uint64(63)).astype(float)
                cell = np.repeat(np.arange(len(sizes)), sizes) * dim + place.astype(np.int64)
                total = np.bincount(cell, weights=sign, minlength=len(sizes) * dim).reshape(len(sizes), dim)
                vectors.extend(unit_rows(total / np.maximum(sizes, 1)[:, None]).astype(np.float32))
            return pd.Series(vectors, dtype=object)

        return pool(self.window(text))


@dataclass(frozen=True)
class OnnxEmbedder:
    """Sentence encoder from ``minilm.onnx`` and ``tokenizer.json`` in a folder every node sees.

    The session is opened once per Python worker, on one thread: Spark already
    runs one task per core.
    """

    models_dir: str
    dim: int = 384
    max_length: int = 256
    batch: int = 32
    name: str = "sentence-transformers/all-MiniLM-L6-v2"

    def encode(self, text: Column) -> Column:
        models_dir, dim, max_length, batch = self.models_dir, self.dim, self.max_length, self.batch

        @F.pandas_udf(VECTOR)
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import onnxruntime as ort

            tokenizer = _tokenizer(os.path.join(models_dir, "tokenizer.json"), max_length)
            options = ort.SessionOptions()
            options.intra_op_num_threads = 1
            options.inter_op_num_threads = 1
            session = ort.InferenceSession(
                os.path.join(models_dir, "minilm.onnx"), options, providers=["CPUExecutionProvider"])
            for texts in parts:
                encoded = tokenizer.encode_batch(list(texts.fillna("")))
                lengths = np.array([len(e.ids) for e in encoded], np.int64)
                vectors: list = [None] * len(encoded)
                for rows in length_groups(lengths, batch):
                    ids = np.zeros((len(rows), max(1, int(lengths[rows].max()))), np.int64)
                    mask = np.zeros_like(ids)
                    for i, row in enumerate(rows):
                        ids[i, : lengths[row]] = encoded[row].ids
                        mask[i, : lengths[row]] = 1
                    hidden = session.run(None, {"input_ids": ids, "attention_mask": mask})[0]
                    pooled = unit_rows(mean_pool(hidden, mask))
                    if pooled.shape[1] != dim:
                        raise ValueError(f"model gives {pooled.shape[1]} dimensions, expected {dim}")
                    for row, vector in zip(rows.tolist(), pooled.astype(np.float32)):
                        vectors[row] = vector
                yield pd.Series(vectors)

        return run(text)


def choose_embedder(settings: Settings) -> Embedder:
    """``EMBEDDER_BACKEND`` pins one; else ONNX when its files are there; else hashing."""
    onnx = OnnxEmbedder(settings.models_dir, settings.embedding_dim,
                        settings.max_sequence_length, settings.embed_batch)
    hashing = HashingEmbedder(settings.embedding_dim)
    pinned = os.environ.get("EMBEDDER_BACKEND", "").strip().lower()
    if pinned in ("onnx", "hashing"):
        return onnx if pinned == "onnx" else hashing
    present = all(os.path.exists(os.path.join(settings.models_dir, f))
                  for f in ("minilm.onnx", "tokenizer.json"))
    return onnx if present else hashing


def checked(vector: Column, dim: int) -> Column:
    """The vector itself; the job fails on any vector of another width."""
    return F.when(F.size(vector) == dim, vector).otherwise(F.raise_error(F.concat(
        F.lit(f"expected {dim} dimensions, got "), F.size(vector).cast("string"))).cast(VECTOR))


def embed(df: DataFrame, text: str, embedder: Embedder, out: str = "embedding") -> DataFrame:
    return (
        df.withColumn(out, embedder.encode(F.col(text)))
        .withColumn(out, checked(F.col(out), embedder.dim))
    )


# --- the same pooling as plain DataFrame steps, for vectors that already sit in rows ---


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def normalise(vector: Column) -> Column:
    length = F.sqrt(dot(vector, vector))
    return F.when(length > 0, F.transform(vector, lambda x: x / length)).otherwise(vector)


def pool_rows(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean vector per key. Sums are combined map-side, one cell per (key, position)."""
    cells = vectors.select(key, F.posexplode(vector).alias("pos", "x"))
    means = cells.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "m")))
    return means.groupBy(key).agg(F.transform(ordered, lambda p: p["m"]).alias("pooled"))
