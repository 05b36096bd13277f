"""Vectors kept by the digest of their text: what was encoded once is not encoded again.

The store is a collection of its own, one for each maker (embedder and width), keyed by the SHA-256 of the
text. Texts whose digest it lacks are encoded, each distinct text once, and added; then
every row takes its vector by digest. A rebuild of a corpus thus costs its changed texts.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfold.operators.embed import Embedder, embed
from lanternfold.session import release, stage
from lanternfold.sources.collection import Collection


def maker_of(embedder: Embedder) -> dict:
    """What distinguishes the vectors of one embedder from those of another."""
    return {"embedder": embedder.name, "dim": embedder.dim, "max_length": getattr(embedder, "max_length", None)}


class VectorStore:
    def __init__(self, spark: SparkSession, path: str, embedder: Embedder):
        self.embedder = embedder
        maker = json.dumps(maker_of(embedder), sort_keys=True)
        self.collection = Collection(spark, f"{path.rstrip('/')}/{hashlib.sha256(maker.encode()).hexdigest()[:16]}")

    def embed(self, rows: DataFrame, text: str, out: str = "embedding") -> tuple[DataFrame, int]:
        """``rows`` with their vectors, and how many texts had to be encoded. Null text is the empty text."""
        digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
        keyed = rows.withColumn("_digest", digest)
        wanted = keyed.select(F.col("_digest").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).dropDuplicates(["id"])
        if self.collection.version():
            wanted = wanted.join(self.collection.read(maker_of(self.embedder)).select("id"), "id", "left_anti")
        made = stage(embed(wanted, "text", self.embedder).select("id", "embedding"), "encoded", n=F.count("*"))
        encoded = made.observed["n"]
        if encoded:
            self.collection.upsert(made, maker_of(self.embedder))
        release(made)
        stored = self.collection.read().select(F.col("id").alias("_digest"), F.col("embedding").alias(out))
        return keyed.join(stored, "_digest", "left").drop("_digest"), encoded
