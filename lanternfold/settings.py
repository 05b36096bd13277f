"""Run-time settings: environment defaults, overridden by ``spark.lanternfold.*``."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession

CONF_PREFIX = "spark.lanternfold."


@dataclass(frozen=True)
class Settings:
    top_k: int = 4
    data_dir: str = "lanternfold_data"
    collection: str = "faq_chunks"
    embedding_dim: int = 384
    models_dir: str = "models"
    max_sequence_length: int = 256
    embed_batch: int = 32
    http_timeout: int = 30
    http_attempts: int = 3
    ingest_deadline_seconds: int = 0  # 0: none; set where someone waits for the build
    # Questions of one search task, chunks of a ball, and chunks of one task (whole balls).
    cell_questions: int = 98_304
    cell_chunks: int = 16_384
    task_chunks: int = 131_072

    @property
    def collection_path(self) -> str:
        return f"{self.data_dir.rstrip('/')}/{self.collection}"

    @property
    def manifest_path(self) -> str:
        return f"{self.data_dir.rstrip('/')}/ingest_manifest"

    @property
    def dump_path(self) -> str:
        return f"{self.data_dir.rstrip('/')}/chunks_txt"


def load_settings(spark: SparkSession | None = None, **overrides) -> Settings:
    """Defaults < environment (``TOP_K`` ...) < Spark conf < explicit overrides."""
    found: dict = {}
    for f in fields(Settings):
        raw = os.environ.get(f.name.upper())
        if spark is not None:
            raw = spark.conf.get(CONF_PREFIX + f.name, raw)
        if raw not in (None, ""):
            found[f.name] = int(raw) if isinstance(f.default, int) else raw
    found.update({k: v for k, v in overrides.items() if v is not None})
    return replace(Settings(), **found)
