"""Completions that are paid for once: a ledger of model calls by the digest of their prompt.

A prompt's key is a digest of model name, system prompt, context and question. Prompts that the ledger has
a completion for are not sent. Of all others each distinct one is called once; the outcome, text or
error, is written ahead to a file of its own the moment the call returns, before the task goes on. A task that
is repeated after a lost executor finds these files and calls only what is missing. When the calls are over
they become rows of the ledger (a collection), and the files go. A job that dies half-way leaves them, and the next
one takes them in first. A call that fails leaves an error with its own question and no other; later runs try it again.

The write-ahead folder must be one that all executors reach: a Hadoop path that ``pyarrow.fs`` can open.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfold import rules
from lanternfold.session import release, stage
from lanternfold.sources.collection import Collection

OUTCOME = "id string, text string, error string"
_OUTCOME = pa.schema([("id", pa.string()), ("text", pa.string()), ("error", pa.string())])


def _folder(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        found, root = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    else:
        found, root = fs.LocalFileSystem(), path
    return found, root.rstrip("/")


def _kept(files, path: str) -> dict | None:
    """An outcome written ahead, None if there is none."""
    try:
        with files.open_input_stream(path) as f:
            return json.loads(f.read())
    except (FileNotFoundError, ValueError):  # a file that was cut off counts as none
        return None


def _keep(files, path: str, outcome: dict) -> None:
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with files.open_output_stream(path) as f:
        f.write(json.dumps(outcome).encode())


@dataclass(frozen=True)
class LedgerModel:
    """``call(system_prompt, user_prompt, temperature=0, max_tokens=300) -> str`` behind a ledger at ``path``."""

    call: Callable[..., str]
    path: str
    system_prompt: str | None = None  # None: the rule pack's own
    name: str = "callable"
    tasks: int | None = None  # at most so many calls at a time; None: as many as there are shuffle partitions

    def key(self, question: Column, context: Column) -> Column:
        parts = [F.lit(self.name), F.lit(self.system_prompt or rules.SYSTEM_PROMPT), F.coalesce(context, F.lit("")), question]
        return F.sha2(F.to_json(F.array(*parts)), 256)

    def ledger(self, spark: SparkSession) -> Collection:
        return Collection(spark, f"{self.path.rstrip('/')}/completions")

    def _ahead(self) -> str:
        return f"{self.path.rstrip('/')}/ahead"

    def take_in(self, spark: SparkSession) -> int:
        """Outcomes written ahead become rows of the ledger. Only while no job makes calls."""
        fs, name = self.ledger(spark)._fs(self._ahead())
        if not fs.exists(name):
            return 0
        found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").schema(OUTCOME).json(self._ahead())
        rows = stage(found.where("id IS NOT NULL"), "ahead", n=F.count("*"))
        if rows.observed["n"]:
            self.ledger(spark).upsert(rows)
        n = rows.observed["n"]
        release(rows)
        fs.delete(name, True)
        return n

    def complete_rows(self, rows: DataFrame, question: str, context: str, out: str) -> DataFrame:
        """``rows`` with ``out``, a struct of text and error; null where the question is null."""
        spark = rows.sparkSession
        self.take_in(spark)
        keyed = rows.withColumn("_key", F.when(F.col(question).isNotNull(), self.key(F.col(question), F.col(context))))
        asked = keyed.where(F.col("_key").isNotNull()).groupBy(F.col("_key").alias("id")).agg(
            F.any_value(question).alias("question"), F.any_value(context).alias("context"))
        ledger = self.ledger(spark)
        if ledger.version():
            asked = asked.join(ledger.read().where("error IS NULL").select("id"), "id", "left_anti")
        asked = stage(asked, "asked")
        call, system_prompt, ahead = self.call, self.system_prompt or rules.SYSTEM_PROMPT, self._ahead()

        def run(batches):
            files, root = _folder(ahead)
            for batch in batches:
                for id, asks, found in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    path = f"{root}/{id[:2]}/{id}.json"
                    outcome = _kept(files, path)
                    if outcome is None:
                        try:
                            # Fixed value: the frame of the user prompt.
                            text = call(system_prompt, f"CONTEXT:\n{found}\n\nQUESTION: {asks}", temperature=0, max_tokens=300)
                            outcome = {"id": id, "text": text if text and text.strip() else "", "error": None}
                        except Exception as exc:
                            outcome = {"id": id, "text": None, "error": f"{type(exc).__name__}: {exc}"}
                        _keep(files, path, outcome)
                    yield pa.RecordBatch.from_pylist([outcome], schema=_OUTCOME)

        n = self.tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
        made = stage(asked.repartition(n, "id").select("id", "question", "context").mapInArrow(run, OUTCOME), "outcomes", n=F.count("*"))
        if made.observed["n"]:
            ledger.upsert(made)
            fs, name = ledger._fs(ahead)
            fs.delete(name, True)
        release(asked, made)
        stored = (ledger.read() if ledger.version() else spark.createDataFrame([], OUTCOME)).select(
            F.col("id").alias("_key"), F.struct("text", "error").alias(out))
        return keyed.join(stored, "_key", "left").drop("_key")
