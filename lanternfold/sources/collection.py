"""The chunk collection: a versioned Parquet table with upsert by id, in buckets that grow with it.

An id's bucket is given by linear hashing: with N = 2**level + split buckets a hash is taken modulo
2**level, or modulo 2**(level + 1) where that falls below ``split``. When the bytes exceed
``bucket_bytes`` a bucket on average, buckets split one after another, each into two, and only those are rewritten.

A write makes a new part, ``_part=<name>/_bucket=<n>/``, with the new rows and nothing else. Rows
it supersedes are marked by bitmaps, 64 rows of a file to a word, in a small table beside it;
readers leave marked rows out. Old files of touched buckets are read for their ids only. When there are
more than ``PARTS`` parts, the smaller ones are merged into one.

A version is one file in the log: the parts (each with the buckets that were since rewritten), the
bitmap tables, the directory, the schema, the row count, and what the rows were made with. It is created only
if it does not exist: of two writers one fails and can start again from the version it lost to. Readers follow the
highest version, so a job that dies half-way leaves the old one in force. What the newest version does
not name can be removed with ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternfold.session import release, stage

BUCKET_BYTES = 128 << 20
PARTS = 16
NAMED = 1000  # buckets named in a filter; an upsert that touches more looks at the ids of all


class CorpusEmptyError(RuntimeError):
    def __init__(self, message: str = "Corpus not ingested. Run: python -m lanternfold ingest"):
        super().__init__(message)


class ConcurrentWriteError(RuntimeError):
    """Another writer committed the version this one was about to."""


class OtherMakerError(RuntimeError):
    """The collection was built with another embedder than the one it is read with."""


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """One row per key, the newest. An aggregate, so copies of one key are combined
    before the shuffle and a hot key costs no more than any other."""
    others = [c for c in rows.columns if c != key]
    newest = F.max_by(F.struct(*others), F.col(version)).alias("_row")
    return rows.groupBy(key).agg(newest).select(key, "_row.*")


def one_per_key(rows: DataFrame, key: str = "id") -> DataFrame:
    """One row per key: of several the last by the order of their other columns."""
    others = [c for c in rows.columns if c != key]
    whole = F.struct(*[F.col(f"`{c}`") for c in others])
    if "map<" in rows.schema.simpleString():  # maps have no order of their own
        last = F.max_by(whole, F.struct(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in others]))
    else:
        last = F.max(whole)
    return rows.groupBy(key).agg(last.alias("_row")).select(key, "_row.*")


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Incoming rows replace those with the same key; the rest stays. One row per key comes out."""
    new = one_per_key(incoming, key)
    kept = existing.join(incoming.select(key), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def bucket_of(key: Column, level: int, split: int) -> Column:
    """The bucket of a key in a directory of 2**level + split buckets."""
    hashed = F.xxhash64(key)
    low = F.pmod(hashed, F.lit(1 << level))
    return F.when(low < split, F.pmod(hashed, F.lit(2 << level))).otherwise(low).cast("int")


def directory(buckets: int) -> tuple[int, int]:
    """level and split of a directory of that many buckets."""
    level = buckets.bit_length() - 1
    return level, buckets - (1 << level)


_EMPTY = {"version": 0, "rows": 0, "parts": [], "dead": [], "level": 0, "split": 0, "made_with": {}, "schema": None}
_PLACE = ["_part", "_bucket", "_file", "_word"]


@dataclass
class Collection:
    spark: SparkSession
    path: str
    distance: str = "cosine"
    bucket_bytes: int = BUCKET_BYTES

    # --- the log ---

    def _fs(self, path: str):
        name = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return name.getFileSystem(self.spark._jsc.hadoopConfiguration()), name

    def _log(self) -> dict:
        """The newest version. Of each part: name, bytes, gone (buckets that were rewritten since)."""
        fs, folder = self._fs(f"{self.path}/_commits")
        if not fs.exists(folder):
            return dict(_EMPTY)
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        newest = max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json") and n[1:-5].isdigit()), default=0)
        if not newest:
            return dict(_EMPTY)
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.path}/_commits/v{newest}.json").first()[0])

    def version(self) -> int:
        """Highest committed version, 0 when there is none."""
        return self._log()["version"]

    def _commit(self, log: dict) -> int:
        """Put the next version in force: ``log`` is the one before with its changes."""
        new = {**log, "version": log["version"] + 1}
        fs, name = self._fs(f"{self.path}/_commits/v{new['version']}.json")
        try:
            out = fs.create(name, False)  # never over an existing file
        except Exception as exc:
            if fs.exists(name):
                raise ConcurrentWriteError(f"version {new['version']} exists already") from exc
            raise
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        return new["rows"]

    # --- reading ---

    def _placed(self, log: dict) -> DataFrame:
        """All rows of the files, live or not, with the part, bucket, file and row they lie at."""
        schema = T.StructType.fromJson(json.loads(log["schema"]))
        whole = T.StructType([*schema.fields, T.StructField("_part", T.StringType()), T.StructField("_bucket", T.IntegerType())])
        names = [f"{self.path}/_part={p['name']}" for p in log["parts"]]
        rows = self.spark.read.option("basePath", self.path).schema(whole).parquet(*names)
        for part in log["parts"]:
            if part["gone"]:
                rows = rows.where(~((F.col("_part") == part["name"]) & F.col("_bucket").isin(part["gone"])))
        row = F.col("_metadata.row_index")
        return rows.select("*", F.col("_metadata.file_name").alias("_file"), F.shiftright(row, 6).alias("_word"), (row % 64).cast("int").alias("_bit"))

    def _dead(self, log: dict) -> DataFrame:
        words = self.spark.read.parquet(*[f"{self.path}/{d}" for d in log["dead"]])
        return words.groupBy(*_PLACE).agg(F.bit_or("bits").alias("_bits"))

    def _live(self, log: dict, buckets: list[int] | None = None, parts: list[str] | None = None, narrow: bool = False) -> DataFrame:
        rows = self._placed(log)
        if narrow:
            rows = rows.select("id", *_PLACE, "_bit")
        if buckets is not None:
            rows = rows.where(F.col("_bucket").isin(buckets))
        if parts is not None:
            rows = rows.where(F.col("_part").isin(parts))
        if log["dead"]:
            marked = F.getbit(F.col("_bits"), F.col("_bit")) == 1
            rows = rows.join(self._dead(log), _PLACE, "left").where(~F.coalesce(marked, F.lit(False))).drop("_bits")
        return rows

    def _read(self, log: dict, ids: list[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(log["schema"]))
        if not log["parts"]:
            return self.spark.createDataFrame([], schema)
        buckets = None
        if ids is not None:
            wanted = self.spark.createDataFrame([(i,) for i in ids], "id string")
            found = wanted.select(bucket_of(F.col("id"), log["level"], log["split"])).distinct().limit(NAMED + 1).collect()
            buckets = [r[0] for r in found] if len(found) <= NAMED else None
        rows = self._live(log, buckets).select(*[f"`{f.name}`" for f in schema.fields])
        return rows if ids is None else rows.join(wanted.distinct(), "id", "left_semi")

    def read(self, made_with: dict | None = None, ids: list[str] | None = None) -> DataFrame:
        """All rows, or those of the listed ids (from their buckets only); an error if ``made_with`` disagrees with
        what they were made with."""
        log = self._log()
        if log["version"] == 0:
            raise CorpusEmptyError()
        self._same_maker(log, made_with, "read")
        return self._read(log, ids)

    @staticmethod
    def _same_maker(log: dict, made_with: dict | None, doing: str) -> None:
        stored = log["made_with"]
        other = {k: stored[k] for k, v in (made_with or {}).items() if stored.get(k, v) != v}
        if other:
            raise OtherMakerError(f"the collection was built with {other}, it is {doing} with {made_with}")

    def status(self) -> dict:
        """``populated, count, error``: an unreadable store is not reported as an empty one."""
        try:
            log = self._log()
            count = self._read(log).count() if log["version"] else 0
            return {"populated": count > 0, "count": count, "error": None}
        except Exception as exc:  # surfaced to the caller
            return {"populated": False, "count": 0, "error": f"{type(exc).__name__}: {exc}"}

    def is_populated(self) -> bool:
        try:
            return not self.read().isEmpty()
        except CorpusEmptyError:
            return False

    # --- writing ---

    def _bytes(self, path: str) -> int:
        fs, name = self._fs(path)
        return fs.getContentSummary(name).getLength() if fs.exists(name) else 0

    def _write(self, rows: DataFrame, level: int, split: int, size: int) -> dict | None:
        """Rows of about ``size`` bytes into a part of their own; None if there are none."""
        name = uuid.uuid4().hex
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-size // self.bucket_bytes))
        if size <= self.bucket_bytes:
            tasks = 1
        bucketed = rows.withColumn("_bucket", bucket_of(F.col("id"), level, split))
        bucketed.repartition(tasks, "_bucket").sortWithinPartitions("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/_part={name}")
        written = self._bytes(f"{self.path}/_part={name}")
        fs, folder = self._fs(f"{self.path}/_part={name}")
        held = any("=" in s.getPath().getName() for s in fs.listStatus(folder))
        return {"name": name, "bytes": written, "gone": []} if held else None

    def replace(self, rows: DataFrame, made_with: dict | None = None) -> int:
        """A version that holds these rows and no others."""
        log = self._log()
        staged = stage(one_per_key(rows), "replace")
        size = self._bytes(staged.staged_at)
        level, split = directory(max(1, -(-size // self.bucket_bytes)))
        part = self._write(staged, level, split, size)
        count = staged.count()
        release(staged)
        return self._commit({**log, "rows": count, "parts": [part] if part else [], "dead": [], "level": level, "split": split,
                             "made_with": made_with or {}, "schema": rows.schema.json()})

    def upsert(self, rows: DataFrame, made_with: dict | None = None) -> int:
        """Rows in, replacing those of the same id. Only the new rows and the marks of the old ones are
        written, and buckets that have grown too large. Rows of another maker are refused."""
        log = self._log()
        if not log["parts"]:
            return self.replace(rows, made_with)
        if made_with and not log["made_with"]:
            raise OtherMakerError(f"the collection does not say what it was built with, it is extended with {made_with}")
        self._same_maker(log, made_with, "extended")
        staged = stage(one_per_key(rows), "upsert")
        size = self._bytes(staged.staged_at)
        part = self._write(staged, log["level"], log["split"], size)
        if part is None:
            release(staged)
            return log["rows"]
        ids = staged.select("id").withColumn("_at", bucket_of(F.col("id"), log["level"], log["split"]))
        touched = [r[0] for r in ids.select("_at").distinct().limit(NAMED + 1).collect()]
        old = self._live(log, touched if len(touched) <= NAMED else None, narrow=True)
        bit = F.expr("shiftleft(1L, _bit)")
        marks = old.join(ids.select("id"), "id", "left_semi").groupBy(*_PLACE).agg(F.bit_or(bit).alias("bits"), F.count("*").alias("rows"))
        marks = stage(marks, "marks")
        dead, replaced = list(log["dead"]), marks.agg(F.sum("rows")).first()[0] or 0
        if replaced:
            dead.append(f"dead-{uuid.uuid4().hex}")
            marks.drop("rows").coalesce(1 if replaced < 10**6 else 64).write.parquet(f"{self.path}/{dead[-1]}")
        count = log["rows"] + staged.count() - replaced
        release(staged, marks)
        new = {**log, "rows": count, "parts": [*log["parts"], part], "dead": dead, "schema": self._with_columns(log, rows).json()}
        return self._commit(self._grown(self._merged(new)))

    @staticmethod
    def _with_columns(log: dict, rows: DataFrame) -> T.StructType:
        old = T.StructType.fromJson(json.loads(log["schema"]))
        for field in rows.schema:
            if field.name in old.names and old[field.name].dataType != field.dataType:
                raise ValueError(f"column {field.name} is stored as {old[field.name].dataType.simpleString()}, not as {field.dataType.simpleString()}")
        return T.StructType([*old.fields, *[f for f in rows.schema if f.name not in old.names]])

    def _rows_of(self, log: dict, **which) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(log["schema"]))
        return self._live(log, **which).select(*[f"`{f.name}`" for f in schema.fields])

    def _grown(self, log: dict) -> dict:
        """Splits buckets until they hold ``bucket_bytes`` on average; only these are rewritten."""
        size = sum(p["bytes"] for p in log["parts"])
        before = (1 << log["level"]) + log["split"]
        after = max(before, -(-size // self.bucket_bytes))
        if after == before:
            return log
        level, split = directory(after)
        # buckets that a directory of the new size divides: all below the old size that gain a sibling
        moved = sorted({_parent(b, log["level"], log["split"]) for b in range(before, after)})
        part = self._write(self._rows_of(log, buckets=moved), level, split, size * len(moved) // before)
        return {**log, "level": level, "split": split, "parts": self._without(log["parts"], moved) + ([part] if part else [])}

    def _without(self, parts: list[dict], buckets: list[int]) -> list[dict]:
        out = []
        for part in parts:
            fs, folder = self._fs(f"{self.path}/_part={part['name']}")
            held = {int(s.getPath().getName().split("=")[1]): s.getPath() for s in fs.listStatus(folder) if "=" in s.getPath().getName()}
            gone = sorted({*part["gone"], *(b for b in buckets if b in held)})
            lost = sum(fs.getContentSummary(held[b]).getLength() for b in gone if b not in part["gone"])
            if len(gone) < len(held):
                out.append({**part, "gone": gone, "bytes": part["bytes"] - lost})
        return out

    def _merged(self, log: dict) -> dict:
        """Of too many parts all but the largest ones as one, without marked rows; one table of bitmaps."""
        if len(log["parts"]) <= PARTS:
            return log
        small = sorted(log["parts"], key=lambda p: p["bytes"])[: len(log["parts"]) - PARTS // 2]
        names = [p["name"] for p in small]
        part = self._write(self._rows_of(log, parts=names), log["level"], log["split"], sum(p["bytes"] for p in small))
        rest = [p for p in log["parts"] if p["name"] not in names]
        dead = []
        if log["dead"]:
            left = self._dead(log).where(~F.col("_part").isin(names)).withColumnRenamed("_bits", "bits")
            dead = [f"dead-{uuid.uuid4().hex}"]
            left.write.parquet(f"{self.path}/{dead[0]}")
        return {**log, "parts": rest + ([part] if part else []), "dead": dead}

    def reset(self) -> None:
        """A version without rows; nothing to do for a new collection."""
        log = self._log()
        if log["version"]:
            self._commit({**log, "rows": 0, "parts": [], "dead": [], "made_with": {}})

    def vacuum(self) -> list[str]:
        """Remove folders that the newest version does not name; not while someone writes or reads an older one."""
        fs, name = self._fs(self.path)
        log = self._log()
        named = {f"_part={p['name']}" for p in log["parts"]} | set(log["dead"])
        gone = [s.getPath() for s in fs.listStatus(name) if s.getPath().getName().startswith(("_part=", "dead-")) and s.getPath().getName() not in named]
        for folder in gone:
            fs.delete(folder, True)
        return [folder.getName() for folder in gone]


def _parent(bucket: int, level: int, split: int) -> int:
    """The bucket of the directory (level, split) that held the rows of a bucket of a larger one."""
    low = bucket % (1 << level)
    return bucket % (2 << level) if low < split else low
