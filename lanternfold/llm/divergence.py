"""How far the sources of a language differ in their use of words.

1. Frequency filter. Each task counts in how many of its documents a term of a language occurs;
   the sums decide exactly which terms are kept.
2. Perfect hashes. Kept terms are cut into shards by hash, and a task makes each shard's minimal
   perfect hash, with its keys. Shards of frequent terms are sent to all tasks, as far as
   they stay below ``SENT`` bytes: whole classes of terms by the power of two of their document
   count, from the top. Terms of the classes below are counted per task by spelling, come to the task that
   holds their shard, and are looked up there in the same way.
3. Recount. The second pass looks every term up, verifies the stored key, and increments a slot of
   the dense counts of its (language, source) and shard (a group that is seen rarely so far keeps its
   occurrences instead). Counts that fill a task's memory are handed on and begun anew; partial counts
   are added up per source and shard.
4. Divergence. A cell is a shard of terms and two blocks of sources; sums over the shards give
   the pairs. The most divergent terms of each source are taken per shard, then overall.

Arithmetic is in integers. A share's quotient is taken by long division in three steps, so it is
exact as long as a group's terms and kept terms are fewer than 9 * 10**15 together; a pair's sum stays below
2**63 as long as a language keeps fewer than 2 * 10**9 terms.

Null text, language and source count as ''. Rows that repeat are documents of their own. A group
without terms, and a language that keeps none, appear all the same. Texts of any length are read whole, in
bounded slices of documents. An empty table gives an empty result. Only text, lang and source are read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternfold.llm.common import release, stage
from lanternfold.llm.perfect_hash import PerfectHash, hashes, padded

MIN_DOCS = 3
SENT = 48 << 20  # bytes of keys sent to all tasks
PER_SHARD = 1 << 16  # terms, about
BLOCK = 128  # sources of a block, about
AT_ONCE = 1 << 21  # bytes of text looked up together
DENSE = 128 << 20  # bytes of counts a task holds
KEPT_ROWS = 400_000  # terms a task counts before it hands them on
TOP = 200

_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def shares(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 1) / (total + kept)), exactly."""
    divisor = total + kept
    whole, rest = np.divmod(counts.astype(np.int64) + 1, divisor)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, divisor)
        whole = whole * 1000 + more
    return whole + 1


def _documents(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(text.alias("text"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])


def _document_counts(docs: DataFrame) -> DataFrame:
    """lang, term, docs: in how many documents, counted by task."""

    def run(batches):
        held: dict[str, Counter] = {}

        def out():
            for lang, counter in held.items():
                terms = list(counter)
                for at in range(0, len(terms), 50_000):
                    some = terms[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([lang] * len(some), pa.string()), pa.array(some, pa.binary()),
                        pa.array([counter[t] for t in some], pa.int64())], names=["lang", "term", "docs"])
            held.clear()

        for batch in batches:
            langs = batch.column(1).to_pylist()
            for i, text in enumerate(batch.column(0)):
                held.setdefault(langs[i], Counter()).update(set(text.as_py().translate(_TERM).split()))
                if sum(map(len, held.values())) > KEPT_ROWS:
                    yield from out()
        yield from out()

    return docs.select("text", "lang").mapInArrow(run, "lang string, term binary, docs long").groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


def _bits(terms: int) -> int:
    return max(0, (terms // PER_SHARD).bit_length())


def _shard(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _shards(kept: DataFrame, hot: int, hot_bits: int, cold_bits: int) -> DataFrame:
    """lang, cold, shard, n, bytes, table: the perfect hash of each shard of the kept terms."""

    def numbered(batches):
        for batch in batches:
            terms = batch.column(1).to_pylist()
            lengths = np.array([len(t) for t in terms], np.int64)
            starts = np.cumsum(np.concatenate([[0], lengths])).astype(np.int64)[:-1]
            h = hashes(padded(b"".join(terms)), starts, lengths)
            cold = batch.column(2).to_numpy() < hot
            shard = np.where(cold, _shard(h, cold_bits), _shard(h, hot_bits))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(cold), pa.array(shard)], names=["lang", "term", "cold", "shard"])

    def build(batches):
        at, keys = None, []

        def made():
            table = PerfectHash(keys).to_bytes()
            return pa.RecordBatch.from_pylist([dict(zip(_SHARD.names, (*at, len(keys), sum(map(len, keys)), table), strict=True))], schema=_SHARD)

        for batch in batches:
            for *key, term in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != at:
                    if keys:
                        yield made()
                    at, keys = key, []
                keys.append(term)
        if keys:
            yield made()

    rows = kept.select("lang", "term", "docs").mapInArrow(numbered, "lang string, term binary, cold boolean, shard long")
    dealt = rows.repartition("lang", "cold", "shard").sortWithinPartitions("lang", "cold", "shard")
    return stage(dealt.select("lang", "cold", "shard", "term").mapInArrow(
        build, "lang string, cold boolean, shard long, n long, bytes long, table binary"), "shards")


_SHARD = pa.schema([("lang", pa.string()), ("cold", pa.bool_()), ("shard", pa.int64()), ("n", pa.int64()),
                    ("bytes", pa.int64()), ("table", pa.binary())])
_COUNTED = "lang string, source string, whole boolean, cold boolean, shard long, slots binary, counts binary, total long, term binary, count long"
_COUNTED_ARROW = pa.schema([
    ("lang", pa.string()), ("source", pa.string()), ("whole", pa.bool_()), ("cold", pa.bool_()), ("shard", pa.int64()),
    ("slots", pa.binary()), ("counts", pa.binary()), ("total", pa.int64()), ("term", pa.binary()), ("count", pa.int64())])


def _packed(counts: np.ndarray) -> bytes:
    """In the least width that holds them; ``_unpacked`` tells it by the length."""
    return counts.astype(next(t for t in ("<u1", "<u2", "<u4", "<i8") if counts.max() <= np.iinfo(t).max)).tobytes() if len(counts) else b""


def _unpacked(slots: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    at = np.frombuffer(slots, "<i4")
    width = len(counts) // max(1, len(at))
    return at, np.frombuffer(counts, {0: "<u1", 1: "<u1", 2: "<u2", 4: "<u4", 8: "<i8"}[width]).astype(np.int64)


def _slots(lang, source, whole, cold, shard, at: np.ndarray, counts: np.ndarray) -> dict:
    return {"lang": lang, "source": source, "whole": whole, "cold": cold, "shard": shard, "slots": at.astype("<i4").tobytes(),
            "counts": _packed(counts), "total": int(counts.sum())}


class _Slots:
    """Counts of the groups a task meets, by language, source and shard: a slot for each kept term once a
    group has half as many occurrences as the shard has terms, until then the occurrences themselves."""

    def __init__(self):
        self.counts: dict[tuple, np.ndarray] = {}
        self.few: dict[tuple, list[np.ndarray]] = {}
        self.sizes: dict[tuple, int] = {}
        self.bytes = 0

    def add(self, group: tuple, shard: int, n: int, slots: np.ndarray, by: int = 1) -> None:
        key = (*group, shard)
        counts = self.counts.get(key)
        if counts is None:
            held = self.sizes.get(key, 0) + len(slots)
            if by == 1 and 2 * held < n:
                self.few.setdefault(key, []).append(slots.astype(np.int32))
                self.sizes[key], self.bytes = held, self.bytes + 4 * len(slots)
                return
            counts = self.counts[key] = np.zeros(n, np.int64)
            self.bytes += 8 * n - 4 * self.sizes.pop(key, 0)
            for some in self.few.pop(key, ()):
                np.add.at(counts, some, 1)
            self.sizes.pop(key, None)
        np.add.at(counts, slots, by)

    def rows(self, cold: bool) -> list[dict]:
        """One row for each group and shard, and one for the language as a whole."""
        whole: dict[tuple, np.ndarray] = {}
        out = []

        def put(lang, source, shard, at, counts):
            out.append(_slots(lang, source, False, cold, shard, at, counts))
            total = whole.get((lang, shard), np.zeros(0, np.int64))
            if len(at) and at[-1] >= len(total):
                total = np.concatenate([total, np.zeros(int(at[-1]) + 1 - len(total), np.int64)])
            total[at] += counts
            whole[lang, shard] = total

        for (lang, source, shard), counts in self.counts.items():
            at = np.flatnonzero(counts)
            put(lang, source, shard, at, counts[at])
        for (lang, source, shard), some in self.few.items():
            put(lang, source, shard, *np.unique(np.concatenate(some), return_counts=True))
        for (lang, shard), counts in whole.items():
            at = np.flatnonzero(counts)
            out.append(_slots(lang, None, True, cold, shard, at, counts[at]))
        self.counts, self.few, self.sizes, self.bytes = {}, {}, {}, 0
        return out


def _batches(rows: list[dict]):
    for at in range(0, len(rows), 500):
        yield pa.RecordBatch.from_pylist(rows[at : at + 500], schema=_COUNTED_ARROW)


def _recount(docs: DataFrame, sent: dict[str, dict[int, bytes]], bits: int, cold: bool) -> DataFrame:
    """Partial counts of terms sent to all tasks; with ``cold``, also rows of all other terms as spelled."""
    tables = docs.sparkSession.sparkContext.broadcast(sent)

    def run(batches):
        known: dict[str, dict[int, PerfectHash]] = {}
        held, others = _Slots(), Counter()

        def look(langs, sources, texts):
            place = {}
            for i, lang in enumerate(langs):
                place.setdefault(lang, []).append(i)
            for lang, rows in place.items():
                if lang not in known:
                    known[lang] = {s: PerfectHash.from_bytes(t) for s, t in tables.value.get(lang, {}).items()}
                if not known[lang] and not cold:
                    continue
                raw = b" ".join([texts[i].translate(_TERM) for i in rows]) + b" "
                buffer = padded(raw)
                edges = np.flatnonzero(np.diff(np.concatenate([[True], buffer[: len(raw)] == 32])))
                starts, lengths = edges[::2].astype(np.int64), (edges[1::2] - edges[::2]).astype(np.int64)
                if not len(starts):
                    continue
                ends = np.cumsum([len(texts[i]) + 1 for i in rows])
                names = sorted({sources[i] for i in rows})
                number = {s: k for k, s in enumerate(names)}
                of = np.array([number[sources[i]] for i in rows])[np.searchsorted(ends, starts, side="right")]
                h = hashes(buffer, starts, lengths)
                shard = _shard(h, bits)
                order = np.lexsort((of, shard))
                cuts = np.flatnonzero(np.diff(shard[order])) + 1
                for some in np.split(order, cuts):
                    s = int(shard[some[0]])
                    table = known[lang].get(s)
                    slots = table.find(buffer, starts[some], lengths[some], h[some]) if table else np.full(len(some), -1)
                    if table:
                        found = slots >= 0
                        hit, group = slots[found], of[some][found]
                        for part in np.split(np.arange(len(hit)), np.flatnonzero(np.diff(group)) + 1):
                            if len(part):
                                held.add((lang, names[group[part[0]]]), s, table.n, hit[part])
                    if cold:
                        for j in some[slots < 0].tolist():
                            a = int(starts[j])
                            others[lang, names[of[j]], raw[a : a + int(lengths[j])]] += 1

        def out():
            rows = held.rows(False)
            rows += [{"lang": k[0], "source": k[1], "whole": False, "cold": True, "term": k[2], "count": n} for k, n in others.items()]
            others.clear()
            return _batches(rows)

        for batch in batches:
            langs, sources = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            texts, size = [], 0
            for i in range(batch.num_rows):
                texts.append(batch.column(0)[i].as_py())
                size += len(texts[-1])
                if size > AT_ONCE or i == batch.num_rows - 1:
                    first = i + 1 - len(texts)
                    look(langs[first : i + 1], sources[first : i + 1], texts)
                    texts, size = [], 0
                    if held.bytes > DENSE or len(others) > KEPT_ROWS:
                        yield from out()
        yield from out()

    return docs.select("text", "lang", "source").mapInArrow(run, _COUNTED)


def _visit(spelled: DataFrame, shards: DataFrame, bits: int) -> DataFrame:
    """Counts of the terms that came as spelled, in the tasks that hold their shards."""

    def numbered(batches):
        for batch in batches:
            terms = batch.column(2).to_pylist()
            lengths = np.array([len(t) for t in terms], np.int64)
            starts = np.cumsum(np.concatenate([[0], lengths])).astype(np.int64)[:-1]
            shard = _shard(hashes(padded(b"".join(terms)), starts, lengths), bits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], names=["lang", "source", "term", "count", "shard"])

    def count(batches):
        at, table, held = None, None, _Slots()
        for batch in batches:
            rows: list[dict] = []
            for lang, shard, made, source, term, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (lang, shard) != at:
                    rows += held.rows(True)
                    at, table = (lang, shard), None
                if made is not None:
                    table = PerfectHash.from_bytes(made)
                elif table is not None:
                    slot = table.find(padded(term), np.zeros(1, np.int64), np.array([len(term)], np.int64))
                    if slot[0] >= 0:
                        held.add((lang, source), shard, table.n, slot, n)
                        if held.bytes > DENSE:
                            rows += held.rows(True)
            yield from _batches(rows)
        yield from _batches(held.rows(True))

    nothing = F.lit(None)
    coming = spelled.select("lang", "source", "term", "count").mapInArrow(
        numbered, "lang string, source string, term binary, count long, shard long").groupBy("lang", "source", "term", "shard").agg(
        F.sum("count").alias("count"))
    held = shards.where("cold").select("lang", "shard", "table", nothing.cast("string").alias("source"),
                                       nothing.cast("binary").alias("term"), nothing.cast("long").alias("count"))
    rows = held.unionByName(coming.withColumn("table", nothing.cast("binary")))
    dealt = rows.repartition("lang", "shard").sortWithinPartitions("lang", "shard", F.col("source").asc_nulls_first())
    return dealt.select("lang", "shard", "table", "source", "term", "count").mapInArrow(count, _COUNTED)


def _merged(partial: DataFrame, shards: DataFrame) -> DataFrame:
    """One row for each group and shard: the sum of its partial counts."""

    def add(batches):
        at, total, rows = None, None, []

        def grown(n):
            return np.concatenate([total, np.zeros(max(0, n - len(total)), np.int64)])

        def summed():
            where = np.flatnonzero(total)
            return _slots(*at, where, total[where])

        for batch in batches:
            rows = []
            for *key, slots, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != at:
                    if at is not None:
                        rows.append(summed())
                    at, total = key, np.zeros(0, np.int64)
                where, more = _unpacked(slots, counts)
                if len(where):
                    total = grown(int(where[-1]) + 1)
                    total[where] += more
            yield from _batches(rows)
        if at is not None:
            yield from _batches([summed()])

    key = ["lang", "source", "whole", "cold", "shard"]
    dealt = partial.where("slots IS NOT NULL").select(*key, "slots", "counts").repartition(*key).sortWithinPartitions(*key)
    return stage(dealt.mapInArrow(add, _COUNTED).drop("term", "count"), "slots")


_FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _cells(tables: DataFrame, groups: DataFrame, merged: DataFrame, top: int) -> DataFrame:
    """Rows of the report before they are summed and ranked: pairs of a shard, terms of a shard."""

    def work(batches):
        sides: list = []
        counts: list[np.ndarray] = []
        whole = head = at = None

        def done():
            table, kept, all_terms, bi, bj = head
            keys = PerfectHash.from_bytes(table) if table is not None else None
            p = [np.stack([shares(c, n, kept) for c, (_, n) in zip(counts[s], sides[s], strict=True)]) if kept and len(counts[s])
                 else np.zeros((len(sides[s]), 0), np.int64) for s in (0, 1)]
            rows = []
            for a, b in ((0, 1), (1, 0)) if bi != bj else ((0, 0),):
                for i, (source, _) in enumerate(sides[a]):
                    apart = p[a][i][None, :] - p[b]
                    sums = (apart * apart // np.maximum(p[b], 1)).sum(axis=1).tolist()
                    rows += [(at[0], source, "pair", other, v) for (other, _), v in zip(sides[b], sums, strict=True) if other != source]
            if bi == bj and keys is not None:
                q = shares(whole, all_terms, kept)
                for (source, _), own, c in zip(sides[0], p[0], counts[0], strict=True):
                    more = np.flatnonzero((c > 0) & (own > q))
                    apart = own[more] - q[more]
                    value = apart * apart // q[more]
                    best = np.lexsort((more, -value))[:top]
                    rows += [(at[0], source, "term", keys.key(int(more[k])).decode("utf-8", "replace"), int(value[k])) for k in best.tolist()]
            for start in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows[start : start + 20_000], strict=True), _FOUND, strict=True)], schema=_FOUND)

        for batch in batches:
            for row in batch.to_pylist():
                key = (row["lang"], row["cold"], row["shard"], row["bi"], row["bj"])
                if row["head"]:
                    if at is not None:
                        yield from done()
                    at, head = key, (row["table"], row["kept"], row["all_terms"], row["bi"], row["bj"])
                    sides = [[(g["source"], g["terms"]) for g in row[s]] for s in ("left", "right")]
                    counts = [[np.zeros(row["n"], np.int64) for _ in side] for side in sides]
                    place = [{g[0]: k for k, g in enumerate(side)} for side in sides]
                    whole = np.zeros(row["n"], np.int64)
                    continue
                slots, found = _unpacked(row["slots"], row["counts"])
                for into in [whole] if row["whole"] else [counts[s][place[s][row["source"]]] for s in (0, 1) if row["source"] in place[s]]:
                    into[slots] = found
        if at is not None:
            yield from done()

    lists = groups.groupBy("lang", "block").agg(F.array_sort(F.collect_list(F.struct("source", "terms"))).alias("groups"),
                                                F.max("kept").alias("kept"), F.max("all_terms").alias("all_terms"))
    left = lists.select("lang", F.col("block").alias("bi"), F.col("groups").alias("left"), "kept", "all_terms")
    right = lists.select(F.col("lang"), F.col("block").alias("bj"), F.col("groups").alias("right"))
    of_lang = tables.select("lang", "cold", "shard", "n", "table")
    heads = left.join(right, "lang").where("bi <= bj").join(of_lang, "lang", "left").select(
        "lang", F.coalesce("cold", F.lit(False)).alias("cold"), F.coalesce("shard", F.lit(0)).alias("shard"), "bi", "bj",
        F.lit(True).alias("head"), F.coalesce("n", F.lit(0)).alias("n"), "table", "left", "right", "kept", "all_terms")
    blocks = groups.select("lang", "source", "block", "blocks")
    mine = merged.where("NOT whole").join(blocks, ["lang", "source"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "lang", "cold", "shard", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "source", "whole", "slots", "counts")
    all_of = merged.where("whole").join(groups.select("lang", "block").distinct(), "lang").select(
        "lang", "cold", "shard", F.col("block").alias("bi"), F.col("block").alias("bj"), "source", "whole", "slots", "counts")
    rows = heads.unionByName(mine.unionByName(all_of).withColumn("head", F.lit(False)), allowMissingColumns=True)
    key = ["lang", "cold", "shard", "bi", "bj"]
    dealt = rows.repartition(*key).sortWithinPartitions(*key, F.col("head").desc())
    return dealt.mapInArrow(work, "lang string, source string, part string, item string, value long")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, sent: int = SENT, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank. ``sent`` bounds the bytes of keys that all tasks get.
    Jobs run in here; the result reads staged tables."""
    docs = _documents(docs)
    kept = stage(_document_counts(docs).where(F.col("docs") >= min_docs).withColumn("octave", F.floor(F.log2("docs")).cast("int")), "kept")
    classes = kept.groupBy("octave").agg(F.sum(F.octet_length("term") + F.lit(24)).alias("bytes"), F.count("*").alias("n")).collect()
    hot, room, cold_n = 1 << 62, sent, sum(r.n for r in classes)
    for r in sorted(classes, reverse=True):
        if r.bytes > room:
            break
        hot, room, cold_n = 1 << r.octave, room - r.bytes, cold_n - r.n
    hot_bits, cold_bits = _bits(sum(r.n for r in classes) - cold_n), _bits(cold_n)
    shards = _shards(kept, hot, hot_bits, cold_bits)
    tables: dict[str, dict[int, bytes]] = {}
    for row in shards.where("NOT cold").select("lang", "shard", "table").toLocalIterator():
        tables.setdefault(row.lang, {})[row.shard] = bytes(row.table)

    partial = _recount(docs, tables, hot_bits, cold_n > 0)
    if cold_n:
        partial = stage(partial, "recount")
        visited = _visit(partial.where("slots IS NULL"), shards, cold_bits)
        merged = _merged(partial.where("slots IS NOT NULL").unionByName(visited), shards)
        release(partial)
    else:
        merged = _merged(partial, shards)

    n = merged.groupBy("lang", "source", "whole").agg(F.sum("total").alias("terms"))
    found = docs.groupBy("lang", "source").agg(F.count("*").alias("docs")).select("lang", "source")
    sizes = found.groupBy("lang").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    kept_n = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    groups = found.join(n.where("NOT whole").select("lang", "source", "terms"), ["lang", "source"], "left").join(sizes, "lang").join(
        kept_n, "lang", "left").join(n.where("whole").select("lang", F.col("terms").alias("all_terms")), "lang", "left")
    groups = stage(groups.select(
        "lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("terms", "kept", "all_terms")], "blocks",
        F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block")), "groups")

    cells = stage(_cells(shards, groups, merged, top), "cells")
    release(kept, shards, merged, groups)
    pairs = cells.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    terms = cells.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)

