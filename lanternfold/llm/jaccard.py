"""Near duplicates by a token-group matrix.

A document's tokens are its distinct runs of five words, as 64-bit hashes. Documents with
80 % or more of their joint tokens in common are linked; the result is who is connected.

1. Groups. Documents with the same smallest token (of those mostly made of common tokens: the
   smallest of these) are likely alike; each such bucket is partitioned around leaders, and
   a group is a leader with documents linked to it. So a
   group is connected from the start, whatever its size. Buckets that are more than a
   task's share of the bytes (fewer than there are partitions) are dealt to several tasks.
2. Matrix. Linked documents of m and M tokens share 4/9 (m + M) of them. Under any common order
   of tokens the first one they share then is within the first m - 4/9 (m + M) + 1 of the one and
   M - 4/9 (m + M) + 1 of the other: a fifth plus one at most, a ninth plus one for equal sizes. The matrix has these first
   tokens of all members, united by group, each with its least place. In the order used, tokens that
   many documents have come late, so that passages shared by many do not pair them. How
   many is looked up in bitmaps of fixed size; a false hit only moves a token. Many are at least more than
   tokens of few documents add up to where they share a slot. The matrix is read in slices of the
   tokens, so that a bitmap of fixed size tells those of several groups however many tokens there are.
3. Bounds. Pairs of groups whose sizes allow a link, that share a token placed early enough in both
   for these sizes, and the sketches of whose leaders differ in no more bits than leaders of linked groups
   in tokens, are looked at: leaders first. So documents of one family that differ from each other too much
   do not meet for the tokens of the family, which come after their own. Linked leaders connect their groups. As Jaccard distance obeys
   the triangle inequality, leaders further apart than both groups' radii and the allowed
   distance together exclude every link.
4. Opening. Other pairs of groups, unless connected by then, are opened: the smaller group's
   members that the inequality does not exclude are compared with those of the larger one,
   which is read once for all its pairs, until a link is found.

No pair is left out: groups are joined or excluded by exact sets. Null and empty texts and
texts without words have no tokens and are linked with nothing. Texts of fewer words are
one token. Equal texts have distance 0. Rows that repeat an id are documents of their own,
which count as that id; a null id is a document whose component may lack an id. An empty
table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfold.llm.common import release, row_of, stage
from lanternfold.llm.components import components

WORDS = 5
MANY, LEVELS = 10, 5  # tokens come later the more documents have them: above 10, 100, ... 100,000
COUNTED = 0.45  # share of a document's tokens that is counted: those that may move up as well
BITS = 26  # of the bitmap's size; about the logarithm of the number of first tokens
BUCKETS = 10  # bits of the slot by which counting is dealt out
MOST_BITS = 27  # of the bitmap that tells which tokens of a slice of the matrix several groups have
CELL = 400  # documents of a bucket compared with one another at a time
FAR = 0.2 + 1e-9
MICRO = 1_000_000  # radii of the matrix are in millionths, rounded up
AT_ONCE = 1 << 20  # bytes hashed together

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse
_MIX, _SHIFT = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> _SHIFT)) * _MIX
    return values ^ (values >> np.uint64(32))


def _byte_values() -> np.ndarray:
    low = np.arange(256, dtype=np.uint64)
    low[65:91] += np.uint64(32)  # A-Z as a-z
    return _mixed((low + np.uint64(1)) * _BASE)


class Shingler:
    """Token sets of texts, many bytes at a time.

    A word's hash is a polynomial in its bytes, from differences of running sums over the
    joined texts; a run's hash combines those of its words in order.
    """

    def __init__(self):
        self.bytes = _byte_values()
        self.powers = self.inverse = np.ones(0, np.uint64)

    def _tables(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, AT_ONCE + (AT_ONCE >> 2))
            self.powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BASE)]))
            back = np.uint64(pow(int(_BASE), -1, 1 << 64))
            self.inverse = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, back)]))

    def _some(self, texts: list[bytes]) -> list[np.ndarray]:
        blob = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        self._tables(len(blob))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.bytes[blob] * self.powers[: len(blob)], dtype=np.uint64)])
        edges = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[blob]])))
        starts, ends = edges[::2], edges[1::2]  # the blob ends in a space
        words = _mixed((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))
        runs = words.copy()
        if len(words) >= WORDS:
            runs = words[: len(words) - WORDS + 1] + np.uint64(WORDS)
            for k in range(1, WORDS):
                runs = (runs ^ (runs >> _SHIFT)) * _BASE + words[k : len(words) - WORDS + 1 + k]
            runs = _mixed(runs)
        at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        first = np.searchsorted(starts, at)
        out = []
        for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if j - i >= WORDS:
                found = np.sort(runs[i : j - WORDS + 1])
                out.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
            elif j > i:
                whole = np.array([j - i], np.uint64)
                for k in range(i, j):
                    whole = (whole ^ (whole >> _SHIFT)) * _BASE + words[k : k + 1]
                out.append(_mixed(whole))
            else:
                out.append(np.zeros(0, np.uint64))
        return out

    def sets(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Sorted distinct 64-bit tokens of each text."""
        out, some, size = [], [], 0
        for text in texts:
            text = text or b""
            if some and size + len(text) > AT_ONCE:
                out += self._some(some)
                some, size = [], 0
            some.append(text)
            size += len(text) + 1
        return out + self._some(some) if some else out


def needed(n: int) -> int:
    """How many first tokens a set of n needs: linked sets share ceil(0.8 n) of them."""
    return n - -(-8 * n // 10) + 1


def linked(a: np.ndarray, b: np.ndarray) -> tuple[bool, float]:
    """Whether two sets are linked, and their distance."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return 100 * both >= 80 * either, 1 - both / either


def _digest(tokens: np.ndarray) -> int:
    return int(((tokens ^ (tokens >> np.uint64(31))) * _MIX).sum(dtype=np.uint64).astype(np.int64))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def _blocks(tokens: np.ndarray, bits: int) -> tuple[list[int], list[bytes]]:
    """Buckets of bitmap slots, and the slots of the tokens in each."""
    inner = bits - BUCKETS
    slots = np.sort(tokens >> np.uint64(64 - bits))
    ends = np.searchsorted(slots >> np.uint64(inner), np.arange((1 << BUCKETS) + 1, dtype=np.uint64))
    inside = (slots & np.uint64((1 << inner) - 1)).astype(np.uint16 if inner <= 16 else np.uint32)
    full = np.flatnonzero(np.diff(ends)).tolist()
    return full, [inside[ends[i] : ends[i + 1]].tobytes() for i in full]


def _outline(docs: DataFrame, bits: int) -> DataFrame:
    """Rows of two kinds. Of documents: doc_id, n and bytes. Of batches: bucket and block, the
    bitmap slots of the documents' lower tokens, a bucket's together."""
    names = ["doc_id", "n", "bytes", "bucket", "block"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches):
        shingler = Shingler()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sets = shingler.sets(texts)
            n = len(texts)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([len(t or b"") for t in texts], pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
            full, blocks = _blocks(np.concatenate([np.zeros(0, np.uint64), *[s[: int(COUNTED * len(s)) + 1] for s in sets]]), bits)
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(full), t) for t in types[:3]], pa.array(full, pa.int32()),
                                              pa.array(blocks, pa.binary())], names=names)

    return _texts(docs).mapInArrow(run, "doc_id long, n long, bytes long, bucket int, block binary")


def _bounds(many: int, counted: int, bits: int) -> list[int]:
    """From how many documents on a token is of each level: more than the other tokens that ``counted`` ones
    put into a slot of a bitmap, all but few times, else most tokens of a large corpus would be of the same level."""
    load = counted / (1 << bits)
    return [max(many * 10**level, int(load + 4 * load**0.5)) for level in range(LEVELS)]


def _bitmap(outline: DataFrame, bits: int, bounds: list[int]) -> np.ndarray:
    """For each bound the bits of slots that have more tokens: 2**bits of them, whatever the
    input. A task counts one bucket after another, in as many counters as a bucket has slots."""
    inner = bits - BUCKETS
    kind = np.uint16 if inner <= 16 else np.uint32

    def count(batches):
        at, counts = None, None

        def done():
            planes = b"".join(np.packbits(counts > bound, bitorder="little").tobytes() for bound in bounds)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([planes])], names=["bucket", "bits"])

        for batch in batches:
            for bucket, block in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if bucket != at:
                    if at is not None and (counts > bounds[0]).any():
                        yield done()
                    at, counts = bucket, np.zeros(1 << inner, np.int64)
                counts += np.bincount(np.frombuffer(block, kind), minlength=1 << inner)
        if at is not None and (counts > bounds[0]).any():
            yield done()

    blocks = outline.where("bucket IS NOT NULL").select("bucket", "block").repartition("bucket").sortWithinPartitions("bucket")
    out = np.zeros((len(bounds), 1 << BUCKETS, 1 << (inner - 6)), np.uint64)
    for row in blocks.mapInArrow(count, "bucket int, bits binary").toPandas().itertuples():
        out[:, row.bucket] = np.frombuffer(row.bits, np.uint64).reshape(len(bounds), -1)
    return out.reshape(len(bounds), -1)


def _levels(tokens: np.ndarray, common: np.ndarray) -> np.ndarray:
    slots = tokens >> np.uint64(65 - (common.shape[1] * 64).bit_length())
    return ((common[:, (slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63))) & np.uint64(1)).sum(axis=0)


def _key(tokens: np.ndarray, common: np.ndarray) -> int | None:
    """The token by which a document finds its bucket: the smallest; of a document that is mostly
    common tokens the smallest of these. A copy with changes then misses the bucket only if the
    change hit that very token, not whenever it made a smaller one, so large families stay together."""
    if not len(tokens):
        return None
    low = tokens[: int(COUNTED * len(tokens)) + 1]
    often = _levels(low, common) > 0
    return int((low[often] if 2 * often.sum() >= len(low) else low)[0].astype(np.int64))


def _first_tokens(tokens: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The tokens that a set needs, in the order of levels and then of hashes."""
    late = _levels(tokens, common)
    return tokens[np.argsort(late, kind="stable")[: needed(len(tokens))]]


def sketch(tokens: np.ndarray) -> bytes:
    """128 bits: whether a set has an odd number of tokens in each of 128 classes. A token that only one of two
    sets has changes one bit, so sketches differ in no more bits than sets in tokens."""
    odd = np.bincount((tokens & np.uint64(127)).astype(np.int64), minlength=128) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def lead(sets: list[np.ndarray]) -> list[tuple[int, float]]:
    """For each set the position of its leader and the distance to it.

    Sets that hold most of the cell's common tokens lead first."""
    shape: dict[tuple[int, int], list[int]] = {}
    for i, s in enumerate(sets):
        shape.setdefault((len(s), _digest(s)), []).append(i)
    firsts = [members[0] for members in shape.values()]
    out: list[tuple[int, float]] = [(-1, 0.0)] * len(sets)
    if len(firsts) > 2:
        values, counts = np.unique(np.concatenate([sets[i] for i in firsts]), return_counts=True)
        weight = {i: float(np.mean(counts[np.searchsorted(values, sets[i])])) for i in firsts}
        firsts.sort(key=lambda i: (-weight[i], i))
    leaders: list[int] = []
    for i in firsts:
        s = sets[i]
        for j in leaders:
            t = sets[j]
            if 8 * len(s) > 10 * len(t) or 8 * len(t) > 10 * len(s):
                continue
            yes, distance = linked(s, t)
            if yes:
                out[i] = (j, distance)
                break
        else:
            leaders.append(i)
            out[i] = (i, 0.0)
    for members in shape.values():
        for i in members[1:]:
            out[i] = out[members[0]]
    return out


_GROUPED = ("doc_id long, n long, digest long, grp long, distance double, leads boolean, radius double, "
            "least_n long, most_n long, first array<long>, place array<int>, sketch binary")


def _grouped(docs: DataFrame, outline: DataFrame, common: np.ndarray, share: int | None) -> DataFrame:
    """A row per document with tokens: its group and distance; leaders also have the group's data."""
    spark = docs.sparkSession
    bitmap = spark.sparkContext.broadcast(common)

    def keyed(batches):
        shingler = Shingler()
        for batch in batches:
            least = [_key(s, bitmap.value) for s in shingler.sets(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], names=["doc_id", "text", "least"])

    texts = _texts(docs).mapInArrow(keyed, "doc_id long, text binary, least long").where("least IS NOT NULL")
    sizes = texts.groupBy("least").agg(F.sum(F.octet_length("text")).alias("held"), F.count("*").alias("rows"))
    if share is None:
        total = outline.agg(F.sum("bytes")).first()[0] or 0
        share = max(1, total // max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2))
    # each holds more than a partition's share, so there are fewer of them than partitions
    large = stage(sizes.where((F.col("held") > share) & (F.col("rows") > CELL)).select(
        "least", F.least(F.ceil(F.col("held") / share), F.ceil(F.col("rows") / CELL)).cast("long").alias("parts")), "large")
    cells = texts.join(F.broadcast(large), "least", "left").select(
        "least", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")), F.lit(0)).alias("part"), "doc_id", "text")

    def cluster(batches):
        shingler, at = Shingler(), TaskContext.get().partitionId() << 33
        rows: list[tuple] = []

        def settle(members):
            nonlocal at
            sets = shingler.sets([text for _, text in members])
            leaders = lead(sets)
            groups: dict[int, list[int]] = {}
            for i, (j, _) in enumerate(leaders):
                groups.setdefault(j, []).append(i)
            for j, inside in groups.items():
                firsts = [_first_tokens(sets[i], bitmap.value) for i in inside]
                places = np.concatenate([np.arange(len(f)) for f in firsts])
                order = np.argsort(places, kind="stable")
                first, where = np.unique(np.concatenate(firsts)[order], return_index=True)
                whole = (max(leaders[i][1] for i in inside), min(len(sets[i]) for i in inside),
                         max(len(sets[i]) for i in inside), first.view(np.int64), places[order][where].astype(np.int32), sketch(sets[j]))
                rows.extend((members[i][0], len(sets[i]), _digest(sets[i]), at, leaders[i][1], i == j,
                             *(whole if i == j else (None,) * 6)) for i in inside)
                at += 1

        def out():
            columns = [list(c) for c in zip(*rows, strict=True)]
            types = [pa.int64()] * 4 + [pa.float64(), pa.bool_(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            rows.clear()
            names = [f.split()[0] for f in _GROUPED.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        cell, members = None, []
        for batch in batches:
            for least, part, doc, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (least, part) != cell or len(members) == CELL:
                    settle(members)
                    cell, members = (least, part), []
                    if len(rows) >= 1000:
                        yield out()
                members.append((doc, text))
        settle(members)
        if rows:
            yield out()

    dealt = cells.repartition("least", "part").sortWithinPartitions("least", "part")
    return stage(dealt.mapInArrow(cluster, _GROUPED), "groups")


_PAIR = "ga long, gb long"


def latest(most: np.ndarray, least_other: np.ndarray) -> np.ndarray:
    """The last place, from 0, that the first shared token can have in a set of at most ``most`` tokens that is
    linked with one of at least ``least_other``."""
    return np.minimum((5 * most - 4 * least_other) // 9, most - -(-8 * most // 10))


def _pairs(batches):
    """Pairs of groups, the smaller number first, from rows that come ordered by token and group. Pairs that
    sizes, places or the sketches of their leaders rule out are left out; the others may come more than once."""
    rest = [np.zeros(0, np.int64)] * 7 + [np.zeros((0, 2), np.uint64)]

    def made(columns):
        token, least = columns[0], columns[3]
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        smallest = np.minimum.reduceat(least, starts)[np.cumsum(np.concatenate([[0], token[1:] != token[:-1]]))]
        early = columns[2] <= latest(columns[4], smallest)  # else too late for any partner here
        token, grp, place, least, most, n, radius, sketches = (c[early] for c in columns)
        if not len(token):
            return
        ends = np.flatnonzero(np.concatenate([token[1:] != token[:-1], [True]])) + 1
        starts = np.concatenate([[0], ends[:-1]])
        lengths = ends - starts
        for k in np.unique(lengths[lengths > 1]).tolist():
            of = starts[lengths == k]
            for i in range(1, k):  # each member with the one i places further on
                step = max(1, (1 << 18) // (k - i))
                for at in range(0, len(of), step):
                    x = (of[at : at + step, None] + np.arange(k - i)[None, :]).reshape(-1)
                    y = x + i
                    fits = (10 * most[x] >= 8 * least[y]) & (10 * most[y] >= 8 * least[x]) & (grp[x] != grp[y])
                    x, y = x[fits], y[fits]
                    fits = (place[x] <= latest(most[x], least[y])) & (place[y] <= latest(most[y], least[x]))
                    x, y = x[fits], y[fits]
                    differ = np.bitwise_count(sketches[x] ^ sketches[y]).sum(axis=1, dtype=np.int64)
                    # leaders of linked documents are at most so far apart, and sets as far apart differ in so many tokens
                    far = np.minimum(1.0, (radius[x] + radius[y]) / MICRO + FAR)
                    fits = differ <= far * (n[x] + n[y]) / (2 - far) + 1e-6
                    if fits.any():
                        yield np.stack([grp[x[fits]], grp[y[fits]]])

    def out(columns):
        seen: list[np.ndarray] = []
        size = 0
        for some in made(columns):
            seen.append(some)
            size += some.shape[1]
            if size > 1 << 19:
                yield batch_of(seen)
                seen, size = [], 0
        if seen:
            yield batch_of(seen)

    def batch_of(seen):
        found = np.concatenate(seen, axis=1)
        found = found[:, np.lexsort((found[1], found[0]))]
        new = np.concatenate([[True], (found[0, 1:] != found[0, :-1]) | (found[1, 1:] != found[1, :-1])])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found[:, new]], names=["ga", "gb"])

    for batch in batches:
        given = [c.to_numpy().astype(np.int64) for c in batch.columns[:7]]
        given.append(np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint64).reshape(-1, 2))
        columns = [np.concatenate([r, c]) for r, c in zip(rest, given, strict=True)]
        token = columns[0]
        if not len(token):
            continue
        cut = int(np.searchsorted(token, token[-1]))  # the last token may go on
        yield from out([c[:cut] for c in columns]) if cut else ()
        rest = [c[cut:] for c in columns]
    if len(rest[0]):
        yield from out(rest)


def _matrix(leaders: DataFrame, part: int, parts: int, held: int) -> DataFrame:
    """Tokens of a slice of the matrix that may be in several groups, with what bounds need of the group. A bitmap of
    slots with several tokens tells; it has two to four slots for each of the ``held`` tokens, of all slices, as long as
    a slice has no more than half of 2**``MOST_BITS`` (a fuller one drops fewer rows and changes nothing else)."""
    bits = min(MOST_BITS, max(BUCKETS + 10, (held // parts).bit_length() + 1))

    def sliced(tokens):
        mixed = _mixed(tokens.view(np.uint64))
        return mixed, mixed % np.uint64(parts) == part  # of the low bits, as slots are of the high ones

    def slots(batches):
        for batch in batches:
            mixed, inside = sliced(batch.column(0).flatten().to_numpy())
            full, blocks = _blocks(mixed[inside], bits)
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blocks, pa.binary())], names=["bucket", "block"])

    several = leaders.sparkSession.sparkContext.broadcast(_bitmap(leaders.select("first").mapInArrow(slots, "bucket int, block binary"), bits, [1]))
    names = ["token", "place", "grp", "least_n", "most_n", "n", "radius", "sketch"]

    def rows(batches):
        for batch in batches:
            first, ends = batch.column(0), batch.column(0).offsets.to_numpy()
            tokens, places = first.flatten().to_numpy(), batch.column(1).flatten().to_numpy()
            of = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            mixed, kept = sliced(tokens)
            kept[kept] = _levels(mixed[kept], several.value) > 0
            of = pa.array(of[kept])
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens[kept]), pa.array(places[kept]), *[c.take(of) for c in batch.columns[2:]]], names=names)

    given = leaders.select("first", "place", "grp", "least_n", "most_n", "n", F.ceil(F.col("radius") * MICRO).cast("long").alias("radius"), "sketch")
    made = given.mapInArrow(rows, "token long, place int, grp long, least_n long, most_n long, n long, radius long, sketch binary")
    return made.select("token", "grp", "place", "least_n", "most_n", "n", "radius", "sketch")


def _met(leaders: DataFrame, spent) -> DataFrame:
    """Pairs of groups that share a token of the matrix, from one slice after another. Most tokens are in one group and
    are dropped first. The files of a slice's shuffle go before the next one's."""
    held = leaders.agg(F.sum(F.size("first"))).first()[0] or 0
    parts = max(1, -(-held // (1 << (MOST_BITS - 1))))
    found = []
    for part in range(parts):
        spent()
        dealt = _matrix(leaders, part, parts, held).repartition("token").sortWithinPartitions("token", "grp")
        found.append(stage(dealt.mapInArrow(_pairs, _PAIR).distinct(), "pairs"))
    if parts == 1:
        return found[0]
    pairs = stage(reduce(DataFrame.unionByName, found).distinct(), "pairs")
    release(*found)
    return pairs


def _only(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, digest and text of the documents whose ids ``wanted`` has (few others slip in)."""
    place = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1))), F.lit(1 << BITS))
    words = wanted.select(place.alias("place")).groupBy((F.col("place") / 64).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits")).toPandas()
    marked = np.zeros(1 << (BITS - 6), np.uint64)
    marked[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    bitmap = docs.sparkSession.sparkContext.broadcast(marked)

    def run(batches):
        shingler = Shingler()
        for batch in batches:
            at = batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint64)
            hit = (bitmap.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
            some = batch.filter(pa.array(hit.astype(bool)))
            digests = [_digest(t) for t in shingler.sets(some.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(digests, pa.int64()), some.column(1)], names=["doc_id", "digest", "text"])

    return _texts(docs).withColumn("place", place).mapInArrow(run, "doc_id long, digest long, text binary").dropDuplicates(["doc_id", "digest"])


def _with_text(rows: DataFrame, texts: DataFrame, doc: str, digest: str, out: str) -> DataFrame:
    found = texts.select(F.col("doc_id").alias("__d"), F.col("digest").alias("__g"), F.col("text").alias(out))
    return rows.join(found, F.col(doc).eqNullSafe(F.col("__d")) & (F.col(digest) == F.col("__g"))).drop("__d", "__g")


def near_duplicates(docs: DataFrame, share: int | None = None, many: int = MANY, bits: int = BITS) -> DataFrame:
    """doc_id, n_shingles and component_id of every row. ``share`` replaces the bytes that a
    task may get. Jobs run in here; the result is a staged table, all others are removed."""
    spent = docs.sparkSession._jvm.System.gc  # Spark removes the files of shuffles when the driver has collected what names them
    width = 2 if bits - BUCKETS <= 16 else 4  # bytes of a slot in a block
    outline = stage(_outline(docs, bits), "outline", slots=F.sum(F.octet_length("block")))
    common = _bitmap(outline, bits, _bounds(many, (outline.observed["slots"] or 0) // width, bits))
    spent()
    grouped = _grouped(docs, outline, common, share)
    leaders = grouped.where("leads").select(
        "grp", "doc_id", "digest", "n", "radius", "least_n", "most_n", "first", "place", "sketch")

    pairs = _met(leaders, spent)

    # leaders
    heads = leaders.select("grp", "doc_id", "digest", "radius")
    asked = pairs.select(F.col("ga").alias("grp")).unionByName(pairs.select(F.col("gb").alias("grp"))).distinct()
    heads = stage(heads.join(asked, "grp"), "heads")
    spent()
    texts = stage(_only(docs, heads), "texts")
    with_text = _with_text(heads, texts, "doc_id", "digest", "text").select("grp", "radius", "text")
    sides = [with_text.select(F.col("grp").alias(f"g{s}"), F.col("radius").alias(f"r{s}"), F.col("text").alias(f"t{s}")) for s in "ab"]
    met = pairs.join(sides[0], "ga").join(sides[1], "gb").select("ga", "gb", "ra", "rb", "ta", "tb")

    def compare(batches):
        shingler = Shingler()
        for batch in batches:
            found = []
            for at in range(0, batch.num_rows, 500):
                x, y = (shingler.sets(batch.column(c).slice(at, 500).to_pylist()) for c in (4, 5))
                found += map(linked, x, y)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array([f[0] for f in found], pa.bool_()), pa.array([f[1] for f in found], pa.float64())],
                names=["ga", "gb", "ra", "rb", "linked", "apart"])

    seen = stage(met.mapInArrow(compare, "ga long, gb long, ra double, rb double, linked boolean, apart double"), "seen")
    tables = [outline, grouped, pairs, heads, texts, seen]
    links = seen.where("linked").select(F.col("ga").alias("a"), F.col("gb").alias("b"))
    labels = components(links)

    # pairs of groups that may hold a link all the same
    unsure = seen.where(f"NOT linked AND ra + rb > 0 AND apart <= ra + rb + {FAR}")
    for side in "ab":
        named = labels.select(F.col("node").alias(f"g{side}"), F.col("label").alias(f"l{side}"))
        unsure = unsure.join(named, f"g{side}", "left")
    unsure = stage(unsure.where("coalesce(la, ga) <> coalesce(lb, gb)").select("ga", "gb", "ra", "rb", "apart"), "unsure")
    spent()
    if not unsure.isEmpty():
        # The larger group stays, whole and once; of the other the members that may hold a link come to it.
        held = grouped.groupBy("grp").agg(F.count("*").alias("held"))
        for side in "ab":
            unsure = unsure.join(held.select(F.col("grp").alias(f"g{side}"), F.col("held").alias(f"h{side}")), f"g{side}")
        stays = F.col("ha") >= F.col("hb")
        visits = unsure.select(F.when(stays, F.col("ga")).otherwise(F.col("gb")).alias("home"),
                               F.when(stays, F.col("gb")).otherwise(F.col("ga")).alias("guest"),
                               (F.col("apart") - F.when(stays, F.col("ra")).otherwise(F.col("rb")) - FAR).alias("least"))
        visits = stage(visits, "visits")
        members = grouped.select("grp", "doc_id", "digest", "distance")
        at_home = visits.select("home").distinct().join(members, F.col("home") == F.col("grp")).select(
            "home", F.lit(None).cast("long").alias("guest"), "doc_id", "digest")
        coming = visits.join(members, (F.col("guest") == F.col("grp")) & (F.col("distance") >= F.col("least"))).select(
            "home", "guest", "doc_id", "digest")
        # a home that many come to is copied for each part of its guests
        coming = stage(coming.distinct(), "coming")
        parts = coming.groupBy("home").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts"))
        at_home = at_home.distinct().join(parts, "home").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        guests = coming.join(parts, "home").withColumn("part", F.pmod(F.xxhash64("doc_id", "digest"), F.col("parts")).cast("int"))
        opened = stage(at_home.unionByName(guests).drop("parts"), "opened")
        tables += [visits, coming, opened]
        sets = _with_text(opened, _only(docs, opened), "doc_id", "digest", "text").select("home", "part", "guest", "text")

        def search(batches):
            shingler, home, inside, met = Shingler(), None, [], set()
            for batch in batches:
                out = []
                tokens = shingler.sets(batch.column(3).to_pylist())
                for at, part, guest, found in zip(*[c.to_pylist() for c in batch.columns[:3]], tokens, strict=True):
                    if (at, part) != home:
                        home, inside, met = (at, part), [], set()
                    if guest is None:
                        inside.append(found)
                    elif guest not in met and any(
                            10 * len(x) >= 8 * len(found) and 10 * len(found) >= 8 * len(x) and linked(found, x)[0] for x in inside):
                        met.add(guest)
                        out.append((at, guest))
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

        ordered = sets.repartition("home", "part").sortWithinPartitions("home", "part", F.col("guest").asc_nulls_first())
        more = stage(ordered.mapInArrow(search, "a long, b long"), "more")
        tables.append(more)
        labels = components(links.unionByName(more))

    # a component may hold a third of all rows; a group holds CELL at most
    named = grouped.groupBy("grp").agg(F.min("doc_id").alias("low")).join(
        labels, F.col("grp") == F.col("node"), "left").select("grp", "low", F.coalesce("label", "grp").alias("label"))
    lowest = named.groupBy("label").agg(F.min("low").alias("component_id"))
    found = grouped.select("grp", "doc_id", F.col("n").alias("n_shingles")).join(
        named.join(lowest, "label").select("grp", "component_id"), "grp").select("doc_id", "n_shingles", "component_id")
    empty = outline.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    result = stage(found.unionByName(empty), "components")
    release(*tables)
    return result


def representatives(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest id, with its columns, whatever their names.
    Documents that share an id stay together; those without an id all stay."""
    lowest = near_duplicates(docs.where("doc_id IS NOT NULL")).where(F.col("doc_id") == F.col("component_id")).select("component_id").distinct()
    row = docs.select(row_of(docs))
    kept = row.join(lowest, F.col("row.doc_id").cast("long") == F.col("component_id"), "left_semi")
    return kept.unionByName(row.where("row.doc_id IS NULL")).select("row.*")
