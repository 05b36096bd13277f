"""Scoring of one block of chunks against one block of questions, inside a task.

Numpy and Arrow only: this module travels to the executors with the search job.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lanternfold.rules import FACT_BOOST, HEADING_BOOST, SCHEME_BOOST, TEXT_BOOST

NO_HIT, HEADING_HIT, FACT_HIT, TEXT_HIT = 0, 1, 2, 3
HIT_BOOST = {HEADING_HIT: HEADING_BOOST, FACT_HIT: FACT_BOOST, TEXT_HIT: TEXT_BOOST}

# Scores closer than this are ties, settled by distance and then by id: sums of
# floats in another order must not change a rank.
DECIMALS = 9

CANDIDATE_SCHEMA = pa.schema([
    ("question_id", pa.int64()), ("id", pa.string()), ("distance", pa.float64()), ("score", pa.float64()),
    ("scheme_hit", pa.bool_()), ("topic", pa.int32()), ("level", pa.int32()),
])


@dataclass
class QuestionBlock:
    """``vectors`` as given; ``worst``: no row that scores above it is wanted."""

    ids: np.ndarray
    vectors: np.ndarray
    schemes: list[tuple[str, ...]] = field(default_factory=list)
    topics: list[tuple[int, ...]] = field(default_factory=list)
    worst: np.ndarray | None = None
    scheme_bits: np.ndarray | None = None
    topic_bits: np.ndarray | None = None

    @classmethod
    def from_arrow(cls, table: pa.Table) -> "QuestionBlock":
        n, names = table.num_rows, table.column_names
        plain = [()] * n
        worst = table.column("worst").to_numpy().astype(np.float64) if "worst" in names else np.full(n, np.inf)
        return cls(
            table.column("question_id").to_numpy(),
            _rows(table.column("embedding"), n),
            [tuple(x) for x in table.column("schemes").to_pylist()] if "schemes" in names else plain,
            [tuple(x) for x in table.column("topics").to_pylist()] if "topics" in names else plain,
            np.where(np.isnan(worst), np.inf, worst),
            *[table.column(b).to_numpy() if b in names else None for b in ("scheme_bits", "topic_bits")],
        )


def _rows(column, n: int) -> np.ndarray:
    """Arrow list column -> its rows, in the precision they have."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def _lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", rows, rows, dtype=np.float64))


def _unit(rows: np.ndarray, length: np.ndarray) -> np.ndarray:
    return np.divide(rows, length[:, None], out=np.zeros(rows.shape), where=length[:, None] > 0)


def _matrix(column, n: int) -> np.ndarray:
    """Arrow list column -> unit rows in double precision."""
    rows = _rows(column, n)
    return _unit(rows, _lengths(rows))


def _beyond_copies(rows: np.ndarray, kind: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """False for rows that k equal rows with lesser ids are before: none of these is among k best."""
    n = len(rows)
    words = np.ascontiguousarray(rows).view(np.uint32).reshape(n, -1)
    odd = np.random.default_rng(1).integers(1, 1 << 62, words.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    key = kind.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, n, TILE):
        key[at : at + TILE] += (words[at : at + TILE] * odd).sum(axis=1, dtype=np.uint64)
    order = np.lexsort((place, key))
    follows = np.flatnonzero(key[order[1:]] == key[order[:-1]]) + 1
    same = np.zeros(n, bool)
    for at in range(0, len(follows), TILE):
        some = follows[at : at + TILE]
        one, other = order[some], order[some - 1]
        same[some] = (kind[one] == kind[other]) & (words[one] == words[other]).all(axis=1)
    start = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    keep = np.empty(n, bool)
    keep[order] = np.arange(n) - start < k
    return keep


def _kinds(chunks: pa.Table) -> tuple[list, np.ndarray | None, np.ndarray]:
    """Schemes and hits of the distinct kinds of rows, and the kind of each row."""
    n, names = chunks.num_rows, chunks.column_names
    code, schemes, hits = np.zeros(n, np.int64), [None], None
    if "scheme" in names:
        coded = chunks.column("scheme").combine_chunks().dictionary_encode(null_encoding="encode")
        schemes = coded.dictionary.to_pylist()
        code = coded.indices.to_numpy().astype(np.int64)
    of_scheme = code
    if "topic_hits" in names:
        hits = _rows(chunks.column("topic_hits"), n)
        for column in hits.T:  # codes stay small, however many topics there are
            values, place = np.unique(column, return_inverse=True)
            code = code * len(values) + place
            if len(values) > 1 and code.max() > 1 << 48:
                code = np.unique(code, return_inverse=True)[1].reshape(-1)
    _, first, kind = np.unique(code, return_index=True, return_inverse=True)
    return [schemes[i] for i in of_scheme[first]], hits if hits is None else hits[first].astype(np.int64), kind.reshape(-1)


TILE, ROWS = 2048, 512  # chunks and questions of one matrix product


def _similar(vectors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return vectors @ rows.T


def block_top_k(block: QuestionBlock, chunks: pa.Table, k: int, balls=None) -> list[pa.RecordBatch]:
    """The k best chunks of this table for every question of the block, none above its ``worst``.

    Rows of one kind, which get the same boost, lie together. A question meets the kinds it boosts most first and passes by
    those whose boost is too small for any distance, with ``balls`` also by tiles of balls that hold nothing for it. Pairs
    are scored in single precision, tile by tile; those that may be among a question's k best so far are scored anew in
    double precision.
    """
    n = chunks.num_rows
    if n == 0 or len(block.ids) == 0:
        return []
    ids = chunks.column("id").combine_chunks()
    place = np.empty(n, np.int64)
    place[pc.sort_indices(ids).to_numpy()] = np.arange(n)
    raw = _rows(chunks.column("embedding"), n)
    if raw.shape[1] != block.vectors.shape[1]:
        raise ValueError(f"question width {block.vectors.shape[1]}, chunk width {raw.shape[1]}")
    schemes, hits, kind = _kinds(chunks)
    ball = chunks.column("ball").to_numpy() if balls is not None else np.zeros(n, np.int32)
    line = np.argsort(balls.along)[ball] if balls is not None else ball
    order = np.lexsort((place, line, kind))
    order = order[_beyond_copies(raw, kind, place, k)[order]]
    n, width = len(order), raw.shape[1]
    length, asked_length = _lengths(raw), _lengths(block.vectors)
    slack = (width + 8) * 2.5e-7  # of sums in single precision
    near = np.empty((n, width), np.float32)
    for at in range(0, n, TILE):
        some = order[at : at + TILE]
        near[at : at + TILE] = _unit(raw[some], length[some])
    kind = kind[order]
    starts = np.append(np.flatnonzero(np.diff(kind, prepend=-1)), n)
    tiles = [[(at, min(end, at + TILE)) for at in range(start, end, TILE)] for start, end in zip(starts, starts[1:])]
    of_kind = dict(zip(kind[starts[:-1]].tolist(), tiles))
    if balls is not None:
        held, line = np.unique(line[order], return_inverse=True)
        held = balls.along[held]

    def exact(q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Distances of pairs."""
        out = np.empty(len(q))
        for s in range(0, len(q), 8 * TILE):
            a, b = q[s : s + 8 * TILE], order[at[s : s + 8 * TILE]]
            dot = np.einsum("ij,ij->i", block.vectors[a], raw[b], dtype=np.float64)
            norm = asked_length[a] * length[b]
            out[s : s + 8 * TILE] = np.divide(dot, norm, out=np.zeros(len(a)), where=norm > 0)
        return np.round(1.0 - out, DECIMALS)

    boost_of = np.zeros(4)
    for level, boost in HIT_BOOST.items():
        boost_of[level] = boost
    alike: dict[tuple, int] = {}  # questions with equal boosts
    of = np.array([alike.setdefault(key, len(alike)) for key in zip(block.schemes, block.topics)])
    shape = len(alike), len(schemes)
    in_scheme, topic, level = np.zeros(shape, bool), np.full(shape, -1, np.int32), np.zeros(shape, np.int32)
    for (wanted, raised), i in alike.items():
        in_scheme[i] = [s in wanted for s in schemes]
        for t in raised if hits is not None else ():
            new = (level[i] == 0) & (hits[:, t] != 0)
            topic[i, new], level[i, new] = t, hits[new, t]
    boosts = boost_of[level] + SCHEME_BOOST * in_scheme
    like = np.empty(len(alike), np.int64)  # those with similar boosts share matrix products
    like[np.lexsort(boosts.T)] = np.arange(len(alike))
    by_boost = np.argsort(like[of], kind="stable")
    picked: list[tuple] = []
    for start in range(0, len(of), ROWS):
        some = by_boost[start : start + ROWS]
        boost = boosts[of[some]]
        vectors = _unit(block.vectors[some], asked_length[some]).astype(np.float32)
        cut = block.worst[some].copy()
        best = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.float64, np.float64))  # row, at, distance, score
        if balls is not None:
            none = np.zeros(len(some), np.int64)
            low = balls.lowest(vectors, none, none, held)
        for which in sorted(of_kind, key=lambda c: -boost[:, c].max()):
            more = boost[:, which]
            for a, b in of_kind[which]:
                fits = -slack - more <= cut  # no distance is below 0
                if balls is not None and fits.any():
                    fits &= low[:, line[a] : line[b - 1] + 1].min(axis=1) - more <= cut
                rows = np.flatnonzero(fits)
                if not len(rows):
                    continue
                scores = _similar(vectors if len(rows) == len(some) else vectors[rows], near[a:b])  # 1 - distance
                least = (1.0 - slack - cut[rows] - more[rows]).astype(np.float32)
                up = np.flatnonzero(scores.max(axis=1) >= least)
                if not len(up):
                    continue
                rows, scores, least = rows[up], scores[up], least[up]
                hit = scores >= least[:, None]
                many = np.flatnonzero(hit.sum(axis=1) > 4 * k)
                if len(many) and b - a > k:
                    kth = np.partition(scores[many], b - a - k, axis=1)[:, b - a - k]
                    hit[many] = scores[many] >= np.maximum(least[many], kth - np.float32(2 * slack))[:, None]
                r, at = np.nonzero(hit)
                r, at = rows[r], at + a
                distance = exact(some[r], at)
                score = np.round(distance - more[r], DECIMALS)
                fits = score <= cut[r]
                best = tuple(np.concatenate([x, y[fits]]) for x, y in zip(best, (r, at, distance, score)))
                by = np.lexsort((place[order[best[1]]], best[2], best[3], best[0]))
                row = best[0][by]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                best = tuple(x[by[rank < k]] for x in best)
                last = rank == k - 1
                cut[row[last]] = np.minimum(cut[row[last]], best[3][rank[rank < k] == k - 1])
        row, at, distance, score = best
        pair = of[some[row]], kind[at]
        picked.append((block.ids[some][row], order[at], distance, score, in_scheme[pair], topic[pair], level[pair]))
    columns = [np.concatenate(c) for c in zip(*picked)]
    return [pa.RecordBatch.from_arrays(
        [ids.take(pa.array(c)).cast(f.type) if f.name == "id" else pa.array(c, f.type) for c, f in zip(columns, CANDIDATE_SCHEMA)],
        schema=CANDIDATE_SCHEMA,
    )]


BOOST_SCHEMA = pa.schema([("scheme_hit", pa.bool_()), ("topic", pa.int32()), ("level", pa.int32()), ("pairs", pa.int64())])


def boost_counts(questions: pa.Table, chunks: pa.Table) -> pa.Table:
    """How many pairs of these questions and chunks (rows stand for ``n`` of them) get which boost."""
    if not questions.num_rows or not chunks.num_rows:  # a cell that only one side has rows for
        return BOOST_SCHEMA.empty_table()
    weights = chunks.column("n").to_numpy()
    schemes = np.asarray(chunks.column("scheme").to_pylist(), dtype=object)
    hits = np.asarray(chunks.column("topic_hits").to_pylist(), dtype=np.int64).reshape(len(weights), -1)
    totals: dict[tuple[bool, int, int], int] = {}
    for wanted, raised, n in zip(*[questions.column(c).to_pylist() for c in ("schemes", "topics", "n")]):
        topic, level = np.full(len(weights), -1), np.zeros(len(weights), np.int64)
        for t in raised:
            new = (level == 0) & (hits[:, t] != 0)
            topic[new], level[new] = t, hits[new, t]
        in_scheme = np.isin(schemes, list(wanted)) if wanted else np.zeros(len(weights), bool)
        kinds, of = np.unique(np.stack([in_scheme, topic, level]), axis=1, return_inverse=True)
        counts = np.zeros(kinds.shape[1], np.int64)
        np.add.at(counts, of.reshape(-1), weights)
        for kind, count in zip(kinds.T.tolist(), counts.tolist()):
            key = (bool(kind[0]), kind[1], kind[2])
            totals[key] = totals.get(key, 0) + count * n
    return pa.Table.from_pylist([dict(zip(BOOST_SCHEMA.names, (*k, n))) for k, n in totals.items()], schema=BOOST_SCHEMA)
