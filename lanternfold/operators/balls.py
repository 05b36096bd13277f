"""Ball partition of stored vectors, for exact search that opens only balls that can hold an answer.

Vectors of length one are dealt to the nearest of some centres (rows of the collection itself, those
with the least id hashes: at most ``CENTRES``, so what all tasks get is bounded). A ball keeps its
radius, its number of rows, and which schemes and topics its rows can be boosted for. For a question of length
one no member is nearer than 1 - <q, centre> - radius, and none scores below that less the largest boost the
ball allows. A question first opens its most promising balls, until they hold k rows; then all others
whose bound is not above its k-th best score so far. Nothing else can hold one of its k best rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternfold.functions.kernel import HIT_BOOST, _matrix
from lanternfold.rules import SCHEME_BOOST
from lanternfold.session import stage

CENTRES = 4096
SLACK = 1e-7  # scores are rounded to nine digits; sums of floats differ by far less


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def scheme_bits(names: Column) -> Column:
    """64 bits; equal names set the same bit, so an empty intersection means no common name."""
    bits = F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda x: _bit(F.pmod(F.xxhash64(x), F.lit(64))))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def topic_bits(topics: Column) -> Column:
    """64 bits of topic positions (positions 64 apart share one)."""
    bits = F.transform(topics, lambda t: _bit(t % 64))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def _hit_bits(hits: Column) -> Column:
    """The topics that a chunk is boosted for."""
    places = F.transform(hits, lambda level, i: F.when(level != 0, i))
    return topic_bits(F.filter(places, lambda p: p.isNotNull()))


def chunk_bits(chunks: DataFrame) -> DataFrame:
    """Adds scheme_bits and topic_bits, 0 where the columns they come from are absent."""
    zero = F.lit(0).cast("long")
    scheme = scheme_bits(F.array("scheme")) if "scheme" in chunks.columns else zero
    topics = F.coalesce(_hit_bits(F.col("topic_hits")), zero) if "topic_hits" in chunks.columns else zero
    return chunks.withColumn("scheme_bits", scheme).withColumn("topic_bits", topics)


def question_bits(questions: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    scheme = scheme_bits(F.col("schemes")) if "schemes" in questions.columns else zero
    topics = topic_bits(F.col("topics")) if "topics" in questions.columns else zero
    return questions.withColumn("scheme_bits", scheme).withColumn("topic_bits", topics)


@dataclass
class Balls:
    """``members``: the chunks with their ``ball``. The rest has one entry per ball; ``along`` lists the
    balls so that near ones are neighbours."""

    members: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    rows: np.ndarray
    scheme_bits: np.ndarray
    topic_bits: np.ndarray
    along: np.ndarray

    def lowest(self, vectors: np.ndarray, schemes: np.ndarray, topics: np.ndarray, of=slice(None)) -> np.ndarray:
        """Question x ball (those that ``of`` names): no member scores lower than this."""
        out = vectors @ self.centres[of].T
        np.subtract(1.0 - SLACK - self.radius[of], out, out=out)
        out -= SCHEME_BOOST * ((schemes[:, None] & self.scheme_bits[of]) != 0)
        out -= max(HIT_BOOST.values()) * ((topics[:, None] & self.topic_bits[of]) != 0)
        return out

    def shared(self) -> tuple[np.ndarray, ...]:
        """What tasks need to know: ``Balls(None, *shared)``. Arrays only, as executors may lack the package."""
        return self.centres, self.radius, self.rows, self.scheme_bits, self.topic_bits, self.along

    def groups(self, rows: int) -> np.ndarray:
        """A group for each ball: neighbours, of so many rows together where no ball alone has more."""
        out, group, held = np.zeros(len(self.rows), np.int64), 0, 0
        for ball in self.along:
            if held and held + self.rows[ball] > rows:
                group, held = group + 1, 0
            out[ball], held = group, held + self.rows[ball]
        return out


def _along(centres: np.ndarray) -> np.ndarray:
    """The centres in an order in which each is followed by the nearest of those that are left."""
    out, left = [0], np.ones(len(centres), bool)
    for _ in range(1, len(centres)):
        left[out[-1]] = False
        out.append(int(np.where(left, centres @ centres[out[-1]], -np.inf).argmax()))
    return np.array(out)


def partition(chunks: DataFrame, n: int, rows_per_ball: int) -> Balls:
    """Deal ``n`` chunks (id, embedding, ...) to balls of about ``rows_per_ball`` rows."""
    count = min(CENTRES, max(1, math.ceil(n / rows_per_ball)))
    if count == 1:  # one ball with everything in it
        zero = np.zeros(1, np.int64)
        return Balls(chunks.withColumn("ball", F.lit(0)), np.zeros((1, 1)), np.full(1, np.inf), np.full(1, n), zero, zero, zero)
    sample = chunks.select("embedding", "id").orderBy(F.xxhash64("id"), "id").limit(count).toArrow()
    centres = _matrix(sample.column("embedding"), sample.num_rows)
    if len(centres) < count:
        count = len(centres)
    sent = chunks.sparkSession.sparkContext.broadcast(centres)

    def deal(batches):
        for batch in batches:
            vectors = _matrix(batch.column(batch.schema.get_field_index("embedding")), batch.num_rows)
            if batch.num_rows and vectors.shape[1] != sent.value.shape[1]:
                raise ValueError(f"question width {sent.value.shape[1]}, chunk width {vectors.shape[1]}")
            nearest, apart = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for at in range(0, batch.num_rows, 1024):
                products = vectors[at : at + 1024] @ sent.value.T
                best = products.argmax(axis=1)
                nearest[at : at + 1024] = best
                apart[at : at + 1024] = np.sqrt(((vectors[at : at + 1024] - sent.value[best]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest), pa.array(apart)], names=[*batch.schema.names, "ball", "apart"])

    schema = T.StructType([*chunks.schema.fields, T.StructField("ball", T.IntegerType()), T.StructField("apart", T.DoubleType())])
    members = stage(chunks.mapInArrow(deal, schema), "balls")
    stats = chunk_bits(members).groupBy("ball").agg(
        F.max("apart").alias("radius"), F.count("*").alias("rows"),
        F.bit_or("scheme_bits").alias("scheme_bits"), F.bit_or("topic_bits").alias("topic_bits")).toArrow().sort_by("ball")
    of = stats.column("ball").to_numpy()
    out = [np.zeros(count), np.zeros(count, np.int64), np.zeros(count, np.int64), np.zeros(count, np.int64)]
    for into, name in zip(out, ("radius", "rows", "scheme_bits", "topic_bits"), strict=True):
        into[of] = stats.column(name).to_numpy()
    return Balls(members.drop("apart"), centres, *out, _along(centres))


def _bounds(balls: Balls, asked: DataFrame, schema: str, pick) -> DataFrame:
    """``pick(bounds of some questions, those balls' numbers, their k-th best scores so far)`` gives the places of
    the rows that come out and a column for them, ``schema``."""
    worst = ["worst"] if "worst" in asked.columns else []
    rows = question_bits(asked).select("question_id", "embedding", "scheme_bits", "topic_bits", *worst)
    spark: SparkSession = rows.sparkSession
    sent = spark.sparkContext.broadcast(balls.shared())

    def run(batches):
        b = Balls(None, *sent.value)
        held = b.along[b.rows[b.along] > 0]
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                some = batch.slice(at, 128)
                vectors = _matrix(some.column(1), some.num_rows)
                if vectors.shape[1] != b.centres.shape[1]:
                    raise ValueError(f"question width {vectors.shape[1]}, chunk width {b.centres.shape[1]}")
                most = some.column(4).to_numpy(zero_copy_only=False).astype(np.float64) if worst else np.full(some.num_rows, np.nan)
                most[np.isnan(most)] = np.inf
                q, made = pick(b.lowest(vectors, some.column(2).to_numpy(), some.column(3).to_numpy(), held), held, most)
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(q)), pa.array(made)], names=["question_id", "made"])

    kind = rows.schema["question_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"question_id {kind}, made {schema.split()[1]}").withColumnRenamed("made", schema.split()[0])


def _promising(bound: np.ndarray, held: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """True for each question's most promising balls, which have k rows together; of equal ones the first by number."""
    by = np.argsort(held)
    left, sizes, lines = bound[:, by], rows[held[by]], np.arange(len(bound))
    out, had = np.zeros(bound.shape, bool), np.zeros(len(bound), np.int64)
    for _ in range(min(k, len(held))):  # each has a row at least
        lines = lines[had[lines] < k]
        if not len(lines):
            break
        best = left[lines].argmin(axis=1)
        out[lines, by[best]], left[lines, best] = True, np.inf
        had[lines] += sizes[best]
    return out


def first_visits(balls: Balls, asked: DataFrame, k: int) -> DataFrame:
    """``question_id, home``: each question's most promising balls, with k rows together."""
    sizes = balls.rows

    def pick(bound, held, most):
        q, place = np.nonzero(_promising(bound, held, sizes, k))
        return q, held[place].astype(np.int64)

    return _bounds(balls, asked, "home bigint", pick)


def group_visits(balls: Balls, asked: DataFrame, groups: np.ndarray) -> DataFrame:
    """``question_id, home``: the groups with a ball that may hold a row not above ``worst``, the k-th best
    score so far (null: fewer rows are known)."""

    def pick(bound, held, most):
        of = groups[held]  # ascending, as groups are neighbours along the balls
        names, starts = np.unique(of, return_index=True)
        q, place = np.nonzero(np.minimum.reduceat(bound, starts, axis=1) <= most[:, None])
        return q, names[place]

    return _bounds(balls, asked, "home bigint", pick)


def opened(balls: Balls, asked: DataFrame, k: int) -> DataFrame:
    """``question_id, opened``: how many balls are among the most promising ones or may hold a row not above ``worst``."""
    sizes = balls.rows

    def pick(bound, held, most):
        wanted = _promising(bound, held, sizes, k) | (bound <= most[:, None])
        return np.arange(len(bound)), wanted.sum(axis=1).astype(np.int64)

    return _bounds(balls, asked, "opened bigint", pick)
