"""Exact cosine top-k over the whole collection.

Chunks lie in balls (``balls``); a question opens its most promising balls first, which bounds its k-th best
score, then those that may hold a row within that bound, and no others. A small collection is one ball. What is
opened is dealt to cells, each a bounded number of questions against a bounded number of rows of neighbouring
balls, so that a question's vector goes to as few cells as tasks can hold. The number of tasks is that of any
shuffle. What leaves a cell is at most k narrow rows per question. They are merged in two levels, so the last one sees
k rows for each of a fixed number of shares, however many cells there were. Texts are
joined to the final winners.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternfold.functions.kernel import CANDIDATE_SCHEMA, QuestionBlock, block_top_k, boost_counts
from lanternfold.operators import balls as bl
from lanternfold.operators import rerank
from lanternfold.rules import FUNDS, SCHEME_BOOST, RulePack
from lanternfold.session import stage
from lanternfold.settings import Settings

SHARES = 256  # of the first merge
HEAVY = 1 << 25  # pairs of an average cell, some quarter of a second
CELL_TASKS, MOST_TASKS = 4, 4096  # tasks for each heavy cell, so that few tasks get several, and for all of them
CANDIDATE = ("question_id bigint, id string, distance double, score double, "
             "scheme_hit boolean, topic int, level int")


def _feature_columns(df: DataFrame, names: tuple[str, ...]) -> list[str]:
    return [c for c in names if c in df.columns]


@dataclass
class Grid:
    """How many questions and rows one task takes: as many as the settings allow, fewer where a small
    search would be a few tasks only."""

    questions: int
    rows: int

    @classmethod
    def of(cls, questions: int, rows: int, settings: Settings) -> "Grid":
        return cls(min(settings.cell_questions, max(1024, math.ceil(questions / 6))),
                   max(settings.cell_chunks, min(settings.task_chunks, max(4096, math.ceil(rows / 10)))))


def _cells(asked: DataFrame, balls: bl.Balls, homes: np.ndarray, visits: DataFrame, k: int, grid: Grid) -> DataFrame:
    """The k best chunks of each question in each part of the homes it visits; ``homes`` has that of each ball."""
    spark = asked.sparkSession
    held = np.bincount(homes, balls.rows)
    sizes = {r.home: r.n for r in visits.groupBy("home").agg(F.count("*").alias("n")).collect()}  # a row per ball or group, CENTRES at most
    plan = [(int(h), math.ceil(n / grid.questions), math.ceil(max(1, int(held[h])) / grid.rows)) for h, n in sizes.items()]
    parts = F.broadcast(spark.createDataFrame(plan, "home bigint, _cols bigint, _rows bigint"))
    several = len(balls.rows) > 1
    members, bits = balls.members.withColumn("home", F.lit(0).cast("long")), []
    if several:
        of = F.broadcast(spark.createDataFrame(list(enumerate(homes.tolist())), "ball int, home bigint"))
        members, asked, bits = balls.members.join(of, "ball"), bl.question_bits(asked), ["scheme_bits", "topic_bits"]
    left = (members.join(parts, "home").withColumn("_row", F.pmod(F.xxhash64("id"), F.col("_rows")))
            .withColumn("_col", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_cols") - 1))))
    right = (asked.join(visits.join(parts, "home"), "question_id").withColumn("_col", F.pmod(F.xxhash64("question_id"), F.col("_cols")))
             .withColumn("_row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rows") - 1))))
    cells, pairs = sum(cols * rows for _, cols, rows in plan), sum(n * int(held[h]) for h, n in sizes.items())
    sent, made = spark.sparkContext.broadcast(balls.shared()), bl.Balls

    def cell(chunk_table: pa.Table, question_table: pa.Table) -> pa.Table:
        found = block_top_k(QuestionBlock.from_arrow(question_table), chunk_table, k, made(None, *sent.value) if several else None)
        return pa.Table.from_batches(found, schema=CANDIDATE_SCHEMA)

    keys = ("home", "_row", "_col")
    left = left.select(*keys, *_feature_columns(left, ("ball", "id", "embedding", "scheme", "topic_hits")))
    right = right.select(*keys, *_feature_columns(right, ("question_id", "embedding", "schemes", "topics", "worst")), *bits)
    if cells > 1 and pairs >= HEAVY * cells:  # a cell's work is not that of its bytes, by which tasks would be made of several cells
        tasks = min(CELL_TASKS * cells, max(MOST_TASKS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, CANDIDATE)


@dataclass
class Search:
    """Questions against a collection that lies in balls. ``opened`` has how many balls a question (``question_id``) opens."""

    balls: bl.Balls
    found: DataFrame
    opened: DataFrame


def run_search(questions: DataFrame, chunks: DataFrame, k: int, settings: Settings, balls: bl.Balls | None = None) -> Search:
    """The k best chunks of every question in each opened cell (a superset of the answer).

    The questions' vectors are staged: every step reads them. ``balls`` made earlier spare the partition.
    """
    q = stage(questions.select(*_feature_columns(questions, ("question_id", "embedding", "schemes", "topics"))), "asked", n=F.count("*"))
    if balls is None:
        c = chunks.select(*_feature_columns(chunks, ("id", "embedding", "scheme", "topic_hits")))
        balls = bl.partition(c, c.count(), settings.cell_chunks)
    grid = Grid.of(q.observed["n"], int(balls.rows.sum()), settings)
    if len(balls.rows) == 1:
        first = q.select("question_id", F.lit(0).cast("long").alias("home"))
        return Search(balls, _cells(q, balls, np.zeros(1, np.int64), first, k, grid), q.select("question_id", F.lit(1).cast("long").alias("opened")))
    first = stage(bl.first_visits(balls, q, k), "first-visits")
    found = _best(_cells(q, balls, np.arange(len(balls.rows)), first, k, grid), k)
    ranked = found.groupBy("question_id").agg(F.max("score").alias("worst"), F.count("*").alias("n"))
    known = ranked.select("question_id", F.when(F.col("n") >= k, F.col("worst")).alias("worst"))
    bounded = stage(q.join(known, "question_id", "left"), "bounded")
    groups = balls.groups(grid.rows)
    more = stage(bl.group_visits(balls, bounded, groups), "group-visits")
    return Search(balls, _cells(bounded, balls, groups, more, k, grid), bl.opened(balls, bounded, k))


def top_k(questions: DataFrame, chunks: DataFrame, k: int, settings: Settings | None = None) -> DataFrame:
    """``question_id, rank, id, distance, score, ...``: ascending score, then distance, then id."""
    return _best(run_search(questions, chunks, k, settings or Settings()).found, k)


def opened(search: Search) -> DataFrame:
    """``question_id, opened, balls``: how many of the balls a question had to open."""
    return search.opened.groupBy("question_id").agg(F.sum("opened").alias("opened")).withColumn(
        "balls", F.lit(int((search.balls.rows > 0).sum())))


def _best(found: DataFrame, k: int) -> DataFrame:
    best = ("score", "distance", "id")
    share = F.pmod(F.xxhash64("id"), F.lit(SHARES))
    first = Window.partitionBy("question_id", "_share").orderBy(*best)
    kept = found.withColumn("_share", share).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
    last = Window.partitionBy("question_id").orderBy(*best)
    return kept.drop("_share").withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)


def retrieve(questions: DataFrame, collection: DataFrame, k: int | None = None,
             pack: RulePack = FUNDS, settings: Settings | None = None) -> DataFrame:
    """Re-ranked chunks per question: ``questions(question_id, question, embedding)``.

    Blank questions retrieve nothing. ``k`` of 0 or None means the default. Stored chunk
    features are used where they were made with this pack's rules, else made anew.
    """
    settings = settings or Settings()
    k = k or settings.top_k
    asked = rerank.with_question_features(
        questions.filter(rerank.strip(F.col("question")) != ""), "question", pack)
    stored = rerank.feature_column(pack)
    collection = rerank.with_chunk_features(collection, pack)
    found = run_search(asked, collection.withColumnRenamed(stored, "topic_hits"), k, settings).found
    winners = _best(found, k).withColumn(
        "rank_note", rerank.rank_note(F.col("scheme_hit"), F.col("topic"), F.col("level"), pack))
    texts = collection.select("id", "text", "url", "title", "scheme", "heading", "fetched_at", "chunk_index")
    return texts.join(winners.drop("scheme_hit", "topic", "level"), "id")


def boost_report(questions: DataFrame, collection: DataFrame, pack: RulePack = FUNDS, settings: Settings | None = None) -> DataFrame:
    """``rank_note, n, boost``: which boosts all pairs of questions and chunks get, and how many pairs each.

    Questions and chunks are counted by their features first; only distinct features meet, cell by
    cell, and a cell gives counts, never pairs."""
    settings = settings or Settings()
    asked = rerank.with_question_features(questions.filter(rerank.strip(F.col("question")) != ""), "question", pack)
    q = stage(asked.groupBy("schemes", "topics").agg(F.count("*").alias("n")), "question-features")
    held = rerank.with_chunk_features(collection, pack).withColumnRenamed(rerank.feature_column(pack), "topic_hits")
    c = held.groupBy("scheme", "topic_hits").agg(F.count("*").alias("n"))
    cols, rows = max(1, math.ceil(q.count() / settings.cell_questions)), int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of_row, of_col = (F.pmod(F.xxhash64(*names), F.lit(n)) for names, n in ((("scheme", "topic_hits"), rows), (("schemes", "topics"), cols)))
    left = c.withColumn("_row", of_row).withColumn("_col", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cols - 1).cast("long"))))
    right = q.withColumn("_col", of_col).withColumn("_row", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long"))))

    def cell(chunk_table: pa.Table, question_table: pa.Table) -> pa.Table:
        return boost_counts(question_table, chunk_table)

    found = left.groupBy("_row", "_col").cogroup(right.groupBy("_row", "_col")).applyInArrow(
        cell, "scheme_hit boolean, topic int, level int, pairs bigint")
    note = rerank.rank_note(F.col("scheme_hit"), F.col("topic"), F.col("level"), pack)
    boost = F.when(F.col("scheme_hit"), F.lit(SCHEME_BOOST)).otherwise(F.lit(0.0)) + rerank.hit_boost(F.col("level"))
    return found.groupBy(note.alias("rank_note")).agg(F.sum("pairs").alias("n"), F.round(F.max(boost), 4).alias("boost")).where("n > 0")


def with_distance(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cosine distance of two vector columns of the same row, in the JVM."""
    from lanternfold.operators.embed import dot

    length = F.sqrt(dot(F.col(a), F.col(a))) * F.sqrt(dot(F.col(b), F.col(b)))
    similarity = F.when(length > 0, dot(F.col(a), F.col(b)) / length).otherwise(F.lit(0.0))
    return pairs.withColumn("distance", F.lit(1.0) - similarity)
