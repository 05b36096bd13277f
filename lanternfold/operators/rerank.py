"""Promote-only re-rank, split into what depends on the question and on the chunk alone.

A boost needs, per question, its topics and schemes, and per chunk, how each
topic is hit. Both sides are computed once per row, so scoring a pair needs no
text at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfold.functions.arrays import let, string_array
from lanternfold.functions.kernel import FACT_HIT, HEADING_HIT, HIT_BOOST, NO_HIT, TEXT_HIT
from lanternfold.functions.memo import per_session
from lanternfold.functions.text import has_phrase, phrase_text, strip
from lanternfold.rules import FUNDS, RulePack


def matched_topics(question: Column, pack: RulePack = FUNDS) -> Column:
    """``array<int>``: positions of the topics a question raises, in priority order."""

    def flags(prepared: Column) -> Column:
        return F.array(*[F.when(has_phrase(prepared, p), F.lit(i)) for i, p in enumerate(pack.topic_phrases.values())])

    return F.filter(let(phrase_text(question), flags), lambda x: x.isNotNull())


def topic_names(topics: Column, pack: RulePack = FUNDS) -> Column:
    names = string_array(pack.topics)
    return F.transform(topics, lambda i: F.get(names, i))


def matched_schemes(question: Column, pack: RulePack = FUNDS) -> Column:
    if not pack.scheme_phrases:
        return F.array().cast("array<string>")

    def flags(prepared: Column) -> Column:
        return F.array(*[F.when(has_phrase(prepared, p), F.lit(s)) for s, p in pack.scheme_phrases.items()])

    return F.filter(let(phrase_text(question), flags), lambda x: x.isNotNull())


def topic_hits(heading: Column, text: Column, pack: RulePack = FUNDS) -> Column:
    """``array<tinyint>``: per topic, the strongest place it appears in. A heading
    hit hides a fact hit on purpose, although it earns less."""

    def levels(head: Column, body: Column) -> Column:
        return F.array(*[
            F.when(has_phrase(head, phrases), F.lit(HEADING_HIT))
            .when(has_phrase(body, pack.topic_labels.get(topic, ())), F.lit(FACT_HIT))
            .when(has_phrase(body, phrases), F.lit(TEXT_HIT))
            .otherwise(F.lit(NO_HIT)).cast("tinyint")
            for topic, phrases in pack.topic_phrases.items()
        ])

    return let(phrase_text(heading), lambda head: let(phrase_text(text), lambda body: levels(head, body)))


@per_session
def _chunk_hits(pack: RulePack) -> Column:
    return topic_hits(F.col("heading"), F.col("text"), pack)


def feature_column(pack: RulePack) -> str:
    """Stored features bear the fingerprint of the rules they were made with."""
    return f"topic_hits_{pack.fingerprint}"


def with_chunk_features(chunks: DataFrame, pack: RulePack = FUNDS) -> DataFrame:
    """Adds the features of this pack's rules; rows that have them already keep them."""
    name = feature_column(pack)
    return chunks.withColumn(name, F.coalesce(name, _chunk_hits(pack)) if name in chunks.columns else _chunk_hits(pack))


def with_question_features(questions: DataFrame, column: str, pack: RulePack = FUNDS) -> DataFrame:
    return (
        questions.withColumn("topics", matched_topics(F.col(column), pack))
        .withColumn("schemes", matched_schemes(F.col(column), pack))
    )


def first_hit(topics: Column, hits: Column) -> Column:
    """``struct<topic, level>`` of the first raised topic the chunk hits, or NULL."""
    scored = F.transform(topics, lambda t: F.struct(t.alias("topic"), F.get(hits, t).alias("level")))
    return F.get(F.filter(scored, lambda s: s["level"] != NO_HIT), F.lit(0))


def hit_boost(level: Column) -> Column:
    out = F.lit(0.0)
    for value, boost in HIT_BOOST.items():
        out = F.when(level == value, F.lit(boost)).otherwise(out)
    return out


def rank_note(scheme_hit: Column, topic: Column, level: Column, pack: RulePack = FUNDS) -> Column:
    """Trace of the boosts, e.g. ``scheme+fact:ter``."""
    kind = F.when(level == HEADING_HIT, F.lit("heading")).when(level == FACT_HIT, F.lit("fact")).when(
        level == TEXT_HIT, F.lit("text"))
    return F.concat_ws(
        "+",
        F.when(scheme_hit, F.lit("scheme")),
        F.concat(kind, F.lit(":"), F.get(string_array(pack.topics), topic)),
    )
