"""Answer contract: context, citation, model call, clean-up, gates, response rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternfold import rules
from lanternfold.functions.text import SPACE, WORD, java_regex, numbers, split_sentences, strip
from lanternfold.rules import FUNDS, RulePack

_URL = rf"(?:https?://[^{SPACE}]+|www\.[^{SPACE}]+)"
_LABEL = rf"(?<![{WORD}]){rules.SOURCE_LABELS}(?![{WORD}])[{SPACE}]*[:\-]?[{SPACE}]*"
_AT_END = r"(?=[.;,]|\n?\z)"

# Fixed values. Order matters. A label goes together with its link, so that it is not stranded;
# one left with nothing behind it goes afterwards (also in prose ending on "from.").
URL_REWRITES = (
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (rf"(?iu){_LABEL}{_URL}", ""),
    (rf"(?iu){_URL}", ""),
    (rf"[{SPACE}]+([.,;:])", "$1"),
    (rf"\([{SPACE}]*\)|\[[{SPACE}]*\]", ""),
    (rf"(?iu){_LABEL}{_AT_END}", ""),
    (rf"[{SPACE}]*([.;,])[{SPACE}]*{_AT_END}", "$1"),
    (r"[ \t]{2,}", " "),
)
DECLINE = java_regex(rules.DECLINE_PATTERN, ignore_case=True)


def strip_urls(text: Column) -> Column:
    for pattern, by in URL_REWRITES:
        text = F.regexp_replace(text, pattern, by)
    return strip(text)


def trim_sentences(text: Column, limit: int = rules.MAX_SENTENCES) -> Column:
    parts = F.transform(F.split(strip(text), rf"(?<=[.!?])[{SPACE}]+"), strip)
    return F.array_join(F.slice(F.filter(parts, lambda x: x != ""), 1, limit), " ")


def postprocess(text: Column) -> Column:
    return trim_sentences(strip_urls(text))


def is_decline(text: Column) -> Column:
    return text.rlike(DECLINE)


def ungrounded_numbers(answer: Column, context: Column) -> Column:
    return F.array_sort(F.array_except(numbers(answer), numbers(context)))


def source_date(stamp: Column) -> Column:
    """ISO-8601 -> ``1 Oct 2026`` in the stamp's own offset; anything else is left as is."""
    iso = r"\A\d{4}-\d{2}-\d{2}(?:[T ].*)?\z"
    day = F.try_to_timestamp(F.substr(stamp, F.lit(1), F.lit(10)), F.lit("yyyy-MM-dd"))
    written = F.when(stamp.rlike(iso) & F.try_to_timestamp(stamp).isNotNull(), F.date_format(day, "d MMM yyyy"))
    return F.coalesce(written, stamp, F.lit(""))


def last_updated(stamp: Column) -> Column:
    date = source_date(stamp)
    return F.when(date == "", F.lit("")).otherwise(F.concat(F.lit(rules.LAST_UPDATED_LABEL), date))


# --- per-question views on the retrieved chunks (array of at most k structs, in rank order) ---

CHUNK_FIELDS = ("rank", "id", "url", "heading", "scheme", "fetched_at", "text", "distance", "score", "rank_note")


def gather(retrieved: DataFrame) -> DataFrame:
    """Rows of ``retrieve`` -> one row per question with its k chunks in rank order."""
    item = F.struct(*CHUNK_FIELDS)
    return retrieved.groupBy("question_id").agg(F.array_sort(F.collect_list(item)).alias("hits"))


def context_block(hits: Column) -> Column:
    blocks = F.transform(hits, lambda h: F.concat(
        F.lit("["), h["rank"].cast("string"), F.lit("] source: "), h["url"],
        F.lit("  (source date: "), h["fetched_at"], F.lit(")\n"), h["text"]))
    return F.when(F.size(hits) > 0, F.array_join(blocks, "\n\n")).otherwise(F.lit(rules.NO_CONTEXT))


def is_approved(url: Column, pack: RulePack = FUNDS) -> Column:
    out = url.isin(*pack.approved_urls)
    for prefix in pack.approved_prefixes:
        out = out | F.startswith(url, F.lit(prefix))
    return out


def best_url(hits: Column, pack: RulePack = FUNDS) -> Column:
    approved = F.filter(hits, lambda h: is_approved(h["url"], pack))
    return (
        F.when(F.size(hits) == 0, F.lit(pack.default_url))
        .when(F.size(approved) > 0, F.get(approved, F.lit(0))["url"])
        .otherwise(F.lit(pack.approved_urls[0]))
    )


def best_distance(hits: Column) -> Column:
    return F.array_min(F.transform(hits, lambda h: h["distance"]))


def is_low_confidence(hits: Column) -> Column:
    """Judged on raw distance over the returned chunks: a boost cannot buy confidence."""
    return (F.size(hits) == 0) | (best_distance(hits) > rules.LOW_CONFIDENCE_DISTANCE)


def debug_chunks(hits: Column) -> Column:
    return F.transform(hits, lambda h: F.struct(
        h["url"].alias("url"), h["heading"].alias("heading"), h["scheme"].alias("scheme"),
        h["fetched_at"].alias("fetched_at"), F.round(h["distance"], 4).alias("distance"),
        h["rank_note"].alias("rank_note")))


# --- models ---


class AnswerModel(Protocol):
    name: str

    def complete(self, question: Column, context: Column, hits: Column) -> Column:
        """Completion per row, a string or a struct of text and error; rows with a NULL question must not be sent.

        A model may have ``complete_rows(rows, question, context, out)`` instead, which adds that column."""


@dataclass(frozen=True)
class ExtractiveModel:
    """Offline default: the opening sentences of the best chunk."""

    sentences: int = 2
    name: str = "extractive"

    def complete(self, question: Column, context: Column, hits: Column) -> Column:
        opening = F.slice(split_sentences(F.get(hits, F.lit(0))["text"]), 1, self.sentences)
        return F.when(question.isNotNull(), F.array_join(opening, " "))


@dataclass(frozen=True)
class CallableModel:
    """Any ``call(system_prompt, user_prompt, temperature=0, max_tokens=300) -> str``.

    Runs inside the tasks, one call per question that passed the gates. A call that fails leaves its
    error with its own question. A task that is repeated calls again; ``LedgerModel`` does not.
    """

    call: Callable[..., str]
    system_prompt: str | None = None  # None: the rule pack's own
    name: str = "callable"

    def complete(self, question: Column, context: Column, hits: Column) -> Column:
        call, system_prompt = self.call, self.system_prompt or rules.SYSTEM_PROMPT

        @F.pandas_udf("text string, error string")
        def ask(questions: pd.Series, contexts: pd.Series) -> pd.DataFrame:
            texts, errors = [], []
            for q, c in zip(questions, contexts):
                text = error = None
                if q is not None:
                    try:
                        # Fixed value: the frame of the user prompt.
                        text = call(system_prompt, f"CONTEXT:\n{c}\n\nQUESTION: {q}", temperature=0, max_tokens=300)
                        text = text if text and text.strip() else ""
                    except Exception as exc:
                        error = f"{type(exc).__name__}: {exc}"
                texts.append(text)
                errors.append(error)
            return pd.DataFrame({"text": texts, "error": errors}, dtype=object)

        # A call costs money. Declared so, no filter or projection above repeats it.
        return ask.asNondeterministic()(question, context)


def _debug(**fields: Column) -> Column:
    """The one debug struct all response shapes share; absent parts are NULL."""
    shape = {
        "intent": "string", "error": "string", "pii_types": "array<string>", "reason": "string", "model": "string",
        "best_distance": "double", "ungrounded_numbers": "array<string>",
        "chunks": "array<struct<url:string,heading:string,scheme:string,fetched_at:string,"
                  "distance:double,rank_note:string>>",
    }
    return F.struct(*[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in shape.items()])


def respond(rows: DataFrame, model: AnswerModel, pack: RulePack = FUNDS,
            manifest_stamp: str | None = None) -> DataFrame:
    """``question_id, question, hits`` -> response rows. Gates: confidence, empty
    completion, decline, figures that the retrieved text does not hold. A failed call is a response that says so."""
    if getattr(model, "system_prompt", "") is None:
        model = replace(model, system_prompt=pack.system_prompt)
    hits = F.coalesce(F.col("hits"), F.array().cast(rows.schema["hits"].dataType))
    staged = (
        rows.withColumn("hits", hits)
        .withColumn("_low", is_low_confidence(F.col("hits")))
        .withColumn("_context", context_block(F.col("hits")))
        .withColumn("_prompt", F.when(~F.col("_low"), F.col("question")))
    )
    if hasattr(model, "complete_rows"):
        staged = model.complete_rows(staged, "_prompt", "_context", "_raw")
    else:
        staged = staged.withColumn("_raw", model.complete(F.col("_prompt"), F.col("_context"), F.col("hits")))
    if isinstance(staged.schema["_raw"].dataType, T.StructType):
        staged = staged.withColumn("_error", F.col("_raw.error")).withColumn("_raw", F.col("_raw.text"))
    else:
        staged = staged.withColumn("_error", F.lit(None).cast("string"))
    found = F.array_join(F.transform("hits", lambda h: h["text"]), " ")
    staged = (
        staged.withColumn("_answer", postprocess(F.coalesce("_raw", F.lit(""))))
        .withColumn("_orphans", ungrounded_numbers(F.col("_answer"), found))
        .withColumn("_gate",
                    F.when(F.col("_error").isNotNull(), F.lit("model_unavailable"))
                    .when(F.col("_low") | (F.col("_answer") == ""), F.lit("low_confidence"))
                    .when(is_decline(F.col("_answer")), F.lit("model_declined"))
                    .when(F.size("_orphans") > 0, F.lit("ungrounded_number")))
    )
    gate = F.col("_gate")
    failed = F.coalesce(gate == "model_unavailable", F.lit(False))
    absent = gate.isin("low_confidence", "ungrounded_number", "model_unavailable")
    declined = F.coalesce(gate == "model_declined", F.lit(False))
    absent = F.coalesce(absent, F.lit(False))
    stamp = F.coalesce(F.lit(manifest_stamp or None), F.get("hits", F.lit(0))["fetched_at"])
    return staged.select(
        "question_id",
        F.when(failed, F.lit(rules.MODEL_UNAVAILABLE)).when(absent, F.lit(pack.not_in_pages)).otherwise(F.col("_answer")).alias("answer"),
        F.when(declined, F.lit(pack.default_url)).otherwise(best_url(F.col("hits"), pack)).alias("citation_url"),
        F.when(declined, F.lit("")).otherwise(last_updated(stamp)).alias("last_updated_from_sources"),
        absent.alias("refused"),
        _debug(
            reason=gate, error=F.col("_error"),
            model=F.when(~absent, F.lit(model.name)),
            best_distance=F.when(absent, F.round(F.coalesce(best_distance(F.col("hits")), F.lit(0.0)), 4)),
            ungrounded_numbers=F.when(F.coalesce(gate == "ungrounded_number", F.lit(False)), F.col("_orphans")),
            chunks=debug_chunks(F.col("hits")),
        ).alias("debug"),
    )


def refuse(decisions: DataFrame) -> DataFrame:
    """Blocked questions -> response rows: constant text, no retrieval, no model."""
    return decisions.select(
        "question_id",
        F.col("message").alias("answer"),
        F.col("link").alias("citation_url"),
        F.lit("").alias("last_updated_from_sources"),
        F.lit(True).alias("refused"),
        _debug(intent=F.col("intent"), pii_types=F.col("pii_types")).alias("debug"),
    )


def empty_corpus(questions: DataFrame) -> DataFrame:
    return questions.select(
        "question_id",
        F.lit(rules.EMPTY_CORPUS).alias("answer"),
        F.lit(None).cast("string").alias("citation_url"),
        F.lit("").alias("last_updated_from_sources"),
        F.lit(True).alias("refused"),
        _debug(reason=F.lit("empty_corpus")).alias("debug"),
    )
