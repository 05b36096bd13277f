"""Question batch -> responses: screen, redact, retrieve, generate, check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfold.operators import generate, guardrails, search
from lanternfold.operators.embed import Embedder, choose_embedder, embed
from lanternfold.rules import FUNDS, RulePack
from lanternfold.session import stage
from lanternfold.settings import Settings, load_settings
from lanternfold.sources.collection import Collection, CorpusEmptyError
from lanternfold.sources.reports import read_manifest


def embedder_of(embedder: Embedder) -> dict:
    """What a collection keeps of the embedder it was built with."""
    return {"embedder": embedder.name, "dim": embedder.dim}


def screen(questions: DataFrame, pack: RulePack = FUNDS) -> DataFrame:
    """Decision columns and the redacted question. The text as typed ends here."""
    decided = guardrails.classify(questions, "question", pack)
    safe = guardrails.scrub_pii(F.coalesce("question", F.lit("")))
    return decided.withColumn("question", F.when(F.col("allowed"), safe))


def answer_from(questions: DataFrame, collection: DataFrame, *, pack: RulePack = FUNDS,
                settings: Settings | None = None, embedder: Embedder | None = None,
                model: generate.AnswerModel | None = None, manifest_stamp: str | None = None,
                k: int | None = None) -> DataFrame:
    """Responses for ``questions(question_id, question)`` against a collection table.

    Blocked questions take no part in embedding, search or generation.
    """
    settings = settings or Settings()
    embedder = embedder or choose_embedder(settings)
    # Only redacted text is written: a blocked question has none.
    decided = stage(screen(questions, pack), "questions")
    allowed = decided.filter("allowed").select("question_id", "question")
    asked = embed(allowed.filter(search.rerank.strip(F.col("question")) != ""), "question", embedder)
    hits = generate.gather(search.retrieve(asked, collection, k, pack, settings))
    answered = generate.respond(allowed.join(hits, "question_id", "left"),
                                model or generate.ExtractiveModel(), pack, manifest_stamp)
    return generate.refuse(decided.filter(~F.col("allowed"))).unionByName(answered)


def answer(questions: DataFrame, *, pack: RulePack = FUNDS, settings: Settings | None = None,
           embedder: Embedder | None = None, model: generate.AnswerModel | None = None) -> DataFrame:
    """Same, against the stored collection and manifest. Never fails on an empty corpus."""
    spark = questions.sparkSession
    settings = settings or load_settings(spark)
    try:
        embedder = embedder or choose_embedder(settings)
        collection = Collection(spark, settings.collection_path).read(embedder_of(embedder))
        if collection.isEmpty():
            raise CorpusEmptyError()
    except CorpusEmptyError:
        decided = screen(questions, pack)
        blank = F.coalesce(search.rerank.strip(F.col("question")) == "", F.lit(False))
        open_questions = decided.filter("allowed")
        unasked = open_questions.filter(blank).select("question_id", "question").withColumn(
            "hits", F.array().cast("array<struct<rank:int,id:string,url:string,heading:string,scheme:string,"
                                   "fetched_at:string,text:string,distance:double,score:double,rank_note:string>>"))
        return (
            generate.refuse(decided.filter(~F.col("allowed")))
            .unionByName(generate.empty_corpus(open_questions.filter(~blank)))
            .unionByName(generate.respond(unasked, model or generate.ExtractiveModel(), pack))
        )
    stamp = (read_manifest(spark, settings.manifest_path) or {}).get("max_fetched_at")
    return answer_from(questions, collection, pack=pack, settings=settings, embedder=embedder,
                       model=model, manifest_stamp=stamp)
