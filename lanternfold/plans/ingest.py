"""Corpus build: pages -> documents -> sections -> chunks -> vectors -> collection.

Parsed and chunked pages are written once to a staging table. Collection, dump and counts
read that table, so nothing is parsed twice and a lost executor costs one stage, not the run.
Totals for the manifest and the guards are taken while it is written.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfold.operators import chunks as ch
from lanternfold.operators.diagnostics import drops_by_reason
from lanternfold.operators.embed import Embedder, choose_embedder, embed
from lanternfold.operators.rerank import with_chunk_features
from lanternfold.operators.sections import to_sections
from lanternfold.operators.vectors import VectorStore
from lanternfold.plans.answer import embedder_of
from lanternfold.rules import FUNDS, RulePack
from lanternfold.session import OutOfTime, release, stage, time_limit
from lanternfold.settings import Settings, load_settings
from lanternfold.sources import reports
from lanternfold.sources.collection import Collection
from lanternfold.sources.pages import load_documents, require_complete



class IngestTimeout(TimeoutError):
    """The build took longer than an interactive caller can wait for."""


def utc_now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


def page_chunks(pages: DataFrame, fetched_at: str, pack: RulePack = FUNDS) -> DataFrame:
    """Raw pages -> one row per page with its candidate chunks."""
    return ch.chunk_pages(to_sections(load_documents(pages, fetched_at), pack), pack)


def staged_counts(staged: DataFrame) -> DataFrame:
    kept = F.size(F.filter("blocks", lambda b: b["reason"].isNull()))
    return staged.select("page_no", "url", "fetched_at", kept.alias("chunks"),
                         (F.size("blocks") - kept).alias("dropped"))


def newest_pages(staged: DataFrame) -> tuple[DataFrame, bool]:
    """One row per address, and whether any was left out: of several the one with the highest number, then the
    highest digest. Repeats are found on narrow columns; page texts move only when there are any. A page
    without address stays, whatever the others do; of several such the same one as of any other address."""
    order = F.struct("page_no", F.xxhash64("title", F.to_json(F.struct("blocks"))).alias("digest"))
    narrow = staged.select("url", order.alias("_order"))
    newest = narrow.groupBy("url").agg(F.max("_order").alias("_order"), F.count("*").alias("copies"))
    if newest.filter(F.col("copies") > 1).isEmpty():
        return staged, False
    wanted = newest.select(F.col("url").alias("_url"), F.col("_order").alias("_newest"))
    held = staged.withColumn("_order", order).join(
        wanted, F.col("url").eqNullSafe(F.col("_url")) & F.col("_order").eqNullSafe(F.col("_newest")), "left_semi")
    return held.drop("_order").dropDuplicates(["url"]), True


def ingest(spark: SparkSession, pages: DataFrame, *, pack: RulePack = FUNDS, settings: Settings | None = None,
           embedder: Embedder | None = None, reingest: bool = False, force: bool = False,
           fetched_at: str | None = None, on_progress: Callable[[str], None] | None = None) -> dict:
    """Build the collection from ``pages(page_no, url, html[, error])``.

    Skips when it is already populated, unless ``reingest`` or ``force``. Vectors are kept by the digest of their
    text, so a rebuild encodes changed chunks only; ``encoded_count`` says how many. After
    ``settings.ingest_deadline_seconds``, if that is set, running jobs are cancelled and the version
    before stays in force: the new one is put in its place by its last step.
    """
    settings = settings or load_settings(spark)
    limit = settings.ingest_deadline_seconds
    at = ["starting"]
    try:
        with time_limit(spark, limit):
            return _build(spark, pages, pack, settings, embedder or choose_embedder(settings), reingest or force, fetched_at,
                          on_progress or (lambda message: None), at)
    except OutOfTime as exc:
        raise IngestTimeout(f"Ingest exceeded {limit}s while {at[0]}.") from exc


def _build(spark, pages, pack, settings, embedder, anew, fetched_at, say, at) -> dict:
    collection = Collection(spark, settings.collection_path)
    if collection.is_populated() and not anew:
        say("Collection already populated, skipping ingest.")
        return {"skipped": True, "collection_path": settings.collection_path}
    if anew:
        say("Building a new version; no chunk of an older page survives in it...")

    at[0] = "loading pages"
    say("Loading and chunking pages...")
    written = stage(page_chunks(pages, fetched_at or utc_now(), pack).drop("text"), "ingest",
                    failed=F.count("error"), **reports.summary_columns())
    observed = written.observed
    if observed["failed"]:
        require_complete(written, f"{settings.data_dir.rstrip('/')}/load_failures")
    at[0] = "chunking pages"
    staged, fewer = newest_pages(written.drop("error"))
    counts = staged_counts(staged)
    if fewer:  # counts were taken before repeats went
        observed = reports.corpus_summary(counts).first().asDict()

    facts = reports.manifest(reports.summary_row(spark, observed), utc_now(), settings, embedder.name, embedder.dim)
    thin = reports.write_thin_pages(counts, f"{settings.data_dir.rstrip('/')}/thin_pages")
    if thin:
        say(f"  WARNING: {thin} pages gave no chunk and cannot answer; they are listed in {settings.data_dir}/thin_pages.")
    n = observed["chunk_count"]
    if n == 0:
        raise RuntimeError("No chunks produced; refusing to store an empty corpus.")

    at[0] = "embedding chunks"
    say(f"Embedding {n} chunks with {embedder.name}...")
    kept = with_chunk_features(ch.kept_chunks(staged), pack)
    vectors = VectorStore(spark, f"{settings.data_dir.rstrip('/')}/vectors", embedder)
    ready, encoded = vectors.embed(kept, "text")
    say(f"  {encoded} texts are new, the vectors of all others are kept")
    rows = stage(ready, "vectors", rows=F.count("*"), vectors=F.count("embedding"))
    if rows.observed["rows"] != n or rows.observed["vectors"] != n:
        raise RuntimeError(f"{rows.observed['vectors']} vectors for {n} chunks")
    at[0] = "storing chunks"
    stored = (collection.replace if anew else collection.upsert)(rows, embedder_of(embedder))
    if stored < n:
        raise RuntimeError(f"stored {stored} vectors for {n} chunks")
    say(f"Stored in {settings.collection}: {stored} chunks")

    at[0] = "writing reports"
    reasons = [(r.reason, r.n) for r in drops_by_reason(staged).collect()]
    facts_row = facts.first()
    reports.write_dump(settings.dump_path, reports.dump_rows(
        reports.dump_blocks(staged), counts, reasons, n, facts_row.ingested_at))
    written_facts = reports.write_manifest(counts, facts, settings.manifest_path)
    release(rows, written)
    say(f"Last source date: {written_facts['max_fetched_at']}")
    return {"skipped": False, "encoded_count": encoded, **written_facts}
