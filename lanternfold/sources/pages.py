"""Pages in: allow-list, all-or-nothing loading, raw dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfold.functions.text import slug, strip, word_count
from lanternfold.operators.generate import is_approved
from lanternfold.operators.sections import fetch_columns
from lanternfold.rules import FUNDS, RulePack
from lanternfold.sources.collection import Collection

RULE = "-" * 60  # separates a raw dump's header from its body


class CorpusFetchError(RuntimeError):
    """One or more approved pages could not be loaded."""


def approved(pages: DataFrame, pack: RulePack = FUNDS) -> DataFrame:
    """Pages of the pack's own list."""
    return pages.filter(is_approved(F.col("url"), pack))


def approved_by(pages: DataFrame, allow_list: DataFrame) -> DataFrame:
    """Pages of an allow-list table of any size; Spark picks the join by its size."""
    return pages.join(allow_list.select("url").distinct(), "url", "left_semi")


def rejected_by(pages: DataFrame, allow_list: DataFrame) -> DataFrame:
    return pages.join(allow_list.select("url").distinct(), "url", "left_anti")


def require_approved(pages: DataFrame, allow_list: DataFrame) -> DataFrame:
    """Strict form: fail on the first page outside the list."""
    bad = rejected_by(pages, allow_list).select("url").take(1)
    if bad:
        raise ValueError(f"URL is not part of the approved corpus: {bad[0].url}")
    return pages


def load_documents(pages: DataFrame, fetched_at: str) -> DataFrame:
    """Parsed documents with an ``error`` column (NULL when the page is readable)."""
    documents = fetch_columns(pages, fetched_at)
    failed = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
    return documents.withColumn("error", F.coalesce(
        failed,
        F.when(F.col("text") == "", F.concat(F.lit("No readable text extracted from "), F.col("url"))),
    ))


def require_complete(documents: DataFrame, failures_path: str) -> DataFrame:
    """Fail loudly instead of returning part of a corpus. Every failed page is written to
    ``failures_path`` as JSON lines (url, error), and the error names that table."""
    failed = documents.filter(F.col("error").isNotNull()).select("url", "error")
    if not failed.isEmpty():
        failed.write.mode("overwrite").json(failures_path)
        n = documents.sparkSession.read.schema("url string, error string").json(failures_path).count()
        raise CorpusFetchError(f"Corpus load failed for {n} pages, all listed in {failures_path}")
    return documents.drop("error")


def raw_dump(documents: DataFrame) -> DataFrame:
    """``slug, value``: one readable text per page, header first."""
    text = F.col("text")
    header = F.concat_ws(
        "\n",
        F.concat(F.lit("URL: "), "url"),
        F.concat(F.lit("TITLE: "), "title"),
        F.concat(F.lit("FETCHED_AT: "), "fetched_at"),
        F.concat(F.lit("CHARS: "), F.length(text).cast("string")),
        F.concat(F.lit("WORDS: "), word_count(text).cast("string")),
        F.lit(RULE),
    )
    return documents.select(
        slug(F.col("url")).alias("slug"), F.concat(header, F.lit("\n\n"), text, F.lit("\n")).alias("value"))


def write_raw_dump(documents: DataFrame, path: str) -> int:
    """A collection of texts by the page's slug, in buckets that follow its size; the number of pages."""
    return Collection(documents.sparkSession, path).replace(raw_dump(documents).withColumnRenamed("slug", "id"))


def raw_body(value):
    """Body of a raw dump: what follows the first rule line."""
    return strip(F.regexp_replace(value, rf"(?s)\A.*?{RULE}", ""))


def read_raw_dump(spark: SparkSession, path: str, slugs: list[str] | None = None) -> DataFrame:
    """All pages, or the named ones (their buckets only)."""
    dumped = Collection(spark, path).read(ids=slugs)
    return dumped.select(F.col("id").alias("slug"), raw_body(F.col("value")).alias("body"))
