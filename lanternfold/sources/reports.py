"""Files written next to the collection: readable chunk dump and ingest manifest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternfold import rules
from lanternfold.functions.text import word_count
from lanternfold.operators.chunks import kept_chunks
from lanternfold.session import stage
from lanternfold.settings import Settings

BAR = "=" * 78


def page_offsets(pages: DataFrame) -> DataFrame:
    """``page_no, url, first``: chunks on all earlier pages, for ``pages(page_no, url, chunks)``.

    Pages are range-partitioned by number; the partitions' totals, one row each, are
    accumulated in one place, and pages within their own partition.
    """
    order = ("page_no", "url")
    ranged = stage(pages.select(*order, "chunks").repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "offsets")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part").agg(F.sum("chunks").alias("n"))
    totals = totals.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(totals, "_part").select(
        *order, (F.col("_base") + F.coalesce(F.sum("chunks").over(inside), F.lit(0))).alias("first"))


def dump_blocks(pages: DataFrame) -> DataFrame:
    """``position, block``: one readable block per chunk, numbered through the corpus.

    ``pages`` are chunked pages: a page's offset is attached before it is split into chunks.
    """
    kept = F.size(F.filter("blocks", lambda b: b["reason"].isNull()))
    offsets = page_offsets(pages.select("page_no", "url", kept.alias("chunks")))
    placed = kept_chunks(pages.join(offsets, ["page_no", "url"])).withColumn(
        "position", F.col("first") + F.col("chunk_index") + 1)
    fields = ("url", "title", "scheme", "fetched_at", "heading", "chunk_index")
    block = F.concat_ws(
        "\n",
        F.lit(""),
        F.concat(F.lit("=== CHUNK "), F.col("position").cast("string"), F.lit(" ===")),
        F.concat(F.lit("id: "), F.col("id")),
        *[F.concat(F.lit(f"{name}: "), F.col(name).cast("string")) for name in fields],
        F.concat(F.lit("words: "), word_count(F.col("text")).cast("string")),
        F.lit("---"),
        F.col("text"),
    )
    return placed.select("position", block.alias("block"))


# The texts around the listed pages and drops of a dump.
OPENING = "{bar}\n{title}\n{bar}\ngenerated_at : {at}\nchunks       : {n}\nstrategy     : heading-aware split, target {target} words, " \
          "max {most}, overlap {overlap}\n\ncorpus:"
PAGE_LINE = "  - "
DROPPED = "\ndropped       : {n}"
CLOSING = "\n{bar}\nEND OF DUMP - {n} chunks\n{bar}"


def dump_rows(blocks: DataFrame, pages: DataFrame, reasons: list[tuple[str, int]], chunk_count: int, generated_at: str,
              title: str = "") -> DataFrame:
    """``section, position, block``: opening, every page of the corpus, drops by reason, blocks, closing."""
    spark = blocks.sparkSession
    opening = OPENING.format(bar=BAR, title=f"CHUNK DUMP - {title}" if title else "CHUNK DUMP", at=generated_at, n=chunk_count,
                             target=rules.TARGET_WORDS, most=rules.MAX_WORDS, overlap=rules.OVERLAP_WORDS)
    drops = [DROPPED.format(n=sum(n for _, n in reasons)), *[f"  {n:4d}  {r}" for r, n in sorted(reasons)]] if reasons else []
    ends = [(0, 0, opening), (2, 0, "\n".join([*drops, BAR])), (4, 0, CLOSING.format(bar=BAR, n=chunk_count))]
    listed = pages.select(F.lit(1).alias("section"), F.col("page_no").alias("position"),
                          F.concat(F.lit(PAGE_LINE), F.col("url")).alias("block"))
    return spark.createDataFrame(ends, "section int, position bigint, block string").unionByName(listed).unionByName(
        blocks.select(F.lit(3).alias("section"), "position", "block"))


def write_dump(path: str, rows: DataFrame) -> None:
    """Part files in reading order."""
    ordered = rows.repartitionByRange("section", "position").sortWithinPartitions("section", "position")
    ordered.select("block").write.mode("overwrite").text(path)


def write_thin_pages(page_counts: DataFrame, path: str) -> int:
    """All pages without a chunk, as a table; how many there are."""
    page_counts.filter(F.col("chunks") == 0).select("page_no", "url").write.mode("overwrite").parquet(path)
    return page_counts.sparkSession.read.parquet(path).count()


MANIFEST = T.StructType([
    T.StructField("ingested_at", T.StringType()),
    T.StructField("max_fetched_at", T.StringType()),
    T.StructField("url_count", T.LongType()),
    T.StructField("chunk_count", T.LongType()),
    T.StructField("dropped_count", T.LongType()),
    T.StructField("collection", T.StringType()),
    T.StructField("embedding_model", T.StringType()),
    T.StructField("embedding_dim", T.LongType()),
    T.StructField("collection_path", T.StringType()),
    T.StructField("chunks_txt", T.StringType()),
    T.StructField("chunk_strategy", T.StructType([
        T.StructField("target_words", T.LongType()), T.StructField("max_words", T.LongType()),
        T.StructField("min_words", T.LongType()), T.StructField("overlap_words", T.LongType()),
    ])),
])


def corpus_summary(page_counts: DataFrame) -> DataFrame:
    """One row over ``url, fetched_at, chunks, dropped`` per page."""
    return page_counts.agg(
        F.max("fetched_at").alias("max_fetched_at"),
        F.count("*").alias("url_count"),
        F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunk_count"),
        F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped_count"),
    )


SUMMARY = "max_fetched_at string, url_count bigint, chunk_count bigint, dropped_count bigint"


def summary_columns() -> dict:
    """The aggregates of a summary over chunked pages, to be taken while these are written."""
    kept = F.size(F.filter("blocks", lambda b: b["reason"].isNull()))
    return {"max_fetched_at": F.max("fetched_at"), "url_count": F.count("*"), "chunk_count": F.coalesce(F.sum(kept), F.lit(0)),
            "dropped_count": F.coalesce(F.sum(F.size("blocks") - kept), F.lit(0))}


def summary_row(spark: SparkSession, observed: dict) -> DataFrame:
    return spark.createDataFrame([tuple(observed[n.split()[0]] for n in SUMMARY.split(", "))], SUMMARY)


def manifest(summary: DataFrame, ingested_at: str, settings: Settings, embedder_name: str, dim: int) -> DataFrame:
    """One row from the one-row ``summary`` of the pages."""
    strategy = F.struct(*[F.lit(v).cast("bigint").alias(n) for n, v in (
        ("target_words", rules.TARGET_WORDS), ("max_words", rules.MAX_WORDS),
        ("min_words", rules.MIN_WORDS), ("overlap_words", rules.OVERLAP_WORDS))])
    return summary.select(
        F.lit(ingested_at).alias("ingested_at"), "max_fetched_at", "url_count", "chunk_count", "dropped_count",
        F.lit(settings.collection).alias("collection"), F.lit(embedder_name).alias("embedding_model"),
        F.lit(dim).cast("bigint").alias("embedding_dim"), F.lit(settings.collection_path).alias("collection_path"),
        F.lit(settings.dump_path).alias("chunks_txt"), strategy.alias("chunk_strategy"),
    )


def entries(facts: DataFrame, page_counts: DataFrame) -> DataFrame:
    """``name, place, value``: a summary or manifest as rows, one per fact and one per page
    address (name ``urls``, place the page number). One layout, however many pages there are."""
    flat = []
    for field in facts.schema.fields:
        inner = field.dataType.fields if isinstance(field.dataType, T.StructType) else None
        flat += [(f"{field.name}.{f.name}", f"`{field.name}`.`{f.name}`") for f in inner] if inner else [(field.name, f"`{field.name}`")]
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("string").alias("value")) for n, c in flat])
    rows = facts.select(F.explode(pairs).alias("e")).select("e.name", F.lit(None).cast("bigint").alias("place"), "e.value")
    urls = page_counts.select(F.lit("urls").alias("name"), F.col("page_no").alias("place"), F.col("url").alias("value"))
    return rows.unionByName(urls)


def write_manifest(page_counts: DataFrame, facts: DataFrame, path: str) -> dict:
    """The facts as one JSON row in ``path/facts``, all addresses as a table in ``path/urls``."""
    row = facts.first().asDict(recursive=True)
    page_counts.select("page_no", "url").write.mode("overwrite").parquet(f"{path}/urls")
    spark = page_counts.sparkSession
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/facts")
    return row


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest's facts, or None when they are missing or unreadable."""
    try:
        row = spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(f"{path}/facts").first()
    except Exception:
        return None
    return json.loads(json.dumps(row.asDict(recursive=True))) if row else None


def manifest_urls(spark: SparkSession, path: str) -> DataFrame:
    """``page_no, url`` of every page of the manifest."""
    return spark.read.schema("page_no bigint, url string").parquet(f"{path}/urls")
