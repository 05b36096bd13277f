"""Corpus statistics and answer-quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternfold import rules
from lanternfold.functions.arrays import let, unnest
from lanternfold.functions.text import LINE_BREAK, SPACE, collapse, word_count
from lanternfold.operators.generate import is_approved
from lanternfold.rules import FUNDS, RulePack

SHORT_LINE = 40
REPEATS_ABOVE = 2
REPEAT_MIN_CHARS = 9
TOP_REPEATS = 6


def drops_by_reason(pages: DataFrame) -> DataFrame:
    """How many candidates were dropped for each reason, over chunked pages or over pages with ``reasons``
    alone. Only the short reasons leave the page's row."""
    reasons = F.col("reasons") if "reasons" in pages.columns else F.transform("blocks", lambda b: b["reason"])
    dropped = pages.select(F.filter(reasons, lambda r: r.isNotNull()).alias("reasons"))
    return dropped.select(F.explode_outer("reasons").alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def word_count_summary(chunks: DataFrame) -> DataFrame:
    """min / upper median / max words, and chunks above the ceiling.

    Counted per distinct length first, so the exact median needs a running sum
    over the few hundred lengths that occur, not a sort of all chunks.
    """
    lengths = chunks.groupBy("word_count").agg(F.count("*").alias("n"))
    # One row per distinct length: the running window stays small whatever the corpus size.
    running = Window.orderBy("word_count").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = lengths.withColumn("upto", F.sum("n").over(running)).withColumn("total", F.sum("n").over(everything))
    return placed.agg(
        F.sum("n").alias("chunks"),
        F.min("word_count").alias("min_words"),
        F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("word_count"))).alias("median_words"),
        F.max("word_count").alias("max_words"),
        F.coalesce(F.sum(F.when(F.col("word_count") > rules.MAX_WORDS, F.col("n"))), F.lit(0)).alias("above_ceiling"),
    )


def raw_lines(text: Column) -> Column:
    """``str.splitlines()``: no empty last line after a closing line break."""
    parts = F.split(text, LINE_BREAK)
    return let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def longest_short_run(lines: Column) -> Column:
    """Length of the longest run of consecutive lines under SHORT_LINE characters."""

    def step(acc: Column, line: Column) -> Column:
        now = F.when(F.length(line) < SHORT_LINE, acc["now"] + 1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["best"], now).alias("best"))

    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))
    return F.aggregate(lines, zero, step, lambda acc: acc["best"])


def text_statistics(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Characters, words, lines, upper-median line length and longest short run, per text."""
    lined = texts.select(key, text, raw_lines(F.col(text)).alias("_lines"))
    lengths = F.sort_array(F.transform("_lines", F.length))
    return lined.select(
        key,
        F.length(text).alias("chars"),
        word_count(F.col(text)).alias("words"),
        F.size("_lines").alias("lines"),
        F.coalesce(let(lengths, lambda s: F.get(s, F.floor(F.size(s) / 2).cast("int"))), F.lit(0)).alias("median_line"),
        longest_short_run(F.col("_lines")).alias("longest_short_run"),
    )


def _runs(lines: Column) -> Column:
    """``struct<names, redundant>`` of the repeated lines of one text: a fold over the sorted
    lines, where equal ones are neighbours. A text is one row, so nothing is shuffled."""

    def step(acc: Column, line: Column) -> Column:
        run = F.when(line == acc["last"], acc["run"] + 1).otherwise(1)
        counts = F.length(line) >= REPEAT_MIN_CHARS
        named = counts & (run == REPEATS_ABOVE + 1)
        return F.struct(
            line.alias("last"), run.alias("run"),
            F.when(named, F.array_append(acc["names"], line)).otherwise(acc["names"]).alias("names"),
            (acc["redundant"] + F.when(named, REPEATS_ABOVE).when(counts & (run > REPEATS_ABOVE), 1).otherwise(0)).alias("redundant"),
        )

    zero = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"),
                    F.array().cast("array<string>").alias("names"), F.lit(0).alias("redundant"))
    return F.aggregate(F.array_sort(lines), zero, step, lambda acc: F.struct(
        acc["names"].alias("names"), acc["redundant"].cast("bigint").alias("redundant")))


def _with_runs(texts: DataFrame, key: str, text: str) -> DataFrame:
    lined = texts.select(key, raw_lines(F.col(text)).alias("_lines")).filter(F.size("_lines") > 0)
    return lined.withColumn("_runs", _runs(F.col("_lines")))


def redundancy(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Repeated lines per text: how many distinct, how many redundant, which share."""
    return _with_runs(texts, key, text).select(
        key, F.size("_runs.names").cast("bigint").alias("repeated"), F.col("_runs.redundant").alias("redundant"),
        F.size("_lines").cast("bigint").alias("lines"),
    ).withColumn("share", F.round(F.col("redundant") / F.greatest("lines", F.lit(1)), 4))


def top_repeats(texts: DataFrame, key: str, text: str, k: int = TOP_REPEATS) -> DataFrame:
    """The k most repeated lines of each text."""
    found = _with_runs(texts, key, text).filter(F.size("_runs.names") > 0)
    counted = F.transform("_runs.names", lambda name: F.struct(
        F.size(F.filter("_lines", lambda line: line == name)).cast("bigint").alias("n"), name.alias("line")))
    best = F.slice(F.sort_array(counted, False), 1, k)
    return unnest(found, best, "pos", "r", key).select(key, (F.col("pos") + 1).alias("rank"), "r.line", "r.n")


def heading_tags(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Opening h1 / h2 / h3 / table tags per page and up to five h2-h3 texts."""
    bare = F.regexp_replace(F.col(html), r"(?s)<!--.*?-->", "")
    bare = F.regexp_replace(bare, r"(?is)<(script|style)\b.*?</\1\s*>", "")
    staged = pages.select(key, bare.alias("_text"))
    found = F.regexp_extract_all("_text", F.lit(r"(?is)<h[23]\b[^>]*>(.*?)</h[23]\s*>"), F.lit(1))
    samples = F.filter(
        F.transform(found, lambda x: collapse(F.regexp_replace(x, r"<[^>]*>", " "))), lambda x: x != "")
    counts = [F.regexp_count("_text", F.lit(rf"(?i)<{tag}\b")).alias(tag) for tag in ("h1", "h2", "h3", "table")]
    return staged.select(key, *counts, F.slice(samples, 1, 5).alias("samples"))


def corpus_totals(documents: DataFrame) -> DataFrame:
    return documents.agg(
        F.count("*").alias("pages"),
        F.sum(F.length("text")).alias("chars"),
        F.sum(word_count(F.col("text"))).alias("words"),
    )


def retrieval_report(retrieved: DataFrame, pack: RulePack = FUNDS) -> DataFrame:
    """Per question: whether every retrieved chunk comes from an approved address."""
    return retrieved.groupBy("question_id").agg(
        F.count("*").alias("chunks"),
        F.bool_and(is_approved(F.col("url"), pack)).alias("all_approved"),
    )


def confusion(decisions: DataFrame, expected: str = "expected", actual: str = "intent") -> DataFrame:
    return decisions.groupBy(expected, actual).agg(F.count("*").alias("n"))


def contract_violations(responses: DataFrame, pack: RulePack = FUNDS) -> DataFrame:
    """Adds one flag per broken rule of the response contract."""
    body = F.trim("answer")
    url = F.coalesce("citation_url", F.lit(""))
    date = F.coalesce("last_updated_from_sources", F.lit(""))
    declined = F.coalesce(F.col("debug.reason") == "model_declined", F.lit(False))
    citable = is_approved(url, pack) | url.isin(pack.default_url, pack.scope_url)
    sentences = F.regexp_count(body, F.lit(rf"[.!?](?=[{SPACE}]|\z)"))
    # Words that count as advice.
    advice = r"(?iu)(?<![\p{L}\p{N}_])(I recommend|I advise|you should invest|I suggest)(?![\p{L}\p{N}_])"
    answered = ~F.col("refused")
    return responses.select(
        "*",
        ((url != "") & ~citable).alias("bad_citation"),
        body.rlike(rf"https?://[^{SPACE}]+").alias("url_in_body"),
        (sentences > rules.MAX_SENTENCES).alias("too_long"),
        (answered & body.rlike(advice)).alias("advice_language"),
        (answered & (url == "")).alias("no_citation"),
        (answered & ~declined & (date == "")).alias("no_date"),
        (declined & (url != pack.default_url)).alias("decline_cites_chunk"),
        (F.col("refused") & F.contains(body, F.lit(rules.LAST_UPDATED_LABEL.strip()))).alias("dated_refusal"),
    )


VIOLATIONS = ("bad_citation", "url_in_body", "too_long", "advice_language", "no_citation", "no_date",
              "decline_cites_chunk", "dated_refusal")


def contract_report(responses: DataFrame, pack: RulePack = FUNDS) -> DataFrame:
    """Answers checked and answers in breach, per rule."""
    flagged = contract_violations(responses, pack)
    return flagged.agg(F.count("*").alias("answers"), *[F.count_if(F.col(v)).alias(v) for v in VIOLATIONS])
