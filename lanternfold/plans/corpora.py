"""Inputs of the registered queries, derived from the given tables by Spark.

The tables hold no label/value cards, no links and none of the default pack's
words, so cards, questions and completions are written from their rows. Every
derived table has one row per source row and grows with it.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfold.functions.text import clean_lines
from lanternfold.rules import FUNDS
from lanternfold.sources.pages import load_documents

FETCHED_AT = "2026-10-01T16:18:43+00:00"
LATER = "2026-11-05T09:00:00+00:00"

# The default rules plus words that occur in the given pages.
SAMPLE = replace(
    FUNDS,
    name="sample",
    approved_prefixes=("https://",),
    topic_phrases={
        **FUNDS.topic_phrases,
        "of the": ("of the", "the of"),
        "and": ("and", "und"),
        "que": ("que", "de la"),
        "tion": ("tion", "ention"),
    },
    topic_labels={**FUNDS.topic_labels, "of the": ("on the", "is the"), "que": ("le", "la")},
    scheme_phrases={
        **FUNDS.scheme_phrases,
        "en": ("the", "of"), "fr": ("est", "dans"), "de": ("und", "der"), "es": ("para", "los"),
    },
)

PROBES = (
    "What is the expense ratio of HDFC Flexi Cap Fund?",
    "Should I buy it right now?",
    "What is the exit load?",
    "which fund gave better returns",
    "my number is +91 98765 43210",
    "",
    "expense ratio of HDFC Mid-Cap Fund",
    "Where is the download and the lock-in period?",
    "tell me about SBI Liquid Fund",
    "what is the NAV of the fund",
    "mail me at someone@example.com",
    "Who manages it, and the AUM?",
    "reference 4994226020900891",
    "मेरा आधार १२३४ ५६७८ ९०१२",
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dealt(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table, dealt to as many tasks as shuffles use. The tables come as one row group,
    which no split size divides, and reading a page costs far more than moving it."""
    return table(spark, sf, name).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return dealt(spark, sf, "documents")


def language(url: Column) -> Column:
    code = F.regexp_extract(url, r"/(en|fr|de|es)/", 1)
    return F.when(code == "", F.lit("unknown")).otherwise(code)


def web_pages(spark: SparkSession, sf: str) -> DataFrame:
    return dealt(spark, sf, "pages").select(
        F.col("page_id").alias("page_no"), "url", "html", language(F.col("url")).alias("scheme"))


def web_documents(spark: SparkSession, sf: str, fetched_at: str = FETCHED_AT) -> DataFrame:
    return load_documents(web_pages(spark, sf), fetched_at)


def text_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The ``documents`` table as pages without markup."""
    docs = documents(spark, sf)
    return docs.select(
        F.col("doc_id").alias("page_no"),
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("url"),
        F.col("source").alias("title"), F.col("text"), clean_lines(F.col("text")).alias("marked"),
        F.lit(FETCHED_AT).alias("fetched_at"), F.col("lang").alias("scheme"))


def _html(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def card_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One fact card per part: labels, qualifiers, values, traps and noise."""
    s = lambda c: F.col(c).cast("string")
    month = (F.col("p_partkey") % 9 + 1).cast("string")
    html = _html(
        "<html><head><title> ", s("p_name"), " card </title></head><body><nav><a href=\"/\">Home</a></nav>",
        "<iframe src=\"/frame\"/><div class=\"Newsletter box\"><p>", s("p_brand"), "</p></div><script src=\"/x.js\"/><h2>", s("p_name"), "</h2>",
        "<div>NAV</div><div>₹ ", s("p_retailprice"), "</div><div>Returns</div><div>since inception</div><div>",
        s("p_size"), "%</div><div>AUM</div><div>(31/08/2026)</div><div>Inception Date</div><div>01/0", month,
        "/2013</div><div>Riskometer:</div><div>", s("p_type"), "</div><div>TER</div><div>The ", s("p_type"),
        " plan states this share once a year.</div><div>0.77</div><h3>Exit Load</h3><p>NIL</p>",
        "<h3>Graph</h3><p>Table</p><h3>Benchmark</h3><h4>", s("p_brand"), "</h4><p>", s("p_name"),
        " follows an index with a small number of parts, priced at ", s("p_retailprice"),
        " and reviewed each quarter by the board.</p><h4>", s("p_type"), "</h4><p>short ", s("p_name"),
        "</p><!-- end --><footer>", s("p_name"), "</footer></body></html>")
    return dealt(spark, sf, "part").select(
        F.col("p_partkey").alias("page_no"),
        _html("https://cards.example.com/", s("p_partkey"), "/").alias("url"), html.alias("html"))


def card_documents(spark: SparkSession, sf: str) -> DataFrame:
    return load_documents(card_pages(spark, sf), FETCHED_AT)


def supplier_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One page per supplier; one in debt shows nothing but a consent wall."""
    wall = _html("<body id=\"consent-wall\"><p>", F.col("s_name"), "</p></body>")
    page = _html("<body><p>", F.col("s_name"), "</p><p class=\"cookie\">x</p></body>")
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("page_no"),
        _html("https://s.example.com/", F.col("s_suppkey").cast("string")).alias("url"),
        F.when(F.col("s_acctbal") < 0, wall).otherwise(page).alias("html"))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """User turns, each closing on one probe phrase; system turns are blank questions."""
    turns = table(spark, sf, "conversations").filter(F.col("role").isin("user", "system"))
    probes = F.array(*[F.lit(p) for p in PROBES])
    key = F.col("conv_id") + F.col("turn")
    probe = F.get(probes, (key % len(PROBES)).cast("int"))
    return turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"),
        F.when(F.col("role") == "system", F.lit("  ")).otherwise(F.concat("text", F.lit(" "), probe)).alias("question"))


def completions(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns as badly behaved completions: links, labels, figures, declines."""
    c, t = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    turns = table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    kind = (F.col("conv_id") + F.col("turn")) % 4
    opening = (
        F.when(kind == 0, F.lit("This is not in the pages. "))
        .when(kind == 1, _html("Per https://example.com/", c, ", it is 1,", c, ".5% of ", t, ". "))
        .when(kind == 2, _html("See [the notes](https://e.org/", c, ") ( ) for more . "))
        .otherwise(F.lit("It comes from. "))
    )
    return turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"),
        _html(opening, F.col("text"), " Visit www.example.org/x . Source: https://example.com/", t).alias("completion"))


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """One personal-data message per customer, in eleven shapes."""
    key = F.col("c_custkey")
    four = F.lpad((key % 10000).cast("string"), 4, "0")
    nine = F.lpad(key.cast("string"), 9, "0")
    letters = F.translate(F.substr(F.md5("c_name"), F.lit(1), F.lit(5)), "0123456789abcdef", "ABCDEFGHIJKLMNOP")
    shapes = [
        _html("my PAN is ", letters, four, "X"),
        _html("call me on 9", nine, " please"),
        _html("my number is +91 98765 4", four),
        _html("mail me at ", F.replace(F.lower("c_name"), F.lit("#"), F.lit(".")), "@example.com"),
        _html("my aadhaar is 1234 5678 ", four),
        _html("see 4321-8765-", four, " or 9876543210"),
        _html("folio number 12345", nine),
        _html("मेरा आधार १२३४ ५६७८ ", F.translate(four, "0123456789", "०१२३४५६७८९")),
        _html("رقمي ٢٣٤٥-٥٥٥٥-", F.translate(four, "0123456789", "٠١٢٣٤٥٦٧٨٩")),
        _html("no １１１１ ２２２２ ", F.translate(four, "0123456789", "０１２３４５６７８９"), " ok"),
        _html("what is the otp of ", F.col("c_mktsegment"), " 9199", nine),
    ]
    pick = F.lit(None).cast("string")
    for i, shape in enumerate(shapes):
        pick = F.when(key % len(shapes) == i, shape).otherwise(pick)
    return table(spark, sf, "customer").select(F.concat(F.lit("c"), key.cast("string")).alias("key"), pick.alias("text"))


def screened_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Messages and whole documents together."""
    docs = documents(spark, sf).select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), "text")
    return messages(spark, sf).unionByName(docs)
