"""Question screening: personal data, intent, redaction. All JVM expressions.

Detection looks at the text as typed; redaction is for whatever goes onward.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfold import rules
from lanternfold.functions.arrays import let
from lanternfold.functions.memo import per_session
from lanternfold.functions.text import any_of, java_regex, match_spans, name_regex
from lanternfold.rules import FUNDS, RulePack

PAN = java_regex(rules.PAN_PATTERN)
OTP = java_regex(rules.OTP_PATTERN, ignore_case=True)
EMAIL = java_regex(rules.EMAIL_PATTERN, any_edge=True)
PHONE = java_regex(rules.PHONE_PATTERN)
TWELVE = java_regex(rules.AADHAAR_PATTERN)
TWELVE_CONTEXT = java_regex(rules.AADHAAR_CONTEXT, ignore_case=True)
LONG_RUN = java_regex(rules.LONG_DIGITS_PATTERN)
CONTEXT_CHARS = 30

# Order matters: each step sees the text the one before left.
REDACTIONS = (
    (OTP, "[redacted-otp]"),
    (PAN, "[redacted-pan]"),
    (EMAIL, "[redacted-email]"),
    (PHONE, "[redacted-phone]"),
    (TWELVE, "[redacted-aadhaar]"),
    (LONG_RUN, "[redacted-account]"),
)


def scrub_pii(text: Column) -> Column:
    for pattern, token in REDACTIONS:
        text = F.regexp_replace(text, pattern, token)
    return text


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"\P{Nd}", "")


# Decimal digits of every script, each with its value.
_ANY_DIGIT = "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd")
_ITS_VALUE = "".join(str(unicodedata.decimal(c)) for c in _ANY_DIGIT)


def ascii_digits(digits: Column) -> Column:
    """Digits of any script as 0-9."""
    return F.translate(digits, _ANY_DIGIT, _ITS_VALUE)


def checksum_valid(digits: Column) -> Column:
    """The table cells of the first eleven digits (read backwards) are summed, and
    the check row gives the twelfth. A plain sum, not a chained Verhoeff fold."""
    table = F.array(*[F.lit(x) for row in rules.CHECK_TABLE for x in row])
    digits = ascii_digits(digits)
    digit = lambda pos: F.substr(digits, pos, F.lit(1)).try_cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: F.get(table, digit(F.lit(11) - i) * 10 + i % 10))
    total = F.aggregate(cells, F.lit(0), lambda acc, x: acc + x)
    check = F.array(*[F.lit(x) for x in rules.CHECK_ROW])
    return F.coalesce(F.get(check, total % 10) == digit(F.lit(12)), F.lit(False))


def all_same(digits: Column) -> Column:
    return digits.rlike(r"\A(.)\1*\z")


def valid_phone(match: Column) -> Column:
    national = F.regexp_replace(digits_of(match), r"\A(?:91|0)", "")
    return let(national, lambda n: (F.length(n) == 10) & n.rlike(r"\A[6-9]") & ~all_same(n))


def first_phone(text: Column) -> Column:
    """``struct<start, stop>`` of the first genuine phone number; start -1 when none."""

    def step(acc: Column, m: Column) -> Column:
        start = acc["pos"] + m["gap"]
        stop = start + F.length(m["text"])
        hit = (acc["start"] < 0) & valid_phone(m["text"])
        return F.struct(
            stop.alias("pos"),
            F.when(hit, start).otherwise(acc["start"]).alias("start"),
            F.when(hit, stop).otherwise(acc["stop"]).alias("stop"),
        )

    zero = F.struct(F.lit(0).alias("pos"), F.lit(-1).alias("start"), F.lit(-1).alias("stop"))
    return F.aggregate(match_spans(text, PHONE), zero, step,
                       lambda acc: F.struct(acc["start"].alias("start"), acc["stop"].alias("stop")))


def _overlaps(start: Column, stop: Column, span: Column) -> Column:
    return (start < span["stop"]) & (span["start"] < stop)


SPAN = "struct<start:int,stop:int,kind:string>"


def twelve_digit_groups(text: Column, phone: Column) -> Column:
    """Every 4-4-4 group clear of the phone number, as ``array<struct<start, stop, kind>>``."""

    def step(acc: Column, m: Column) -> Column:
        start = acc["pos"] + m["gap"]
        stop = start + F.length(m["text"])
        before = F.substr(text, F.greatest(start - CONTEXT_CHARS, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT_CHARS)))
        digits = digits_of(m["text"])
        named = before.rlike(TWELVE_CONTEXT) | all_same(digits) | checksum_valid(digits)
        found = F.struct(start.alias("start"), stop.alias("stop"),
                         F.when(named, F.lit("aadhaar")).otherwise(F.lit("account")).alias("kind"))
        taken = (phone["start"] >= 0) & _overlaps(start, stop, phone)
        return F.struct(
            stop.alias("pos"),
            F.when(taken, acc["found"]).otherwise(F.concat(acc["found"], F.array(found))).alias("found"),
        )

    zero = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{SPAN}>").alias("found"))
    return F.aggregate(match_spans(text, TWELVE), zero, step, lambda acc: acc["found"])


def has_long_run(text: Column, phone: Column, groups: Column) -> Column:
    """A run of ten digits or more that neither the phone nor a 4-4-4 group covers."""

    def step(acc: Column, m: Column) -> Column:
        start = acc["pos"] + m["gap"]
        stop = start + F.length(m["text"])
        taken = ((phone["start"] >= 0) & _overlaps(start, stop, phone)) | F.exists(
            groups, lambda g: _overlaps(start, stop, g))
        hit = ~taken & (F.length(digits_of(m["text"])) >= 10)
        return F.struct(stop.alias("pos"), (acc["hit"] | hit).alias("hit"))

    zero = F.struct(F.lit(0).alias("pos"), F.lit(False).alias("hit"))
    return F.aggregate(match_spans(text, LONG_RUN), zero, step, lambda acc: acc["hit"])


@per_session
def pii_types(text: str) -> Column:
    """The kinds of personal data in a text column, in a fixed order."""
    t = F.coalesce(F.col(text), F.lit(""))

    def kinds(phone: Column, groups: Column) -> Column:
        return F.concat(
            _kind("phone", phone["start"] >= 0),
            F.transform(groups, lambda g: g["kind"]),
            _kind("account", has_long_run(t, phone, groups)),
        )

    spans = let(first_phone(t), lambda phone: let(twelve_digit_groups(t, phone), lambda groups: kinds(phone, groups)))
    numeric = t.rlike(r"\A(?:\P{Nd}*+\p{Nd}){10}")
    return F.concat(
        _kind("pan", t.rlike(PAN)),
        _kind("otp", t.rlike(OTP)),
        _kind("email", F.contains(t, F.lit("@")) & t.rlike(EMAIL)),
        F.when(numeric, spans).otherwise(F.array().cast("array<string>")),
    )


def detect_pii(df: DataFrame, text: str, out: str = "pii_types") -> DataFrame:
    """Adds the kinds of personal data found, in a fixed order; never the values.

    The span work is skipped for texts that hold fewer than ten digits.
    """
    return df.withColumn(out, pii_types(text))


def _kind(name: str, found: Column) -> Column:
    return F.when(found, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))


def is_performance(text: Column, pack: RulePack = FUNDS) -> Column:
    return text.rlike(java_regex(any_of(pack.performance_patterns), ignore_case=True))


def is_advice(text: Column, pack: RulePack = FUNDS) -> Column:
    return text.rlike(java_regex(any_of(pack.advice_patterns), ignore_case=True))


def names_any(text: Column, names) -> Column:
    return text.rlike(java_regex(any_of(name_regex(n) for n in names), ignore_case=True))


def is_out_of_scope(text: Column, pack: RulePack = FUNDS) -> Column:
    return names_any(text, pack.other_issuers) | names_any(text, pack.other_products)


def classify(df: DataFrame, text: str, pack: RulePack = FUNDS) -> DataFrame:
    """Adds intent, allowed, message, link and pii_types. First rule that fires wins."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = detect_pii(df, text, "pii_types").withColumn(
        "intent",
        F.when(F.size("pii_types") > 0, F.lit("pii"))
        .when(is_performance(t, pack), F.lit("performance"))
        .when(is_advice(t, pack), F.lit("advice"))
        .when(is_out_of_scope(t, pack), F.lit("out_of_scope"))
        .otherwise(F.lit("fact")),
    )
    intent = F.col("intent")
    message = F.lit("")
    for name, words in pack.messages.items():
        message = F.when(intent == name, F.lit(words)).otherwise(message)
    return (
        out.withColumn("allowed", intent == "fact")
        .withColumn("message", message)
        .withColumn("link", F.when(intent.isin("performance", "advice"), F.lit(pack.default_url))
                    .when(intent == "out_of_scope", F.lit(pack.scope_url)))
        .withColumn("pii_types", F.when(intent == "pii", F.col("pii_types")))
    )
