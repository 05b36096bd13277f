"""Screening on sentences of our own: separators, digits of other scripts, overlaps, precedence."""

import itertools
import random
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from lanternfold.functions import text as tx
from lanternfold.functions.automaton import Automaton
from lanternfold.operators import guardrails as g
from lanternfold.operators import rule_table as rt
from lanternfold.rules import FUNDS

DEVANAGARI, ARABIC, WIDE = "०१२३४५६७८९", "٠١٢٣٤٥٦٧٨٩", "０１２３４５６７８９"


def other_script(text, digits):
    return text.translate({ord("0") + i: d for i, d in enumerate(digits)})


def kinds(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.pii_types for r in g.detect_pii(df, "t").orderBy("i").collect()]


def test_one_kind_each(spark):
    cases = {
        "QWERT0987Y is on the letter": ["pan"], "qwert0987y in small letters": [], "xQWERT0987Y glued": [],
        "write to kim_q+tax@mail.co.example": ["email"], "kim at mail.co.example": [],
        "it asks for the One-Time Password": ["otp"], "the auth code came": ["otp"], "a pin cushion": [],
        "file 20240115000042 is open": ["account"], "two years, 3 months": [], "": [], None: [],
    }
    assert kinds(spark, list(cases)) == list(cases.values())


def test_phone_separators(spark):
    head, tail = "7012", "345678"
    texts = [f"{pre}{head}{sep}{tail}" for pre, sep in itertools.product(("", "0", "+91 ", "91-", "+91"), ("", " ", "-"))]
    assert kinds(spark, texts) == [["phone"]] * len(texts)
    assert kinds(spark, ["5012345678", "7012 34567", "8888888888"]) == [["account"], [], ["account"]]


@pytest.mark.parametrize("digits", ["0123456789", DEVANAGARI, ARABIC, WIDE])
def test_twelve_digits_in_every_script(spark, digits):
    """A question in another script must not stop the batch; its digits count as what they are."""
    texts = [other_script(t, digits) for t in (
        "group 5555 5555 5555", "uidai 2345-6789-0123", "group 2000 0000 0001", "group 2345 6789 0124", "9 4 1")]
    valid = {t: v for t, v in zip(("200000000001", "234567890124"), _valid(["200000000001", "234567890124"]), strict=True)}
    assert kinds(spark, texts) == [["aadhaar"], ["aadhaar"], ["aadhaar" if valid["200000000001"] else "account"],
                                   ["aadhaar" if valid["234567890124"] else "account"], []]


def test_mixed_scripts_do_not_fail(spark):
    texts = [f"नंबर {other_script('1234', DEVANAGARI)} {other_script('5678', ARABIC)} 9012", f"{WIDE}{DEVANAGARI}", "𝟏𝟐𝟑𝟒 𝟓𝟔𝟕𝟖 𝟗𝟎𝟏𝟐"]
    assert all(k == ["account"] or k == ["aadhaar"] for k in kinds(spark, texts))


def test_a_number_is_counted_once(spark):
    found = kinds(spark, ["ring 7012345678, then 4000 0000 0002 and 4000 0000 0003", "4000 0000 0002 400000000000"])
    assert found[0][0] == "phone" and len(found[0]) == 3 and len(found[1]) == 2


def test_ladder(spark):
    """Personal data before performance before advice before scope before fact."""
    rungs = [("QWERT0987Y", "pii"), ("last year's returns", "performance"), ("is it wise? should i buy", "advice"),
             ("from the kotak desk", "out_of_scope"), ("where is the form", "fact")]
    texts = [(f"{a}; {b}", min(i, j)) for i, (a, _) in enumerate(rungs) for j, (b, _) in enumerate(rungs)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, t string")
    for row in g.classify(df, "t").collect():
        text, rung = texts[row.i]
        intent = rungs[rung][1]
        assert row.intent == intent, text
        assert row.allowed == (intent == "fact") == (row.message == "")
        assert "http" not in row.message and row.message.count(".") <= 3
        assert (row.link in (FUNDS.default_url, FUNDS.scope_url)) == (intent not in ("fact", "pii"))
        assert (row.pii_types == ["pan"]) == (intent == "pii")


def test_names_with_any_separator(spark):
    texts = [f"on the {a}{sep}{b} one" for a, b in (("mid", "cap"), ("g", "sec"), ("aditya", "birla")) for sep in (" ", "-", "  ")]
    texts += ["the MID-CAP one", "midcapital", "xkotak", "ékotak"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.intent for r in g.classify(df, "t").orderBy("i").collect()]
    assert got == ["out_of_scope"] * (len(texts) - 3) + ["fact"] * 3


def test_redaction_leaves_the_rest(values):
    cases = {
        "QWERT0987Y, and on": "[redacted-pan], and on",
        "ring 70123 45678!": "ring [redacted-phone]!",
        "to kim_q+tax@mail.co.example soon": "to [redacted-email] soon",
        "the passcode for 20240115000042": "the [redacted-otp] for [redacted-account]",
        f"{other_script('2345 6789 0124', DEVANAGARI)} है": "[redacted-aadhaar] है",
        "nothing of the kind, 42": "nothing of the kind, 42",
        # The phone rule takes the last ten of sixteen digits first; the head stays.
        "run 1234567012345678": "run 123456[redacted-phone]",
    }
    assert values(g.scrub_pii, list(cases)) == list(cases.values())


def _valid(samples):
    """The check from its group law: rotations 0-4, reflections 5-9."""
    def cell(i, j):
        return ((i + j if i < 5 else i - j) % 5) + (5 if (i < 5) != (j < 5) else 0)

    row = [8, 9, 1, 6, 0, 4, 3, 5, 2, 7]
    return [row[sum(cell(int(c), k % 10) for k, c in enumerate(reversed(d[:11]))) % 10] == int(d[11]) for d in samples]


def test_checksum(values):
    samples = [f"{n * 7919 % 10**12:012d}" for n in range(1, 400)]
    assert values(g.checksum_valid, samples) == _valid(samples)
    for digits in (DEVANAGARI, ARABIC, WIDE):
        assert values(g.checksum_valid, [other_script(s, digits) for s in samples[:50]]) == _valid(samples[:50])
    assert values(lambda c: F.coalesce(g.checksum_valid(c), F.lit(False)), ["", "12", "abcdefghijkl"]) == [False] * 3


def _odd_texts():
    rng = random.Random(4)
    pieces = ["HDFC", "hdfc", "Flexi", "flexi-cap", "Cap", "cap", "Fund", " ", "-", " - ", "\n", "ſbi", "SBI", "İ", "é", "É", "x", "caps", ".", "_", "K", "K"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(600)] + ["", "flexi - cap", "flexi cap fund"]


def test_rule_table_gives_the_rows_of_the_alternations(spark, values):
    names = ["flexi cap", "SBI", "é", "hdfc flexi-cap fund", "cap", "K", "x.", "fund"]
    texts = _odd_texts()
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "key int, text string")
    table = spark.createDataFrame([(n, n) for n in names] + [("none", None), (None, "cap")], "rule string, phrase string")
    for shard_bytes in (1 << 20, 10):
        found = {(r.key, r.rule) for r in rt.matches(rows, "key", "text", table, "name", shard_bytes).collect()}
        for name in names:
            assert [(i, name) in found for i in range(len(texts))] == values(lambda c: g.names_any(c, [name]), texts), name
        assert not any(k == -1 for k, _ in found)
    phrases = ["flexi cap", "cap", "hdfc", "fund x", "--"]
    table = spark.createDataFrame([(n, n) for n in phrases], "rule string, phrase string")
    found = {(r.key, r.rule) for r in rt.matches(rows, "key", "text", table, "phrase").collect()}
    for phrase in phrases:
        assert [(i, phrase) in found for i in range(len(texts))] == values(lambda c: tx.has_phrase(tx.phrase_text(c), (phrase,)), texts), phrase


def test_fifty_thousand_names_in_one_pass(spark):
    table = spark.range(50_000).select(F.col("id").cast("string").alias("rule"), F.concat(F.lit("Scheme "), "id", F.lit(" plan")).alias("phrase"))
    texts = spark.range(2000).select(F.col("id").alias("key"), F.concat(F.lit("about scheme-"), F.col("id") * 25, F.lit("  PLAN and scheme 7 plans")).alias("text"))
    began = time.monotonic()
    found = rt.matches(texts, "key", "text", table)
    assert {(r.key, r.rule) for r in found.collect()} == {(i, str(i * 25)) for i in range(2000)}
    assert time.monotonic() - began < 60
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_an_automaton_keeps_no_copy_of_its_rules():
    tracemalloc.start()
    made = Automaton((pair for i in range(50_000) for pair in ((f"r{i % 20}", f"name of {i}"), (f"r{i % 7}", f"name of {i}"))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4_000_000
    assert made.rules_in("a Name-of  41 and the name of 7x") == ["r1", "r6"]
