import pytest
from pyspark.sql import functions as F

from lanternfold.operators.facts import pair_tagged, tag_lines
from lanternfold.operators.sections import assemble_sections

CASES = [
    (["Min SIP", "₹ 100", "next"], ["Min SIP: ₹ 100", "next"]),
    (["Returns", "since launch of this very long wording", "16.17%"],
     ["Returns", "since launch of this very long wording", "16.17%"]),
    (["Returns", "since launch", "16.17%"], ["Returns: since launch", "16.17%"]),
    (["Returns", "a lower line: here;", "16.17%"], ["Returns a lower line: here;: 16.17%"]),
    (["Returns", "since inception", "16.17%"], ["Returns since inception: 16.17%"]),
    (["TER", "A definition that is a whole sentence.", "0.77"], ["TER", "A definition that is a whole sentence.", "0.77"]),
    (["AUM", "(31/08/2026)", "₹1 Cr."], ["AUM", "(31/08/2026)", "₹1 Cr."]),
    (["Inception Date", "01/01/2013"], ["Inception Date: 01/01/2013"]),
    (["NAV", "Disclaimer"], ["NAV", "Disclaimer"]),
    (["NAV", "AUM", "12"], ["NAV", "AUM: 12"]),
    (["Riskometer:", "Very High"], ["Riskometer:: Very High"]),
    (["Exit Load"], ["Exit Load"]),
    (["## NAV", "12"], ["## NAV", "12"]),
    (["NAV", "## H", "x"], ["NAV", "## H", "x"]),
    (["Returns", "since inception"], ["Returns since inception"]),
]


@pytest.fixture
def paired(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, lines array<string>")
    out = df.withColumn("t", tag_lines(F.col("lines"))).withColumn("p", pair_tagged(F.col("t")))
    return {r.i: r.p for r in out.collect()}


def test_pairing(paired):
    for i, (_, expected) in enumerate(CASES):
        assert paired[i] == expected, CASES[i]


def test_sections(spark):
    lines = [["a", "## H", "## I", "b", "c", "## J"], ["## K", "x"], ["only"], ["## L"]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, lines array<string>")
    got = {r.i: [(s.heading, s.lines) for s in r.s]
           for r in df.select("i", assemble_sections(F.col("lines")).alias("s")).collect()}
    assert got == {0: [("Overview", ["a"]), ("I", ["b", "c"])], 1: [("K", ["x"])], 2: [("Overview", ["only"])], 3: []}
