"""The same operators in ``spark.sql``: session functions and a table function.

    register(spark)
    SELECT lf_pii_types(text), lf_scrub_pii(text), lf_strip_urls(text), lf_has_phrase(text, 'exit load') FROM messages
    SELECT * FROM lf_page_lines(TABLE(SELECT page_no, html FROM pages) PARTITION BY page_no)

A session function is the operator's own expression as SQL text, so a query that uses it is planned as
one expression and stays in the JVM. Only the table function, which reads HTML, is Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from lanternfold.functions.html import read_page
from lanternfold.functions.text import phrase_text
from lanternfold.operators import generate as gn
from lanternfold.operators import guardrails as gr

# A call of an operator by its sign, outside of string literals: `=`(a, b) is how SQL takes it.
_PARTS = re.compile(r"'(?:[^'\\]|\\.)*'|`[^`]*`|(?<![\w.])(?:(?:and|or|not)(?=\()|(?:<=>|<=|>=|==|!=|[=<>+\-*/%!&|^~])(?=\())", re.S | re.I)


def sql_text(column: Column) -> str:
    """An expression as SQL that parses to the same expression."""
    return _PARTS.sub(lambda m: m[0] if m[0][0] in "'`" else f"`{m[0].lower()}`", column._jc.node().sql())


def has_phrase(text: Column, phrase: Column) -> Column:
    """Whether a text has the phrase's words one after another; the last may take an s."""
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(phrase), "[^a-z0-9]+", " ")))
    text = phrase_text(text)
    found = F.contains(text, F.concat(words, F.lit(" "))) | F.contains(text, F.concat(words, F.lit("s ")))
    return (words != F.lit(" ")) & found


def functions() -> dict[str, tuple[str, str, Column]]:
    """Name -> parameters, type of the result, expression over the parameters."""
    t = F.col("t")
    return {
        "lf_pii_types": ("t STRING", "ARRAY<STRING>", gr.pii_types("t")),
        "lf_scrub_pii": ("t STRING", "STRING", gr.scrub_pii(t)),
        "lf_strip_urls": ("t STRING", "STRING", gn.strip_urls(t)),
        "lf_postprocess": ("t STRING", "STRING", gn.postprocess(t)),
        "lf_has_phrase": ("t STRING, phrase STRING", "BOOLEAN", has_phrase(t, F.col("phrase"))),
    }


@udtf(returnType="page_no bigint, line_no int, line string")
class PageLines:
    """The readable lines of each page of a table (page_no, html); a page without any has one empty line."""

    def eval(self, row):
        _, plain, _ = read_page(row["html"] or "")
        for number, line in enumerate("\n".join(plain).split("\n")):
            yield row["page_no"], number, line


def register(spark: SparkSession) -> None:
    """Make the functions known to the session."""
    for name, (parameters, result, body) in functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {sql_text(body)}")
    spark.udtf.register("lf_page_lines", PageLines)
