"""Registered queries against their DuckDB counterparts on the smallest tables."""

import collections
import os

import pytest
from pyspark.sql import functions as F

from lanternfold.plans.oracles import ORACLES
from lanternfold.plans.queries import QUERIES
from lanternfold.plans.sql import functions, register, sql_text

DATA = "/root/testdata/sf0.001"
SAMPLE = ("htm6_card_sections", "htm10_pairs", "chk6_overlap_blocks", "chk12_chunks", "vec6_rerank", "vec8_nearest",
          "grd8_detect", "grd9_scrub", "gen1_strip_urls", "gen10_gates", "orc1_answers", "snk7_dump_blocks", "src7_collection_scan",
          "snk3_upsert", "snk6_population", "snk11_guards", "snk8_manifest", "vec8_pruned", "agg1_drop_reasons",
          "grd10_rule_table", "vec2_phrase_table", "grd8_sql", "grd9_sql", "gen1_sql", "vec2_sql", "htm1_sql", "agg7_short_runs")
NO_SQL = {"vec8_opened", "emb1_piece_window"}  # how much of an index was opened; ids of a tokenizer


def plain(value):
    return round(value, 6) + 0.0 if isinstance(value, float) else value


def test_every_query_has_a_counterpart():
    assert set(ORACLES) | NO_SQL == set(QUERIES) and not NO_SQL & set(ORACLES)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="tables not present")
@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{file}')")
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    expected = collections.Counter(tuple(map(plain, r)) for r in result.fetchall())
    rows = QUERIES[name](spark, DATA)
    assert sorted(rows.columns) == sorted(columns)
    assert collections.Counter(tuple(map(plain, r)) for r in rows.select(*[f"`{c}`" for c in columns]).collect()) == expected


def test_session_functions_stay_in_the_jvm(spark):
    register(spark)
    spark.createDataFrame([("mail a@b.example.org", "x"), ("it's 5 < 6 and not = 7", None)], "text string, n string").createOrReplaceTempView("said")
    calls = ", ".join(f"{name}({'text, n' if name == 'lf_has_phrase' else 'text'})" for name in functions())
    rows = spark.sql(f"SELECT {calls} FROM said")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert rows.collect()[0][0] == ["email"]


def test_signs_in_texts_are_left_alone():
    assert sql_text(F.when(F.col("a") == F.lit("=(and(\\'"), F.col("b") + 1)).startswith("CASE WHEN `=`(a, '=(and(")


def test_page_lines_of_a_table(spark):
    register(spark)
    pages = spark.createDataFrame([(1, "<p>a<p>b"), (2, None), (1, "<p>c")], "page_no bigint, html string")
    got = spark.sql("SELECT * FROM lf_page_lines(TABLE({pages}) PARTITION BY page_no)", pages=pages).collect()
    assert sorted(map(tuple, got)) == [(1, 0, "a"), (1, 0, "c"), (1, 1, "b"), (2, 0, "")]
