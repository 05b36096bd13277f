"""Registered queries against their DuckDB counterparts, and the pipeline by stages."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lanternfold.llm import mixing, packing, quality
from lanternfold.llm.common import WordEncoder
from lanternfold.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def _rows(frame):
    columns = sorted(frame.columns)
    return sorted(map(str, frame[columns].astype(object).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    assert _rows(QUERIES[name](spark, SF).toPandas()) == _rows(con.sql(ORACLES[name]).df())


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frame, counts = docs, [docs.count()]
    for i, (_, function) in enumerate(corpus_pipeline.STAGES):
        out = function(spark, frame, SF)
        out.write.parquet(f"{tmp_path}/{i}")
        frame = spark.read.parquet(f"{tmp_path}/{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert frame.columns == docs.columns
        counts.append(frame.count())
    assert counts[0] >= counts[1] > counts[2] >= counts[3] <= counts[4] <= 2 * counts[3] < counts[5] * 2
    kept = spark.read.parquet(f"{tmp_path}/2")
    assert set(r.doc_id for r in spark.read.parquet(f"{tmp_path}/3").select("doc_id").distinct().collect()) == set(
        r.doc_id for r in kept.select("doc_id").collect())
    pieces = frame.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("whole"))
    assert pieces.where("n % whole <> 0").count() == 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def _lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def _shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", _lower(text))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def _planted():
    """Documents with exact copies, near copies, chains of near copies, bad texts, nulls and odd columns."""
    rng = random.Random(2)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "ru") for b in ("ta", "so", "vi", "de", "pu", "ra")]
    docs = []

    def add(text, source):
        docs.append((len(docs) * 3 + 1, text, "en", source, len(text or ""), len(docs), f"x{len(docs)}", None, "row"))

    for k in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([30, 60, 120]))]
        add(" ".join(base), f"s{k % 3}")
        if k % 4 == 0:
            add(" ".join(base).upper(), "s0")
        if k % 5 == 0:
            for step in range(3):  # each near the one before
                base = base[1:] + [f"new{k}x{step}"]
                add(" ".join(base), f"s{step}")
    for i in range(12):
        add("!!! $$$ " * (3 + i), "s1")
    for text in (None, "", "  ", "one", "one", "a b c d e f"):
        add(text, "s2")
    labels = [(d[0], int(not (d[1] or "!").startswith("!")), 0) for d in docs]
    return docs, labels


def test_pipeline_row_by_row_against_brute_force(spark, tmp_path, monkeypatch):
    """The stages on planted documents against a chain by hand, with the classifier's scores as given."""
    docs, labels = _planted()
    names = "doc_id long, text string, lang string, source string, n_chars long, __id long, `a.b` string, __text string, __row string"
    spark.createDataFrame(docs, names).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame, outs = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (_, function) in enumerate(corpus_pipeline.STAGES):
        function(spark, frame, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        frame = spark.read.parquet(f"{tmp_path}/{i}")
        outs.append([tuple(r) for r in frame.collect()])
    by_id = {d[0]: d for d in docs}

    scores = {r.doc_id: r.score for r in quality.classify(spark.read.parquet(f"{tmp_path}/documents.parquet"),
                                                         spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    accepted = [d for d in docs if scores[d[0]] >= quality.CUT]
    assert Counter(outs[0]) == Counter(accepted) and len(accepted) < len(docs)
    assert all(by_id[i] in accepted for i, q, _ in labels if q and len(by_id[i][1] or "") > 100)

    last = {}
    for d in accepted:
        last[_lower(d[1])] = max(d, last.get(_lower(d[1]), d), key=lambda x: x[0])
    assert Counter(outs[1]) == Counter(last.values()) and len(last) < len(accepted)

    kept = sorted(last.values(), key=lambda d: d[0])
    sets, label = [_shingles(d[1]) for d in kept], list(range(len(kept)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(kept)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    stay = [d for i, d in enumerate(kept) if find(i) == i]
    assert Counter(outs[2]) == Counter(stay) and len(stay) < len(kept)

    read = sorted(mixing.mix(spark.read.parquet(f"{tmp_path}/2")).collect(), key=lambda r: (r.block, r.position))
    assert set(Counter(outs[3])) == set(stay) and max(Counter(outs[3]).values()) <= 2
    in_order = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/3").coalesce(1).collect()]
    assert [d[0] for d in in_order] == [r.doc_id for r in read]  # one block: one file, in the order of the mix

    encoder = WordEncoder(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    pieces = []
    for d in outs[3]:
        ids = encoder.encode([d[1] or ""])[0] + np.array([2], "<u4").tobytes()
        n, start = len(ids) // 4, 0
        for size in packing.lengths_of(n, packing.LONGEST):
            pieces.append((d[0], start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), n))
            start += size
    packed = [(r.doc_id, r.start, r.length, zlib.crc32(bytes(r.ids)), r.doc_tokens) for r in frame.collect()]
    assert Counter(packed) == Counter(pieces)
