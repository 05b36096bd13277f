import json
import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternfold.operators import chunks as ch
from lanternfold.operators import diagnostics as dg
from lanternfold.operators import embed as em
from lanternfold.operators import generate as gn
from lanternfold.operators import rerank as rr
from lanternfold.plans import answer as an
from lanternfold.plans import ingest as ig
from lanternfold.rules import EMPTY_CORPUS, FUNDS, NOT_IN_PAGES
from lanternfold.session import checkpoint_dir, release, stage
from lanternfold.settings import Settings, load_settings
from lanternfold.sources import collection as cl
from lanternfold.sources import pages as pg
from lanternfold.sources import reports as rp
from lanternfold.sources.web import WebPages, backoff, fetch

STAMP = "2026-10-01T16:18:43+00:00"
CARD = """<html><head><title>Flexi</title></head><body><nav>menu</nav><h2>Key facts</h2>
<div>TER</div><div>0.77%</div><div>NAV</div><div>2,181.07</div><div>Min SIP</div><div>₹ 100</div>
<div>Riskometer</div><div>Very High</div><div>Benchmark</div><div>NIFTY 500</div><h3>Exit Load</h3><p>NIL</p>
<h3>About</h3><p>The scheme invests across large and small companies and is open on every business day of the year.</p>
<h3>Graph</h3><p>Table</p></body></html>"""
HUB = "<title>Hub</title><p>Every document of the fund house is listed here, one line for each of the schemes and years.</p>"


def page_rows(spark, htmls=(HUB, CARD)):
    rows = [(i, FUNDS.approved_urls[i], h) for i, h in enumerate(htmls)]
    return spark.createDataFrame(rows, "page_no bigint, url string, html string")


@pytest.fixture
def settings(tmp_path):
    return Settings(data_dir=str(tmp_path / "data"), embedding_dim=128)


def test_ingest_answer_and_reingest(spark, settings):
    lines = []
    out = ig.ingest(spark, page_rows(spark), settings=settings, fetched_at=STAMP, on_progress=lines.append)
    assert (out["chunk_count"], out["dropped_count"], out["skipped"]) == (4, 2, False)
    assert out["url_count"] == 2 and out["max_fetched_at"] == STAMP
    listed = rp.manifest_urls(spark, settings.manifest_path).orderBy("page_no").collect()
    assert [r.url for r in listed] == list(FUNDS.approved_urls[:2])
    assert ig.ingest(spark, page_rows(spark), settings=settings)["skipped"]
    store = cl.Collection(spark, settings.collection_path)
    assert store.status() == {"populated": True, "count": 4, "error": None}
    assert rp.read_manifest(spark, settings.manifest_path)["chunk_count"] == 4
    dump = "\n".join(r.value for r in spark.read.text(settings.dump_path).collect())
    assert "=== CHUNK 4 ===" in dump and "     1  boilerplate" in dump and "END OF DUMP - 4 chunks" in dump

    calls = ["What is the expense ratio of HDFC Flexi Cap Fund?", "What is the exit load?", "Should I buy it?",
             "my PAN is ABCDE1234F", "   ", "tell me about SBI Liquid Fund"]
    qs = spark.createDataFrame(list(enumerate(calls)), "question_id bigint, question string")
    got = {r.question_id: r for r in an.answer(qs, settings=settings).collect()}
    assert "0.77%" in got[0].answer and not got[0].refused and got[0].citation_url == FUNDS.approved_urls[1]
    assert got[0].last_updated_from_sources == "Last updated from sources: 1 Oct 2026"
    assert got[0].debug.chunks[0].rank_note == "scheme+fact:ter"
    assert got[1].debug.chunks[0].rank_note == "heading:exit load" or got[1].refused
    assert [got[i].debug.intent for i in (2, 3, 5)] == ["advice", "pii", "out_of_scope"]
    assert got[4].answer == NOT_IN_PAGES and got[4].citation_url == FUNDS.default_url
    report = dg.contract_report(an.answer(qs, settings=settings)).first().asDict()
    assert report.pop("answers") == 6 and not any(report.values())

    # A page that shrinks leaves nothing behind after a rebuild.
    again = ig.ingest(spark, page_rows(spark, (HUB,)), settings=settings, reingest=True, fetched_at=STAMP)
    assert again["chunk_count"] == 1 and store.status()["count"] == 1


def test_prompt_sees_redacted_text_and_refusals_reach_no_model(spark, settings, tmp_path):
    ig.ingest(spark, page_rows(spark), settings=settings, fetched_at=STAMP)
    log = tmp_path / "prompts"

    def record(system, user, temperature, max_tokens):
        with open(log, "a") as f:
            f.write(json.dumps(user) + "\n")
        return "It is listed."

    asked = ["Should I buy?", "my number is 98765 43210", "which fund gave better returns", "What is the NAV of 4 parts?"]
    qs = spark.createDataFrame(list(enumerate(asked)), "question_id bigint, question string")
    out = {r.question_id: r for r in an.answer(qs, settings=settings, model=gn.CallableModel(record)).collect()}
    prompts = log.read_text().splitlines()
    assert len(prompts) == 1 and "What is the NAV" in prompts[0] and "CONTEXT:" in prompts[0]
    assert out[3].answer == "It is listed." and [out[i].refused for i in range(3)] == [True] * 3


def test_empty_corpus(spark, settings):
    qs = spark.createDataFrame([(1, "What is the NAV?"), (2, " "), (3, "my otp")], "question_id bigint, question string")
    got = {r.question_id: r for r in an.answer(qs, settings=settings).collect()}
    assert got[1].answer == EMPTY_CORPUS and got[1].debug.reason == "empty_corpus" and got[1].citation_url is None
    assert got[2].answer == NOT_IN_PAGES and got[3].debug.intent == "pii"


def test_nothing_to_store_and_deadline(spark, settings):
    with pytest.raises(RuntimeError, match="No chunks produced"):
        ig.ingest(spark, page_rows(spark, ("<p>too short</p>",)), settings=settings)
    assert Settings().ingest_deadline_seconds == 0  # none unless asked for
    late = Settings(data_dir=settings.data_dir, ingest_deadline_seconds=-1)
    with pytest.raises(ig.IngestTimeout, match="while loading pages"):
        ig.ingest(spark, page_rows(spark), settings=late)


def test_repeated_address_keeps_the_newest_page(spark, settings):
    rows = [(i, FUNDS.approved_urls[1], CARD if i == 3 else HUB) for i in range(4)]
    pages = spark.createDataFrame(rows, "page_no bigint, url string, html string")
    out = ig.ingest(spark, pages, settings=settings, fetched_at=STAMP)
    stored = cl.Collection(spark, settings.collection_path).read()
    assert out["chunk_count"] == stored.count() == stored.select("id").distinct().count() == 3


def test_all_or_nothing_load(spark, tmp_path):
    docs = pg.load_documents(page_rows(spark, (HUB, "<nav>x</nav>")), STAMP)
    with pytest.raises(pg.CorpusFetchError, match="failed for 1 pages, all listed in .*failed"):
        pg.require_complete(docs, str(tmp_path / "failed"))
    listed = spark.read.json(str(tmp_path / "failed")).collect()
    assert [r.url for r in listed] == [FUNDS.approved_urls[1]] and "No readable text" in listed[0].error
    assert pg.require_complete(docs.filter("error is null"), str(tmp_path / "none")).count() == 1


def test_lists_are_complete_whatever_their_length(spark, tmp_path):
    """No list is cut: 60 failures, 1,100 pages in the dump and the manifest, 60 pages without chunks."""
    bad = spark.range(60).select(F.col("id").alias("page_no"), F.concat(F.lit("u"), "id").alias("url"), F.lit("x").alias("error"))
    with pytest.raises(pg.CorpusFetchError, match="failed for 60 pages"):
        pg.require_complete(bad, str(tmp_path / "failed"))
    assert spark.read.json(str(tmp_path / "failed")).count() == 60
    counts = spark.range(1100).select(
        F.col("id").alias("page_no"), F.concat(F.lit("u"), "id").alias("url"), F.lit(STAMP).alias("fetched_at"),
        F.when(F.col("id") < 60, 0).otherwise(2).alias("chunks"), F.lit(1).alias("dropped"))
    assert rp.write_thin_pages(counts, str(tmp_path / "thin")) == 60
    facts = rp.manifest(rp.corpus_summary(counts), STAMP, Settings(), "e", 4)
    rp.write_manifest(counts, facts, str(tmp_path / "manifest"))
    assert rp.read_manifest(spark, str(tmp_path / "manifest"))["url_count"] == 1100
    assert rp.manifest_urls(spark, str(tmp_path / "manifest")).count() == 1100
    none = spark.createDataFrame([], "position bigint, block string")
    rp.write_dump(str(tmp_path / "dump"), rp.dump_rows(none, counts, [("short", 3)], 0, STAMP))
    lines = [r.value for r in spark.read.text(str(tmp_path / "dump")).collect()]
    assert sum(line.startswith("  - u") for line in lines) == 1100 and lines.index("  - u1099") < lines.index("     3  short")
    offsets = {r.page_no: r.first for r in rp.page_offsets(counts.select("page_no", "url", "chunks")).collect()}
    assert offsets == {i: max(0, i - 60) * 2 for i in range(1100)}
    rows = {(r.name, r.place): r.value for r in rp.entries(facts, counts).collect()}
    assert rows[("urls", 7)] == "u7" and rows[("url_count", None)] == "1100" and rows[("chunk_strategy.max_words", None)] == "200"


def test_allow_list(spark):
    pages = spark.createDataFrame([(FUNDS.approved_urls[0],), ("https://evil/",)], "url string")
    allow = spark.createDataFrame([(u,) for u in FUNDS.approved_urls], "url string")
    assert [r.url for r in pg.approved(pages).collect()] == [FUNDS.approved_urls[0]]
    assert [r.url for r in pg.rejected_by(pages, allow).collect()] == ["https://evil/"]
    with pytest.raises(ValueError, match="approved corpus: https://evil/"):
        pg.require_approved(pages, allow)


def test_raw_dump_round_trip(spark, tmp_path):
    docs = pg.load_documents(page_rows(spark), STAMP)
    pg.write_raw_dump(docs, str(tmp_path / "raw"))
    got = {r.slug: r.body for r in pg.read_raw_dump(spark, str(tmp_path / "raw")).collect()}
    want = {r.slug: r.text for r in docs.select(pg.slug(F.col("url")).alias("slug"), "text").collect()}
    assert got == want
    name = sorted(want)[0]
    one = pg.read_raw_dump(spark, str(tmp_path / "raw"), [name, "none"])
    assert [(r.slug, r.body) for r in one.collect()] == [(name, want[name])]
    pg.write_raw_dump(docs.limit(1), str(tmp_path / "raw"))
    assert pg.read_raw_dump(spark, str(tmp_path / "raw")).count() == 1


def test_a_lookup_opens_the_buckets_of_its_ids(spark, tmp_path):
    store = cl.Collection(spark, str(tmp_path / "c"), bucket_bytes=2000)
    store.replace(spark.range(3000).select(F.col("id").cast("string").alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("v")))
    found = store.read(ids=["7", "8", "nine"])
    assert {r.id for r in found.collect()} == {"7", "8"}
    files = {r.f for r in found.select(F.input_file_name().alias("f")).collect()}
    assert len(files) <= 2


def test_upsert_versions_and_latest(spark, tmp_path):
    store = cl.Collection(spark, str(tmp_path / "c"))
    assert store.status() == {"populated": False, "count": 0, "error": None}
    with pytest.raises(cl.CorpusEmptyError):
        store.read()
    first = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int")
    second = spark.createDataFrame([("b", 2), ("c", 2)], "id string, v int")
    assert store.upsert(first) == 2 and store.upsert(second) == 3 and store.upsert(second) == 3
    assert {r.id: r.v for r in store.read().collect()} == {"a": 1, "b": 2, "c": 2} and store.version() == 3
    # A write that was never committed is not seen, and is what a vacuum removes.
    first.write.parquet(str(tmp_path / "c" / "_part=lost"))
    assert store.version() == 3 and {r.id for r in store.read().collect()} == {"a", "b", "c"}
    assert "_part=lost" in store.vacuum() and {r.id: r.v for r in store.read().collect()} == {"a": 1, "b": 2, "c": 2}
    store.reset()
    assert not store.is_populated()
    many = spark.range(3000).select((F.col("id") % 3 % 2).alias("k"), F.col("id").alias("v"), F.lit("x").alias("w"))
    assert {r.k: r.v for r in cl.latest(many, "k", "v").collect()} == {0: 2999, 1: 2998}


def test_unreadable_store_and_manifest(spark, tmp_path):
    (tmp_path / "c" / "_commits").mkdir(parents=True)
    schema = T.StructType().add("id", "string").json()
    (tmp_path / "c" / "_commits" / "v4.json").write_text(
        json.dumps({"version": 4, "rows": 1, "parts": [{"name": "x", "bytes": 1, "gone": []}], "dead": [], "level": 0, "split": 0,
                    "made_with": {}, "schema": schema}))
    status = cl.Collection(spark, str(tmp_path / "c")).status()
    assert not status["populated"] and "AnalysisException" in status["error"]
    assert rp.read_manifest(spark, str(tmp_path / "none")) is None
    (tmp_path / "bad").write_text("{not json")
    assert rp.read_manifest(spark, str(tmp_path / "bad")) is None


def test_incoming_copies(spark, tmp_path):
    store = cl.Collection(spark, str(tmp_path / "c"))
    twice = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "id string, v int")
    assert store.upsert(twice) == 2
    assert store.upsert(spark.createDataFrame([("a", 5), ("a", 4)], "id string, v int")) == 2
    assert {r.id: r.v for r in store.read().collect()} == {"a": 5, "b": 1}
    merged = cl.upsert(twice, twice).collect()
    assert sorted((r.id, r.v) for r in merged) == [("a", 2), ("b", 1)]


def _files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_one_row_upsert_writes_one_small_file_and_marks(spark, tmp_path):
    store = cl.Collection(spark, str(tmp_path / "c"), bucket_bytes=8000)
    rows = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    assert store.replace(rows) == 2000
    log = store._log()
    buckets = (1 << log["level"]) + log["split"]
    assert buckets >= 10  # by the bytes
    store.bucket_bytes = 1 << 20  # small files take more than their rows did together: no split just now
    before = set(_files(tmp_path / "c"))
    assert store.upsert(spark.createDataFrame([("k7", "new")], "id string, v string")) == 2000
    written = [f for f in _files(tmp_path / "c") if f not in before]
    assert len(written) == 2 and before <= set(_files(tmp_path / "c"))  # the row and the word of marks; nothing was rewritten
    assert sum("dead-" in f for f in written) == 1 and all(os.path.getsize(f) < 3000 for f in written)
    got = {r.id: r.v for r in store.read().collect()}
    assert len(got) == 2000 and got["k7"] == "new"
    assert store.status() == {"populated": True, "count": 2000, "error": None}


def test_buckets_split_with_the_bytes_and_lose_no_row(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cl, "PARTS", 4)
    monkeypatch.setattr(cl, "NAMED", 3)
    store = cl.Collection(spark, str(tmp_path / "c"), bucket_bytes=3000)
    want, sizes = {}, []
    for step in range(9):
        low, high = step * 60, step * 60 + 200 * (step % 3 == 0) + 80
        rows = spark.range(low, high).select(F.col("id").cast("string").alias("id"), F.sha2((F.col("id") + step).cast("string"), 256).alias("v"))
        want |= {r.id: r.v for r in rows.collect()}
        assert store.upsert(rows) == len(want)
        log = store._log()
        sizes.append((1 << log["level"]) + log["split"])
        assert {r.id: r.v for r in store.read().collect()} == want
        assert len(log["parts"]) <= 6 and log["rows"] == store.read().count()
    assert sizes == sorted(sizes) and sizes[-1] > sizes[0]
    store.vacuum()
    assert {r.id: r.v for r in store.read().collect()} == want


@pytest.mark.parametrize("level, split, larger", [(0, 0, 5), (1, 1, 9), (2, 3, 8), (3, 0, 40)])
def test_growth_moves_only_rows_of_divided_buckets(spark, level, split, larger):
    before = (1 << level) + split
    after = before + larger
    new = cl.directory(after)
    moved = {cl._parent(b, level, split) for b in range(before, after)}
    found = spark.range(3000).select(cl.bucket_of(F.col("id"), level, split).alias("a"), cl.bucket_of(F.col("id"), *new).alias("b")).collect()
    assert {r.a for r in found} == set(range(before)) and max(r.b for r in found) < after
    assert all(r.a == r.b or r.a in moved for r in found)


def test_columns_may_be_added_but_not_changed(spark, tmp_path):
    store = cl.Collection(spark, str(tmp_path / "c"))
    store.replace(spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int"))
    store.upsert(spark.createDataFrame([("b", 2, "x")], "id string, v int, w string"))
    assert {tuple(r) for r in store.read().collect()} == {("a", 1, None), ("b", 2, "x")}
    with pytest.raises(ValueError, match="column v"):
        store.upsert(spark.createDataFrame([("c", "2")], "id string, v string"))


def test_rows_of_another_maker_are_refused(spark, tmp_path):
    store = cl.Collection(spark, str(tmp_path / "c"))
    rows = spark.createDataFrame([("a", 1)], "id string, v int")
    store.upsert(rows, {"embedder": "hash"})
    with pytest.raises(cl.OtherMakerError, match="extended"):
        store.upsert(rows, {"embedder": "other"})
    assert store.read({"embedder": "hash"}).count() == 1
    store.replace(rows, {"embedder": "other"})
    assert store.read({"embedder": "other"}).count() == 1
    store.replace(rows)
    with pytest.raises(cl.OtherMakerError, match="does not say"):
        store.upsert(rows, {"embedder": "hash"})


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    one, two = (cl.Collection(spark, str(tmp_path / "c")) for _ in range(2))
    rows = spark.createDataFrame([("a", 1)], "id string, v int")
    one.replace(rows)
    log = two._log()
    one.upsert(spark.createDataFrame([("b", 2)], "id string, v int"))
    with pytest.raises(cl.ConcurrentWriteError):
        two._commit(log)
    assert {r.id for r in one.read().collect()} == {"a", "b"}


def test_features_of_old_and_new_rows(spark, settings):
    """Rows upserted with another pack's features leave nulls in the old ones; these are made anew."""
    other = replace(FUNDS, topic_phrases={**FUNDS.topic_phrases, "nav": ("nav", "value")})
    assert other.fingerprint != FUNDS.fingerprint
    ig.ingest(spark, page_rows(spark), settings=settings, fetched_at=STAMP)
    more = spark.createDataFrame([(5, FUNDS.approved_urls[2], CARD.replace("NIFTY 500", "NIFTY 100"))], "page_no bigint, url string, html string")
    store = cl.Collection(spark, settings.collection_path)
    rows = em.embed(rr.with_chunk_features(ch.kept_chunks(ig.page_chunks(more, STAMP, other)), other), "text", em.choose_embedder(settings))
    before = store.status()["count"]
    assert store.upsert(rows, an.embedder_of(em.choose_embedder(settings))) > before
    qs = spark.createDataFrame([(1, "What is the NAV and exit load?")], "question_id bigint, question string")
    for pack in (FUNDS, other):
        assert an.answer(qs, settings=settings, pack=pack).first().debug.chunks


def test_a_rebuild_encodes_changed_texts_only(spark, settings):
    first = ig.ingest(spark, page_rows(spark), settings=settings, fetched_at=STAMP)
    assert first["encoded_count"] == first["chunk_count"] == 4
    again = ig.ingest(spark, page_rows(spark), settings=settings, fetched_at=STAMP, reingest=True)
    assert again["encoded_count"] == 0 and again["chunk_count"] == 4
    changed = ig.ingest(spark, page_rows(spark, (HUB.replace("Every", "Each"), CARD)), settings=settings, fetched_at=STAMP, reingest=True)
    assert changed["encoded_count"] == 1 and changed["chunk_count"] == 4
    rows = cl.Collection(spark, settings.collection_path).read().collect()
    fresh = {r.id: r.embedding for r in em.embed(spark.createDataFrame([(r.id, r.text) for r in rows], "id string, text string"), "text",
                                               em.choose_embedder(settings)).collect()}
    assert {r.id: r.embedding for r in rows} == fresh
    other = Settings(data_dir=settings.data_dir, embedding_dim=64)
    assert ig.ingest(spark, page_rows(spark), settings=other, fetched_at=STAMP, reingest=True)["encoded_count"] == 4


class SlowEmbedder(em.HashingEmbedder):
    def encode(self, text):
        @F.pandas_udf("array<float>")
        def wait(texts):
            import time

            time.sleep(60)
            return texts

        return wait(text)


def test_a_stage_past_the_limit_is_stopped_and_the_old_version_stays(spark, settings):
    import time

    ig.ingest(spark, page_rows(spark), settings=settings, fetched_at=STAMP)
    store = cl.Collection(spark, settings.collection_path)
    before = (store.version(), sorted(r.id for r in store.read().collect()))
    late = replace(settings, ingest_deadline_seconds=8)
    began = time.monotonic()
    with pytest.raises(ig.IngestTimeout, match="exceeded 8s while embedding chunks"):
        ig.ingest(spark, page_rows(spark, (HUB,)), settings=late, fetched_at=STAMP, reingest=True, embedder=SlowEmbedder(128, name="slow"))
    assert time.monotonic() - began < 40
    assert (store.version(), sorted(r.id for r in store.read().collect())) == before
    assert spark.range(5).count() == 5  # later jobs run


def test_pages_without_address(spark, settings):
    rows = [(0, None, HUB), (1, FUNDS.approved_urls[1], CARD)]
    for repeats in ([], [(2, FUNDS.approved_urls[1], CARD)]):
        staged = ig.page_chunks(spark.createDataFrame(rows + repeats, "page_no bigint, url string, html string"), STAMP)
        kept, fewer = ig.newest_pages(staged.drop("text"))
        assert fewer == bool(repeats) and {r.url for r in kept.collect()} == {None, FUNDS.approved_urls[1]}


def test_collection_is_bound_to_its_embedder(spark, settings):
    ig.ingest(spark, page_rows(spark), settings=settings, fetched_at=STAMP, embedder=em.HashingEmbedder(128))
    qs = spark.createDataFrame([(1, "What is the NAV?")], "question_id bigint, question string")
    assert an.answer(qs, settings=settings, embedder=em.HashingEmbedder(128)).count() == 1
    with pytest.raises(cl.OtherMakerError, match="feature-hashing"):
        an.answer(qs, settings=settings, embedder=em.HashingEmbedder(128, name="another"))


@pytest.mark.parametrize("shape", ["filter", "select", "both"])
def test_model_is_called_once_per_question(spark, settings, tmp_path, shape):
    ig.ingest(spark, page_rows(spark), settings=settings, fetched_at=STAMP)
    log = tmp_path / f"calls-{shape}"

    def record(system, user, temperature, max_tokens):
        with open(log, "a") as f:
            f.write(json.dumps(system) + "\n")
        return "It is listed."

    pack = replace(FUNDS, system_prompt="Say little.")
    qs = spark.createDataFrame([(i, f"What is the NAV of plan {i} of Flexi Cap?") for i in range(10)], "question_id bigint, question string")
    out = an.answer(qs, settings=settings, model=gn.CallableModel(record), pack=pack)
    if shape != "select":
        out = out.filter("NOT refused")
    if shape != "filter":
        out = out.select("question_id", "answer", F.length("answer").alias("n"), "refused")
    assert len(out.collect()) == 10
    calls = log.read_text().splitlines()
    assert len(calls) == 10 and set(calls) == {json.dumps("Say little.")}


def test_staging_needs_a_shared_folder(spark):
    class Cluster:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Cluster)
    assert checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    staged = stage(spark.range(3), "test")
    path = staged.inputFiles()[0].replace("file://", "")
    assert path.startswith(spark.conf.get("spark.checkpoint.dir")) and os.path.exists(path) and staged.count() == 3
    release(staged)
    assert not os.path.exists(path)


def test_fetch_tries_again_only_after_transport_errors():
    assert list(backoff(4)) == [0, 2, 4, 8] and list(backoff(0)) == []
    waits, answers = [], iter([OSError("reset"), TimeoutError("slow"), "<p>ok</p>"])

    def get(url, timeout):
        found = next(answers)
        if isinstance(found, Exception):
            raise found
        return found

    got = fetch("u", {"u"}, backoff(3), get=get, sleep=waits.append)
    assert (got.html, got.error, got.tries, waits) == ("<p>ok</p>", None, 3, [2, 4])
    assert "allow-list" in fetch("v", {"u"}, backoff(3), get=get).error
    answers = iter([OSError("one"), OSError("two")])
    lost = fetch("u", {"u"}, backoff(2), get=get, sleep=waits.append)
    assert lost.html is None and lost.tries == 2 and lost.error.endswith("two")
    answers = iter([ValueError("odd"), "never asked for"])
    assert fetch("u", {"u"}, backoff(3), get=get).tries == 1


def test_web_source_reads_and_reports_errors(spark, tmp_path):
    (tmp_path / "p.html").write_text(HUB)
    urls = [f"file://{tmp_path}/p.html", f"file://{tmp_path}/none.html"]
    spark.dataSource.register(WebPages)
    got = {r.page_no: r for r in spark.read.format("web_pages").option("urls", json.dumps(urls))
           .option("attempts", "1").load().collect()}
    assert got[0].html == HUB and got[0].error is None
    assert got[1].html is None and "no answer in 1 tries" in got[1].error


def test_settings_sources(spark, monkeypatch):
    monkeypatch.setenv("TOP_K", "7")
    spark.conf.set("spark.lanternfold.embedding_dim", "99")
    got = load_settings(spark, data_dir="/d")
    spark.conf.unset("spark.lanternfold.embedding_dim")
    assert (got.top_k, got.embedding_dim, got.data_dir, got.collection_path) == (7, 99, "/d", "/d/faq_chunks")


def test_stream(spark, settings, tmp_path):
    from lanternfold.streaming.questions import answer_stream

    ig.ingest(spark, page_rows(spark), settings=settings, fetched_at=STAMP)
    spark.createDataFrame([(1, "What is the NAV?"), (2, "my otp")], "question_id bigint, question string").write.json(str(tmp_path / "q"))
    source = spark.readStream.schema("question_id bigint, question string").json(str(tmp_path / "q"))
    target = str(tmp_path / "answers")
    writer = answer_stream(source, lambda df, i: df.write.mode("append").parquet(target), settings=settings)
    folder = spark.conf.get("spark.checkpoint.dir") + "/lanternfold"
    before = set(os.listdir(folder))
    writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert set(os.listdir(folder)) == before
    assert {r.question_id: r.refused for r in spark.read.parquet(target).collect()}[2] is True


def test_plan_shapes(spark, settings):
    """Screening and chunking shuffle nothing; only k narrow rows per task leave the search."""
    from lanternfold.operators.chunks import kept_chunks

    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    staged = ig.page_chunks(page_rows(spark).repartition(4), STAMP)
    plan = kept_chunks(staged)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Window" not in plan and "Join" not in plan
    screened = an.screen(spark.createDataFrame([(1, "x")], "question_id bigint, question string"))
    plan = screened._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
