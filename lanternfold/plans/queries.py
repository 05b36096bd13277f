"""The registered queries: one per operator, over whole tables.

"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfold import rules
from lanternfold.functions import text as tx
from lanternfold.functions.arrays import let, unnest
from lanternfold.operators import chunks as ch
from lanternfold.operators import diagnostics as dg
from lanternfold.operators import embed as em
from lanternfold.operators import facts as fc
from lanternfold.operators import generate as gn
from lanternfold.operators import guardrails as gr
from lanternfold.operators import rerank as rr
from lanternfold.operators import rule_table as rt
from lanternfold.operators import search as se
from lanternfold.operators import sections as sc
from lanternfold.plans import corpora as co
from lanternfold.plans.answer import answer_from, embedder_of, screen
from lanternfold.plans.ingest import staged_counts
from lanternfold.plans.sql import register
from lanternfold.rules import FUNDS
from lanternfold.session import shared_folder, stage
from lanternfold.settings import Settings
from lanternfold.sources import collection as cl
from lanternfold.sources import pages as pg
from lanternfold.sources import reports as rp

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SETTINGS = Settings(embedding_dim=128)
EMBEDDER = em.HashingEmbedder(SETTINGS.embedding_dim)


def query(name: str) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        return build
    return register


def chunked(documents: DataFrame) -> DataFrame:
    return ch.chunk_pages(sc.to_sections(documents, FUNDS), FUNDS)


def web_chunks(spark, sf) -> DataFrame:
    return ch.kept_chunks(chunked(co.web_documents(spark, sf)))


_STORED: dict[tuple[str, str], str] = {}


def stored(spark, sf) -> cl.Collection:
    """The collection of the given pages, with vectors and re-rank features: built once for each
    session and table folder, in the session's shared folder, and removed with the application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORED:
        path = shared_folder(spark, "collection")
        rows = em.embed(rr.with_chunk_features(web_chunks(spark, sf), co.SAMPLE), "text", EMBEDDER)
        cl.Collection(spark, path).replace(rows, embedder_of(EMBEDDER))
        _STORED[key] = path
    return cl.Collection(spark, _STORED[key])


def collection(spark, sf) -> DataFrame:
    return stored(spark, sf).read(embedder_of(EMBEDDER))


def each_line(documents: DataFrame) -> DataFrame:
    return unnest(documents, "marked", "line_no", "line", "page_no")


# --- sources ---


@query("src1_allow_list")
def _(spark, sf):
    pages = co.table(spark, sf, "pages")
    secure = pages.filter(F.startswith("url", F.lit("https://"))).select("url")
    return pg.approved_by(pages, secure).select("page_id", "url")


@query("src1_rejected")
def _(spark, sf):
    pages = co.table(spark, sf, "pages")
    secure = pages.filter(F.startswith("url", F.lit("https://"))).select("url")
    return pg.rejected_by(pages, secure).select("page_id", "url")


@query("src4_fetch_documents")
def _(spark, sf):
    return co.web_documents(spark, sf).select("page_no", "url", "title", "text", "fetched_at")


@query("src5_load_failures")
def _(spark, sf):
    failed = pg.load_documents(co.supplier_pages(spark, sf), co.FETCHED_AT).filter(F.col("error").isNotNull())
    return failed.select("page_no", "url", "error")


@query("src7_collection_scan")
def _(spark, sf):
    return collection(spark, sf).select("id", "text", "url", "scheme", "heading", "chunk_index")


@query("src9_raw_body")
def _(spark, sf):
    dumped = pg.raw_dump(co.web_documents(spark, sf))
    body = pg.raw_body(F.col("value"))
    return dumped.select("slug", body.alias("body"), F.length(body).alias("chars"))


# --- sinks ---


@query("snk3_upsert")
def _(spark, sf):
    """The pages' chunks, then those of the secure pages again at a later date, through a collection."""
    store = cl.Collection(spark, shared_folder(spark, "upsert"), bucket_bytes=1 << 20)
    store.replace(web_chunks(spark, sf))
    again = co.web_documents(spark, sf, co.LATER).filter(F.startswith("url", F.lit("https://")))
    store.upsert(ch.kept_chunks(chunked(again)))
    return store.read().select("id", "url", "chunk_index", "fetched_at")


@query("snk3_upsert_rows")
def _(spark, sf):
    """The same replacement of one table's rows by another's, as a join."""
    stored = web_chunks(spark, sf)
    again = co.web_documents(spark, sf, co.LATER).filter(F.startswith("url", F.lit("https://")))
    incoming = stage(ch.kept_chunks(chunked(again)), "incoming")  # read for its ids and for its rows
    return cl.upsert(stored, incoming).select("id", "url", "chunk_index", "fetched_at")


@query("snk3_latest_by_key")
def _(spark, sf):
    return cl.latest(co.table(spark, sf, "events").select("user_id", "event_id", "event_type", "value"),
                     "user_id", "event_id")


@query("snk6_population")
def _(spark, sf):
    found = stored(spark, sf).status()
    if found["error"]:
        raise RuntimeError(found["error"])
    return spark.createDataFrame([(found["populated"], found["count"])], "populated boolean, n bigint")


@query("snk7_dump_blocks")
def _(spark, sf):
    return rp.dump_blocks(stage(chunked(co.web_documents(spark, sf)).drop("text"), "pages"))


@query("snk8_manifest")
def _(spark, sf):
    pages = stage(chunked(co.web_documents(spark, sf)).drop("text"), "pages", **rp.summary_columns())
    counts = staged_counts(pages)
    facts = rp.manifest(rp.summary_row(spark, pages.observed), co.LATER, SETTINGS, EMBEDDER.name, EMBEDDER.dim)
    return rp.entries(facts.drop("collection", "embedding_model", "collection_path", "chunks_txt"), counts)


@query("snk9_raw_dump")
def _(spark, sf):
    return pg.raw_dump(co.web_documents(spark, sf))


@query("snk10_slug")
def _(spark, sf):
    return co.table(spark, sf, "pages").select("page_id", tx.slug(F.col("url")).alias("slug"))


@query("snk11_guards")
def _(spark, sf):
    rows = stage(em.embed(web_chunks(spark, sf), "text", EMBEDDER), "guarded", chunks=F.count("*"), vectors=F.count("embedding"))
    n, vectors = rows.observed["chunks"], rows.observed["vectors"]
    kept = cl.Collection(spark, shared_folder(spark, "guarded")).upsert(rows, embedder_of(EMBEDDER))
    return spark.createDataFrame([(n > 0, n == vectors == kept)], "not_empty boolean, complete boolean")


# --- page parsing ---


@query("htm1_noise_tags")
def _(spark, sf):
    return unnest(co.web_documents(spark, sf), F.split("text", "\n"), "line_no", "line", "page_no")


@query("htm2_noise_markers")
def _(spark, sf):
    return co.card_documents(spark, sf).select("page_no", "text")


@query("htm3_title")
def _(spark, sf):
    return co.web_documents(spark, sf).select("page_no", "title")


@query("htm4_text")
def _(spark, sf):
    return co.web_documents(spark, sf).select("page_no", F.md5("text").alias("digest"), F.length("text").alias("chars"))


@query("htm5_headings")
def _(spark, sf):
    both = co.web_documents(spark, sf).unionByName(co.card_documents(spark, sf), allowMissingColumns=True)
    return each_line(both.select(F.col("url").alias("page_no"), "marked")).filter(fc.is_heading(F.col("line"))).select(
        F.col("page_no").alias("url"), "line_no", "line")


def _sections(documents: DataFrame) -> DataFrame:
    rows = unnest(sc.to_sections(documents), "sections", "section_no", "s", "url")
    return rows.select("url", "section_no", F.col("s.heading").alias("heading"),
                       F.array_join("s.lines", "\n").alias("body"), F.size("s.lines").alias("lines"))


@query("htm6_sections")
def _(spark, sf):
    return _sections(co.web_documents(spark, sf))


@query("htm6_card_sections")
def _(spark, sf):
    return _sections(co.card_documents(spark, sf))


@query("htm7_labels")
def _(spark, sf):
    lines = each_line(co.card_documents(spark, sf))
    return lines.filter(fc.is_label(F.col("line"))).select("page_no", "line_no", "line")


@query("htm8_values")
def _(spark, sf):
    lines = each_line(co.card_documents(spark, sf).select("page_no", "marked").unionByName(
        co.text_documents(spark, sf).select((-F.col("page_no") - 1).alias("page_no"), "marked")))
    return lines.select("page_no", "line_no", fc.is_value(F.col("line"), F.lit(False)).alias("value"),
                        fc.is_value(F.col("line"), F.lit(True)).alias("dated_value"))


@query("htm9_qualifiers")
def _(spark, sf):
    lines = each_line(co.card_documents(spark, sf).select("page_no", "marked").unionByName(
        co.text_documents(spark, sf).select((-F.col("page_no") - 1).alias("page_no"), "marked")))
    return lines.filter(fc.is_qualifier(F.col("line"))).select("page_no", "line_no", "line")


@query("htm10_pairs")
def _(spark, sf):
    tagged = co.card_documents(spark, sf).withColumn("t", fc.tag_lines(F.col("marked")))
    paired = tagged.withColumn("p", fc.pair_tagged(F.col("t")))
    return unnest(paired, "p", "line_no", "line", "page_no")


@query("htm12_scheme")
def _(spark, sf):
    pages = co.table(spark, sf, "pages").select(F.col("url").alias("page"))
    known = list(FUNDS.url_schemes)
    urls = F.when(F.startswith("page", F.lit("https://")), F.get(
        F.array(*[F.lit(u.rstrip("/")) for u in known]), F.length("page") % len(known))).otherwise(F.col("page"))
    return pages.select("page", sc.scheme_of(F.concat(urls, F.lit("/"))).alias("scheme"))


# --- chunking ---


@query("chk1_word_count")
def _(spark, sf):
    return co.documents(spark, sf).select("doc_id", tx.word_count(F.col("text")).alias("words"))


def _blocks(documents: DataFrame, build: Callable[[Column], Column]) -> DataFrame:
    rows = unnest(sc.to_sections(documents), "sections", "section_no", "s", "url")
    rows = unnest(rows, build(F.col("s.lines")), "block_no", "block", "url", "section_no")
    body = F.array_join("block", "\n")
    return rows.select("url", "section_no", "block_no", F.size("block").alias("lines"),
                       tx.word_count(body).alias("words"), F.md5(body).alias("digest"))


@query("chk2_section_blocks")
def _(spark, sf):
    return _blocks(co.web_documents(spark, sf), ch.section_blocks)


@query("chk3_pack")
def _(spark, sf):
    return _blocks(co.text_documents(spark, sf), ch.pack_lines)


@query("chk4_sentences")
def _(spark, sf):
    docs = co.documents(spark, sf)
    return unnest(docs, tx.split_sentences(F.col("text")), "sentence_no", "sentence", "doc_id").select(
        "doc_id", "sentence_no", F.md5("sentence").alias("digest"))


@query("chk5_overlap_tail")
def _(spark, sf):
    rows = unnest(sc.to_sections(co.text_documents(spark, sf)), "sections", "section_no", "s", "url")
    rows = unnest(rows, ch.pack_lines(F.col("s.lines")), "block_no", "block", "url")
    return rows.select("url", "block_no", F.array_join(ch.overlap_tail(F.col("block")), "\n").alias("tail"))


@query("chk6_overlap_blocks")
def _(spark, sf):
    return _blocks(co.text_documents(spark, sf), ch.section_blocks)


@query("chk7_chunk_text")
def _(spark, sf):
    return ch.kept_chunks(chunked(co.card_documents(spark, sf))).select("url", "chunk_index", "heading", "text")


@query("chk8_boilerplate")
def _(spark, sf):
    lines = co.text_documents(spark, sf).select("page_no", "marked").unionByName(
        co.card_documents(spark, sf).select((-F.col("page_no") - 1).alias("page_no"), "marked"))
    return each_line(lines).filter(ch.is_stop_phrase(F.col("line"))).select("page_no", "line_no", "line")


@query("chk9_drops")
def _(spark, sf):
    both = [ch.dropped_chunks(chunked(d)) for d in (co.card_documents(spark, sf), co.text_documents(spark, sf))]
    return both[0].unionByName(both[1])


@query("chk10_chunk_index")
def _(spark, sf):
    return ch.kept_chunks(chunked(co.card_documents(spark, sf))).groupBy("url").agg(
        F.count("*").alias("chunks"), F.max("chunk_index").alias("last_index"))


@query("chk11_chunk_id")
def _(spark, sf):
    return ch.kept_chunks(chunked(co.text_documents(spark, sf))).select("id", "url", "chunk_index")


@query("chk12_chunks")
def _(spark, sf):
    return ch.kept_chunks(chunked(co.text_documents(spark, sf))).select(
        "url", "title", "scheme", "fetched_at", "heading", "chunk_index", "word_count", F.md5("text").alias("digest"))


@query("chk13_empty_pages")
def _(spark, sf):
    return ch.empty_pages(chunked(co.text_documents(spark, sf)))


# --- vectors ---


@query("emb1_token_window")
def _(spark, sf):
    codes = em.hash_tokens(F.col("text"), EMBEDDER.dim, SETTINGS.max_sequence_length)
    words = F.regexp_count(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"))
    docs = co.documents(spark, sf).select("doc_id", words.alias("tokens"), codes.alias("codes"))
    return docs.select("doc_id", "tokens", F.size("codes").alias("in_window"),
                       F.aggregate("codes", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("code_sum"))


@query("emb1_piece_window")
def _(spark, sf):
    """The word pieces that the embedder of a tokenizer file looks at, and the norm of its vector."""
    import public_tokenizers

    embedder = em.PieceEmbedder(public_tokenizers.path("word_bpe_49k.json"), EMBEDDER.dim, SETTINGS.max_sequence_length)
    docs = co.documents(spark, sf).select("doc_id", "text", embedder.window(F.col("text")).alias("w"))
    vectors = em.embed(docs, "text", embedder)
    return vectors.select("doc_id", F.col("w.tokens").alias("tokens"), F.size("w.ids").alias("kept"),
                          F.aggregate("w.ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("id_sum"),
                          F.round(em.dot(F.col("embedding"), F.col("embedding")), 3).alias("norm"))


@query("emb2_mean_pool")
def _(spark, sf):
    pooled = em.pool_rows(co.table(spark, sf, "embeddings"), "label", "embedding")
    return unnest(pooled, "pooled", "pos", "x").select("label", "pos", F.round("x", 6).alias("x"))


@query("emb3_normalise")
def _(spark, sf):
    raw = co.table(spark, sf, "embeddings").select("vec_id", F.transform(
        "embedding", lambda x: x.cast("double") * (F.col("label") + 1)).alias("v"))
    unit = raw.select("vec_id", em.normalise(F.col("v")).alias("u"))
    return unit.select("vec_id", F.round(em.dot(F.col("u"), F.col("u")), 6).alias("norm"),
                       F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("emb4_dimension_check")
def _(spark, sf):
    vectors = co.table(spark, sf, "embeddings").select("vec_id", em.checked(F.col("embedding"), 64).alias("v"))
    return vectors.select("vec_id", F.size("v").alias("dim"))


@query("emb5_chunk_vectors")
def _(spark, sf):
    vectors = em.embed(web_chunks(spark, sf), "text", EMBEDDER)
    return vectors.select("id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"),
                          F.size(F.filter("embedding", lambda x: x != 0)).alias("used"))


@query("emb6_question_vectors")
def _(spark, sf):
    vectors = em.embed(co.questions(spark, sf), "question", EMBEDDER)
    return vectors.select("question_id", F.round(em.dot(F.col("embedding"), F.col("embedding")), 4).alias("norm"),
                          F.size(F.filter("embedding", lambda x: x != 0)).alias("used"))


@query("emb8_agreement")
def _(spark, sf):
    pairs = co.table(spark, sf, "embeddings").select("vec_id", "embedding", F.transform(
        "embedding", lambda x: F.round(x.cast("double"), 3)).alias("coarse"))
    similarity = F.lit(1.0) - F.col("distance")
    return se.with_distance(pairs, "embedding", "coarse").agg(
        F.count("*").alias("n"), F.round(F.min(similarity), 5).alias("worst"),
        F.bool_and(similarity >= 0.999).alias("agree"))


@query("vec1_distance_to_label_mean")
def _(spark, sf):
    vectors = co.table(spark, sf, "embeddings")
    means = em.pool_rows(vectors, "label", "embedding")
    return se.with_distance(vectors.join(means, "label"), "embedding", "pooled").select(
        "vec_id", "label", F.round("distance", 5).alias("distance"))


def _nearest(spark, sf, settings: Settings) -> DataFrame:
    """The vectors nearest to each label's mean vector, searched exhaustively."""
    vectors = co.table(spark, sf, "embeddings")
    asked = em.pool_rows(vectors, "label", "embedding").select(
        F.col("label").cast("bigint").alias("question_id"), F.col("pooled").alias("embedding"))
    stored = vectors.select(F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("id"), "embedding")
    found = se.top_k(asked, stored, 4, settings)
    return found.select("question_id", "rank", F.col("id").cast("bigint").alias("vec_id"),
                        F.round("distance", 5).alias("distance"))


@query("vec8_nearest")
def _(spark, sf):
    return _nearest(spark, sf, SETTINGS)


@query("vec8_grid")
def _(spark, sf):
    """The same with several groups of questions and of chunks."""
    return _nearest(spark, sf, replace(SETTINGS, cell_questions=3, cell_chunks=120))


PRUNED = replace(SETTINGS, cell_chunks=16)


def _first_chunks(spark, sf) -> DataFrame:
    """The vector of each page's first chunk, as a question."""
    return collection(spark, sf).where("chunk_index = 0").select(F.col("page_no").cast("bigint").alias("question_id"), "embedding")


@query("vec8_pruned")
def _(spark, sf):
    """What is nearest to each page's first chunk, with small balls, so that many of them stay closed."""
    found = se.top_k(_first_chunks(spark, sf), collection(spark, sf).select("id", "embedding"), 5, PRUNED)
    return found.select("question_id", "rank", "id", (F.round("distance", 5) + 0.0).alias("distance"))


@query("vec8_opened")
def _(spark, sf):
    """How many balls each question opened for that."""
    return se.opened(se.run_search(_first_chunks(spark, sf), collection(spark, sf).select("id", "embedding"), 5, PRUNED))


def phrase_flags(texts: DataFrame, key: str, text: str) -> DataFrame:
    prepared = tx.phrase_text(F.col(text))
    return texts.select(key, tx.has_phrase(prepared, ("of the",)).alias("of_the"),
                        tx.has_phrase(prepared, ("ter", "nav", "que")).alias("short_words"),
                        tx.has_phrase(prepared, ("de la", "est", "ention")).alias("mixed"))


@query("vec2_phrases")
def _(spark, sf):
    return phrase_flags(co.documents(spark, sf), "doc_id", "text")


@query("vec3_topics")
def _(spark, sf):
    q = rr.with_question_features(co.questions(spark, sf), "question", co.SAMPLE)
    return q.select("question_id", F.array_join(rr.topic_names(F.col("topics"), co.SAMPLE), "|").alias("topics"))


@query("vec4_schemes")
def _(spark, sf):
    q = rr.with_question_features(co.questions(spark, sf), "question", co.SAMPLE)
    return q.select("question_id", F.array_join("schemes", "|").alias("schemes"))


@query("vec5_topic_hits")
def _(spark, sf):
    rows = rr.with_chunk_features(web_chunks(spark, sf), co.SAMPLE)
    return rows.select("id", F.array_join(F.transform(rr.feature_column(co.SAMPLE), lambda x: x.cast("string")), "").alias("hits"))


def retrieved(spark, sf, k: int | None = None) -> DataFrame:
    asked = em.embed(co.questions(spark, sf), "question", EMBEDDER)
    return se.retrieve(asked, collection(spark, sf), k, co.SAMPLE, SETTINGS)


@query("vec6_rerank")
def _(spark, sf):
    return retrieved(spark, sf).select(
        "question_id", "rank", "id", "url", "rank_note", F.round("distance", 5).alias("distance"),
        F.round("score", 5).alias("score"))


@query("vec7_boost")
def _(spark, sf):
    """All pairs of questions and chunks, not the winners only."""
    return se.boost_report(co.questions(spark, sf), collection(spark, sf), co.SAMPLE, SETTINGS)


def _gathered(spark, sf) -> DataFrame:
    asked = co.questions(spark, sf)
    return asked.join(gn.gather(retrieved(spark, sf)), "question_id", "left")


def _no_hits(df: DataFrame) -> DataFrame:
    return df.withColumn("hits", F.coalesce("hits", F.array().cast(df.schema["hits"].dataType)))


@query("vec9_blank_questions")
def _(spark, sf):
    return _no_hits(_gathered(spark, sf)).select("question_id", F.size("hits").alias("chunks"))


@query("vec10_context")
def _(spark, sf):
    return _no_hits(_gathered(spark, sf)).select("question_id", F.md5(gn.context_block(F.col("hits"))).alias("digest"))


@query("vec11_citation")
def _(spark, sf):
    return _no_hits(_gathered(spark, sf)).select("question_id", gn.best_url(F.col("hits"), co.SAMPLE).alias("url"))


@query("vec12_low_confidence")
def _(spark, sf):
    rows = _no_hits(_gathered(spark, sf))
    return rows.select("question_id", gn.is_low_confidence(F.col("hits")).alias("low"),
                       F.round(gn.best_distance(F.col("hits")), 4).alias("best"))


# --- guardrails ---


def _flag(spark, sf, pattern: str, name: str) -> DataFrame:
    return co.screened_texts(spark, sf).select("key", F.col("text").rlike(pattern).alias(name))


@query("grd1_pan")
def _(spark, sf):
    return _flag(spark, sf, gr.PAN, "pan")


@query("grd2_otp")
def _(spark, sf):
    return _flag(spark, sf, gr.OTP, "otp")


@query("grd3_email")
def _(spark, sf):
    return _flag(spark, sf, gr.EMAIL, "email")


@query("grd4_phone")
def _(spark, sf):
    rows = co.screened_texts(spark, sf).withColumn("p", gr.first_phone(F.col("text")))
    return rows.filter(F.col("p.start") >= 0).select("key", F.col("p.start").alias("start"), F.col("p.stop").alias("stop"))


@query("grd5_twelve_digits")
def _(spark, sf):
    groups = let(gr.first_phone(F.col("text")), lambda phone: gr.twelve_digit_groups(F.col("text"), phone))
    rows = co.screened_texts(spark, sf).withColumn("g", groups)
    return rows.filter(F.size("g") > 0).select(
        "key", F.array_join(F.transform("g", lambda x: x["kind"]), "|").alias("kinds"))


@query("grd6_checksum")
def _(spark, sf):
    orders = co.table(spark, sf, "orders")
    digits = F.lpad((F.col("o_orderkey") * 7919 + F.col("o_custkey") * 104729).cast("string"), 12, "1")
    return orders.select("o_orderkey", gr.checksum_valid(digits).alias("valid"))


@query("grd7_account")
def _(spark, sf):
    found = gr.detect_pii(co.screened_texts(spark, sf), "text")
    return found.select("key", F.size(F.filter("pii_types", lambda x: x == "account")).alias("accounts"))


@query("grd8_detect")
def _(spark, sf):
    return gr.detect_pii(co.screened_texts(spark, sf), "text").select(
        "key", F.array_join("pii_types", "|").alias("pii_types"))


@query("grd9_scrub")
def _(spark, sf):
    return co.screened_texts(spark, sf).select("key", F.md5(gr.scrub_pii(F.col("text"))).alias("digest"))


@query("grd10_names")
def _(spark, sf):
    names = ("of the", "de-la", "que", "und")
    return co.documents(spark, sf).select("doc_id", gr.names_any(F.col("text"), names).alias("named"))


@query("grd10_rule_table")
def _(spark, sf):
    """Every document against all names of a table: the first two words of each document, by source."""
    docs = co.documents(spark, sf)
    names = docs.select(F.col("source").alias("rule"), F.regexp_extract("text", r"\A([a-zA-Z]+ [a-zA-Z]+)\b", 1).alias("phrase")).where("phrase <> ''")
    return rt.matches(docs, "doc_id", "text", names)


@query("vec2_phrase_table")
def _(spark, sf):
    """Every chunk of the pages against a phrase of each benchmark item, its second and third word."""
    phrases = co.table(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("rule"), F.regexp_extract(F.lower("text"), r"\A[a-z]+ ([a-z]+ [a-z]+)[^a-z0-9]", 1).alias("phrase")).where("phrase <> ''")
    return rt.matches(collection(spark, sf), "id", "text", phrases, "phrase")


@query("grd11_performance")
def _(spark, sf):
    return co.questions(spark, sf).select("question_id", gr.is_performance(F.col("question")).alias("performance"))


@query("grd12_advice")
def _(spark, sf):
    return co.questions(spark, sf).select("question_id", gr.is_advice(F.col("question")).alias("advice"))


@query("grd13_out_of_scope")
def _(spark, sf):
    return co.questions(spark, sf).select("question_id", gr.is_out_of_scope(F.col("question")).alias("out_of_scope"))


@query("grd14_classify")
def _(spark, sf):
    return gr.classify(co.questions(spark, sf), "question").select(
        "question_id", "intent", "allowed", "message", "link", F.array_join("pii_types", "|").alias("pii_types"))


# --- generation ---


@query("gen1_strip_urls")
def _(spark, sf):
    return co.completions(spark, sf).select("question_id", gn.strip_urls(F.col("completion")).alias("clean"))


@query("gen2_trim")
def _(spark, sf):
    return co.completions(spark, sf).select("question_id", gn.trim_sentences(F.col("completion")).alias("trimmed"))


@query("gen3_postprocess")
def _(spark, sf):
    return co.completions(spark, sf).select("question_id", gn.postprocess(F.col("completion")).alias("answer"))


@query("gen4_decline")
def _(spark, sf):
    return co.completions(spark, sf).select("question_id", gn.is_decline(F.col("completion")).alias("decline"))


@query("gen5_numbers")
def _(spark, sf):
    docs = co.documents(spark, sf)
    return docs.select("doc_id", F.array_join(F.array_sort(tx.numbers(F.col("text"))), "|").alias("numbers"))


def _with_completions(spark, sf) -> DataFrame:
    """Each completion next to the chunks of the question before it."""
    answered = co.completions(spark, sf).withColumn("question_id", F.col("question_id") - 1)
    return _no_hits(_gathered(spark, sf)).join(answered, "question_id")


@query("gen6_ungrounded")
def _(spark, sf):
    context = F.array_join(F.transform("hits", lambda h: h["text"]), " ")
    orphans = gn.ungrounded_numbers(gn.postprocess(F.col("completion")), context)
    return _with_completions(spark, sf).select("question_id", F.array_join(orphans, "|").alias("orphans"))


@query("gen7_source_date")
def _(spark, sf):
    stamp = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("about "), F.col("event_type"))).otherwise(
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")))
    return co.table(spark, sf, "events").select("event_id", gn.source_date(stamp).alias("shown"))


@query("gen8_last_updated")
def _(spark, sf):
    rows = _no_hits(_gathered(spark, sf))
    return rows.select("question_id", gn.last_updated(F.get("hits", F.lit(0))["fetched_at"]).alias("shown"))


def _responses(rows: DataFrame) -> DataFrame:
    debug = F.col("debug")
    return rows.select(
        "question_id", "answer", "citation_url", "last_updated_from_sources", "refused",
        debug["intent"].alias("intent"), F.array_join(debug["pii_types"], "|").alias("pii_types"),
        debug["reason"].alias("reason"), debug["model"].alias("model"), debug["best_distance"].alias("best_distance"),
        F.array_join(debug["ungrounded_numbers"], "|").alias("ungrounded"),
        F.coalesce(F.size(debug["chunks"]), F.lit(-1)).alias("chunks"))


class GivenCompletions:
    """Completions that already sit in a column."""

    name = "given"

    def complete(self, question, context, hits):
        return F.when(question.isNotNull(), F.col("completion"))


@query("gen10_gates")
def _(spark, sf):
    return _responses(gn.respond(_with_completions(spark, sf), GivenCompletions(), co.SAMPLE, co.LATER))


@query("gen12_declines")
def _(spark, sf):
    rows = gn.respond(_with_completions(spark, sf), GivenCompletions(), co.SAMPLE, co.LATER)
    return rows.filter(F.col("debug.reason") == "model_declined").select("question_id", "citation_url", "refused")


@query("gen11_not_in_pages")
def _(spark, sf):
    rows = gn.respond(_with_completions(spark, sf), GivenCompletions(), co.SAMPLE, co.LATER)
    return rows.filter("refused").select("question_id", "answer", F.col("debug.reason").alias("reason"),
                                         F.col("debug.best_distance").alias("best_distance"))


# --- the whole question path ---


@query("orc1_answers")
def _(spark, sf):
    rows = answer_from(co.questions(spark, sf), collection(spark, sf), pack=co.SAMPLE, settings=SETTINGS,
                       embedder=EMBEDDER, manifest_stamp=co.LATER)
    return _responses(rows)


@query("orc2_refusals")
def _(spark, sf):
    return _responses(gn.refuse(screen(co.questions(spark, sf)).filter(~F.col("allowed"))))


@query("orc3_empty_corpus")
def _(spark, sf):
    return _responses(gn.empty_corpus(screen(co.questions(spark, sf)).filter("allowed")))


# --- reports ---


@query("agg1_drop_reasons")
def _(spark, sf):
    both = [ch.candidate_reasons(sc.to_sections(d, FUNDS), FUNDS) for d in (co.card_documents(spark, sf), co.text_documents(spark, sf))]
    return dg.drops_by_reason(both[0].unionByName(both[1]))


@query("agg2_word_counts")
def _(spark, sf):
    return dg.word_count_summary(ch.kept_chunks(chunked(co.text_documents(spark, sf))))


@query("agg3_page_counts")
def _(spark, sf):
    return ch.page_counts(chunked(co.card_documents(spark, sf)))


@query("agg4_corpus_summary")
def _(spark, sf):
    counts = stage(staged_counts(chunked(co.text_documents(spark, sf))), "counts")
    return rp.entries(rp.corpus_summary(counts), counts)


@query("agg5_text_statistics")
def _(spark, sf):
    docs = co.documents(spark, sf)
    return dg.text_statistics(docs, "doc_id", "text").drop("longest_short_run")


@query("agg6_redundancy")
def _(spark, sf):
    return dg.redundancy(co.documents(spark, sf), "doc_id", "text")


@query("agg6_top_repeats")
def _(spark, sf):
    return dg.top_repeats(co.documents(spark, sf), "doc_id", "text").select("doc_id", "rank", "line", "n")


@query("agg7_short_runs")
def _(spark, sf):
    docs = co.documents(spark, sf)
    return dg.text_statistics(docs, "doc_id", "text").select("doc_id", "longest_short_run")


@query("agg8_heading_tags")
def _(spark, sf):
    both = co.web_pages(spark, sf).select("url", "html").unionByName(co.card_pages(spark, sf).select("url", "html"))
    return dg.heading_tags(both, "url", "html").withColumn("samples", F.array_join("samples", "|"))


@query("agg9_totals")
def _(spark, sf):
    return dg.corpus_totals(co.web_documents(spark, sf))


@query("agg10_retrieval_report")
def _(spark, sf):
    return dg.retrieval_report(retrieved(spark, sf), co.SAMPLE)


@query("agg11_confusion")
def _(spark, sf):
    expected = F.when(F.col("question").rlike(r"\+91|@|\d{16}"), F.lit("pii")).otherwise(F.lit("other"))
    return dg.confusion(gr.classify(co.questions(spark, sf).withColumn("expected", expected), "question"))


@query("agg12_contract")
def _(spark, sf):
    rows = answer_from(co.questions(spark, sf), collection(spark, sf), pack=co.SAMPLE, settings=SETTINGS,
                       embedder=EMBEDDER, manifest_stamp=co.LATER)
    return dg.contract_report(rows, co.SAMPLE)


# --- the same in SQL ---


def _in_sql(spark, text: str, **tables: DataFrame) -> DataFrame:
    register(spark)
    return spark.sql(text, **tables)


@query("grd8_sql")
def _(spark, sf):
    return _in_sql(spark, "SELECT key, array_join(lf_pii_types(text), '|') AS pii_types FROM {texts}", texts=co.screened_texts(spark, sf))


@query("grd9_sql")
def _(spark, sf):
    return _in_sql(spark, "SELECT key, md5(lf_scrub_pii(text)) AS digest FROM {texts}", texts=co.screened_texts(spark, sf))


@query("gen1_sql")
def _(spark, sf):
    return _in_sql(spark, "SELECT question_id, lf_strip_urls(completion) AS clean FROM {rows}", rows=co.completions(spark, sf))


@query("vec2_sql")
def _(spark, sf):
    return _in_sql(spark, """
        SELECT doc_id, lf_has_phrase(text, 'of the') AS of_the,
               lf_has_phrase(text, 'ter') OR lf_has_phrase(text, 'nav') OR lf_has_phrase(text, 'que') AS short_words,
               lf_has_phrase(text, 'de la') OR lf_has_phrase(text, 'est') OR lf_has_phrase(text, 'ention') AS mixed
        FROM {docs}""", docs=co.documents(spark, sf))


@query("htm1_sql")
def _(spark, sf):
    return _in_sql(spark, "SELECT page_no, line_no, line FROM lf_page_lines(TABLE(SELECT page_no, html FROM {pages}) PARTITION BY page_no)",
                   pages=co.table(spark, sf, "pages").select(F.col("page_id").cast("bigint").alias("page_no"), "html"))
