import hashlib
import random
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lanternfold.functions import kernel
from lanternfold.functions.kernel import QuestionBlock, block_top_k
from lanternfold.operators import embed as em
from lanternfold.operators import rerank as rr
from lanternfold.operators import search as se
from lanternfold.rules import FUNDS
from lanternfold.settings import Settings


def rows(n, dim, seed, copies=0):
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(n, dim))
    if copies:
        vectors[:copies] = vectors[0]  # a third of the rows are one and the same
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    return [[float(x) for x in v] for v in vectors.astype(np.float32)]


def brute(qs, cs, k):
    out = {}
    for qi, q in enumerate(qs):
        scored = sorted((round(1 - float(np.dot(q, c) / (np.linalg.norm(q) * np.linalg.norm(c))), 9), f"c{ci:05d}")
                        for ci, c in enumerate(cs))
        out[qi] = [i for _, i in scored[:k]]
    return out


@pytest.mark.parametrize("settings", [Settings(), Settings(cell_questions=7, cell_chunks=60)])
def test_top_k_is_exact_whatever_the_grid_with_copies(spark, settings):
    qs, cs = rows(20, 16, 1), rows(300, 16, 2, copies=100)
    q = spark.createDataFrame(list(enumerate(qs)), "question_id bigint, embedding array<float>")
    c = spark.createDataFrame([(f"c{i:05d}", v) for i, v in enumerate(cs)], "id string, embedding array<float>").repartition(3)
    got = {}
    for r in sorted(se.top_k(q, c, 5, settings).collect(), key=lambda r: (r.question_id, r.rank)):
        got.setdefault(r.question_id, []).append(r.id)
    assert got == brute(np.array(qs), np.array(cs), 5)


def test_heavy_cells_of_few_bytes_are_tasks_of_their_own(spark):
    vector = F.array(*[F.randn(seed).cast("float") for seed in range(4)]).alias("embedding")
    q = spark.range(32_768).select(F.col("id").alias("question_id"), vector)
    c = spark.range(8_192).select(F.format_string("c%05d", "id").alias("id"), vector)
    found = se.run_search(q, c, 2, Settings()).found  # six cells
    by_task = found.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in by_task) == 2 * 32_768
    assert len(by_task) >= 4


def clusters(n, dim, seed, groups=12):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, dim))
    vectors = middle[rng.integers(0, groups, n)] + 0.05 * rng.normal(size=(n, dim))
    vectors[:5] = 0  # texts without words
    return vectors.astype(np.float32)


@pytest.mark.parametrize("cell", [10, 40, 10_000])
def test_pruned_search_equals_the_exhaustive_one_and_opens_few_balls(spark, cell):
    qs, cs = clusters(60, 24, 3), np.concatenate([clusters(800, 24, 3), np.repeat(clusters(1, 24, 3) + 1, 300, axis=0)]).astype(np.float32)
    rng = np.random.default_rng(1)
    schemes = ["en", "fr", "none"]
    hits = rng.choice([0, 0, 0, 1, 2, 3], (len(cs), 3))
    of = rng.integers(0, 3, len(cs))
    asked = [(i, v.tolist(), [s for s in schemes[:2] if rng.random() < 0.3], [t for t in range(3) if rng.random() < 0.3]) for i, v in enumerate(qs)]
    stored = [(f"c{i:05d}", v.tolist(), schemes[of[i]], hits[i].tolist()) for i, v in enumerate(cs)]
    q = spark.createDataFrame(asked, "question_id bigint, embedding array<float>, schemes array<string>, topics array<int>")
    c = spark.createDataFrame(stored, "id string, embedding array<float>, scheme string, topic_hits array<tinyint>").repartition(3)
    boost = {0: 0.0, 1: 0.30, 2: 0.55, 3: 0.12}
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    near = np.round(1 - unit(qs.astype(float)) @ unit(cs.astype(float)).T, 9)
    want = {}
    for i, _, wanted, raised in asked:
        rows = []
        for j in range(len(cs)):
            first = next((hits[j][t] for t in raised if hits[j][t]), 0)
            rows.append((round(near[i, j] - (0.35 if schemes[of[j]] in wanted else 0) - boost[first], 9), near[i, j], f"c{j:05d}"))
        want[i] = [r[2] for r in sorted(rows)[:5]]
    search = se.run_search(q, c, 5, Settings(cell_chunks=cell, cell_questions=16))
    got = {}
    for r in sorted(se._best(search.found, 5).collect(), key=lambda r: (r.question_id, r.rank)):
        got.setdefault(r.question_id, []).append(r.id)
    assert got == want
    seen = se.opened(search).agg(F.sum("opened"), F.sum("balls")).first()
    assert seen[0] <= {10: 0.5, 40: 0.9, 10_000: 1}[cell] * seen[1]


def test_tasks_of_a_search_are_those_of_a_shuffle(spark):
    qs, cs = clusters(200, 8, 1), clusters(2000, 8, 2)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(qs)], "question_id bigint, embedding array<float>")
    c = spark.createDataFrame([(f"c{i:05d}", v.tolist()) for i, v in enumerate(cs)], "id string, embedding array<float>")
    found = se.run_search(q, c, 3, Settings(cell_chunks=20, cell_questions=10)).found
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" not in plan


def test_a_question_goes_to_few_cells_however_small_the_balls_are(spark):
    qs, cs = clusters(150, 8, 1), np.concatenate([clusters(1500, 8, 2), np.repeat(clusters(6, 8, 2)[5:], 1500, axis=0)])
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(qs)], "question_id bigint, embedding array<float>")
    c = spark.createDataFrame([(f"c{i:05d}", v.tolist()) for i, v in enumerate(cs)], "id string, embedding array<float>").repartition(3)
    search = se.run_search(q, c, 3, Settings(cell_chunks=8, task_chunks=1000))
    assert len(search.balls.rows) > 300
    # A cell gives at most three rows a question: 3,000 rows in parts of 1,000 and one ball with half of them.
    assert search.found.groupBy("question_id").count().agg(F.max("count")).first()[0] <= 3 * 6
    got = {}
    for r in sorted(se._best(search.found, 3).collect(), key=lambda r: (r.question_id, r.rank)):
        got.setdefault(r.question_id, []).append(r.id)
    alone = {}
    for r in sorted(se.top_k(q, c, 3, Settings()).collect(), key=lambda r: (r.question_id, r.rank)):
        alone.setdefault(r.question_id, []).append(r.id)
    assert got == alone


@pytest.mark.parametrize("kind", ["float32", "float64"])
def test_a_block_is_scored_as_in_double_precision(kind):
    rng = np.random.default_rng(5)
    cs = rng.normal(size=(5000, 16)).astype(kind)
    cs[1000:3000] = cs[7]  # copies
    cs[3000:3100] = cs[3100:3200] * (1 + 1e-6 * rng.normal(size=(100, 16))).astype(kind)  # close to each other
    cs[-3:] = 0
    qs = np.concatenate([cs[[7, 3150, 4999]], rng.normal(size=(40, 16)).astype(kind)])
    ids = rng.permutation(5000)
    schemes, topics, hits = rng.integers(0, 3, 5000), [[0, 1], [1], []] * 15, rng.choice([0, 0, 0, 1, 2, 3], (5000, 2))
    schemes[1000:3000], hits[1000:3000] = 1, 0
    chunks = pa.table({"id": [f"c{i:05d}" for i in ids], "embedding": pa.array(cs.tolist(), pa.list_(pa.from_numpy_dtype(kind))),
                       "scheme": [("a", "b", None)[s] for s in schemes], "topic_hits": pa.array(hits.tolist(), pa.list_(pa.int8()))})
    unit = lambda m: m / np.maximum(np.linalg.norm(m.astype(float), axis=1, keepdims=True), 1e-300)
    distance = np.round(1 - unit(qs) @ unit(cs).T, 9)
    boost = np.array([0, 0.30, 0.55, 0.12])
    score = np.empty_like(distance)
    for i in range(len(qs)):
        first = np.zeros(5000, int)
        for t in topics[i]:
            first = np.where(first == 0, hits[:, t], first)
        score[i] = np.round(distance[i] - boost[first] - 0.35 * (schemes == 0), 9)
    for worst in (np.inf, 0.4):
        block = QuestionBlock(np.arange(len(qs)), qs, [("a", "x")] * len(qs), [tuple(t) for t in topics[:len(qs)]], np.full(len(qs), worst))
        found = {}
        for r in block_top_k(block, chunks, 6)[0].to_pylist():
            found.setdefault(r["question_id"], []).append((r["score"], r["distance"], r["id"]))
        for i in range(len(qs)):
            want = sorted((s, d, f"c{j:05d}") for s, d, j in zip(score[i], distance[i], ids) if s <= worst)[:6]
            got = sorted(found.get(i, []))
            assert [x[2] for x in got] == [x[2] for x in want]
            assert np.allclose([x[:2] for x in got], [x[:2] for x in want], atol=2e-9)


def test_a_block_multiplies_only_kinds_whose_boost_may_suffice(monkeypatch):
    """F4-F11, F13: a third of the rows is boosted for a third of the questions; the others need not be multiplied."""
    rng = np.random.default_rng(8)
    middle = rng.normal(size=16)
    cs, qs = (middle + 0.3 * rng.normal(size=(n, 16)) for n in (6000, 90))
    chunks = pa.table({"id": [f"c{i:05d}" for i in range(6000)], "embedding": pa.array(cs.astype("float32").tolist(), pa.list_(pa.float32())),
                       "scheme": [("a", "b", None)[i % 3] for i in range(6000)], "topic_hits": pa.array([[i % 2 * 2, 0] for i in range(6000)], pa.list_(pa.int8()))})
    block = QuestionBlock(np.arange(90), qs.astype("float32"), [(("a",), ("b",), ("a", "b"))[i % 3] for i in range(90)], [(0,), (0, 1)] * 45, np.full(90, np.inf))
    pairs, similar = [], kernel._similar
    monkeypatch.setattr(kernel, "_similar", lambda v, r: pairs.append(len(v) * len(r)) or similar(v, r))
    found = {}
    for r in block_top_k(block, chunks, 4)[0].to_pylist():
        found.setdefault(r["question_id"], []).append((r["score"], r["distance"], r["id"]))
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    distance = np.round(1 - unit(qs.astype("float32").astype(float)) @ unit(cs.astype("float32").astype(float)).T, 9)
    boost = 0.55 * (np.arange(6000) % 2) + 0.35 * np.array([[("a", "b", None)[i % 3] in s for i in range(6000)] for s in block.schemes])
    for i, score in enumerate(np.round(distance - boost, 9)):
        best = sorted(zip(score, distance[i], chunks.column("id").to_pylist()))[:4]
        assert [x[2] for x in sorted(found[i])] == [x[2] for x in best]
    assert sum(pairs) <= 0.4 * 90 * 6000


def test_kinds_of_rows_are_told_apart_exactly_however_many_topics_there_are():
    rng = np.random.default_rng(3)
    hits = rng.integers(0, 4, (400, 70)).astype(np.int8)
    hits[200:] = hits[:200]
    hits[399, 69] = (hits[399, 69] + 1) % 4
    scheme = [None if i % 200 == 7 else str(i % 200 % 3) for i in range(400)]
    schemes, of, kind = kernel._kinds(pa.table({"scheme": pa.array(scheme, pa.string()), "topic_hits": pa.array(hits.tolist(), pa.list_(pa.int8()))}))
    assert len(schemes) == 201 and [schemes[i] for i in kind] == scheme and (of[kind] == hits).all()


def test_copies_sent_to_the_cells_of_a_large_search():
    """what is shuffled is the questions times the parts of the rows, and the reverse."""
    questions, held = 430_000, 2_000_000
    grid = se.Grid.of(questions, held, Settings())
    assert -(-held // grid.rows) <= 16 and -(-questions // grid.questions) <= 6


TEXTS = {
    "ter": ("How to start", "How to start\nThe Total Expense Ration: 0.77%", "hdfc-flexi-cap"),
    "term": ("Terms", "Terms\nlong term alternative navigate later", "hdfc-flexi-cap"),
    "exit": ("Exit Load", "Exit Load\nNIL", "hdfc-elss-tax-saver"),
    "aum": ("Card", "Card\nAUM: ₹1 and the exit load too", "hdfc-fund-hub"),
    "dl": ("Downloads", "Downloads\nfactsheet", "hdfc-fund-hub"),
}


def test_boosts_and_notes(spark):
    chunks = spark.createDataFrame([(k, *v) for k, v in TEXTS.items()], "id string, heading string, text string, scheme string")
    hits = {r.id: list(r[rr.feature_column(FUNDS)]) for r in rr.with_chunk_features(chunks, FUNDS).collect()}
    topic = FUNDS.topics.index
    assert hits["ter"][topic("ter")] == rr.FACT_HIT
    assert hits["term"] == [0] * len(FUNDS.topics)
    assert hits["exit"][topic("exit load")] == rr.HEADING_HIT  # the body states it too; the heading hides that
    assert hits["aum"][topic("exit load")] == rr.FACT_HIT and hits["aum"][topic("aum")] == rr.FACT_HIT
    assert hits["dl"][topic("downloads")] == rr.HEADING_HIT
    qs = spark.createDataFrame([
        (1, "What is the expense ratio of HDFC Flexi Cap Fund?"), (2, "exit load and AUM of ELSS"), (3, "how to navigate")],
        "question_id int, question string")
    got = {r.question_id: r for r in rr.with_question_features(qs, "question", FUNDS).collect()}
    assert [FUNDS.topics[t] for t in got[1].topics] == ["ter"] and got[1].schemes == ["hdfc-flexi-cap"]
    assert [FUNDS.topics[t] for t in got[2].topics] == ["exit load", "aum"]
    assert got[3].topics == [] and got[3].schemes == []


def test_boost_report_with_more_cells_than_features(spark):
    chunks = spark.createDataFrame([(k, *v) for k, v in TEXTS.items()], "id string, heading string, text string, scheme string")
    qs = spark.createDataFrame([(1, "What is the expense ratio of HDFC Flexi Cap Fund?"), (2, " ")], "question_id bigint, question string")
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "50")
        assert se.boost_report(qs.limit(0), chunks).count() == 0 and se.boost_report(qs, chunks.limit(0)).count() == 0
        got = {r.rank_note: (r.n, r.boost) for r in se.boost_report(qs, chunks).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert got == {"scheme+fact:ter": (1, 0.9), "scheme": (1, 0.35), "": (3, 0.0)}


def test_rerank_promotes_and_never_filters(spark):
    embedder = em.HashingEmbedder(64)
    chunks = spark.createDataFrame(
        [(k, *v, "https://x/" + k, "T", "2026-01-01", 0) for k, v in TEXTS.items()],
        "id string, heading string, text string, scheme string, url string, title string, fetched_at string, chunk_index int")
    stored = em.embed(chunks, "text", embedder)
    qs = spark.createDataFrame([(1, "What is the expense ratio of HDFC Flexi Cap Fund?"), (2, "  ")],
                               "question_id bigint, question string")
    out = se.retrieve(em.embed(qs, "question", embedder), stored, 5).orderBy("question_id", "rank").collect()
    assert {r.question_id for r in out} == {1} and len(out) == 5
    assert out[0].id == "ter" and out[0].rank_note == "scheme+fact:ter"
    assert out[0].distance - out[0].score == pytest.approx(0.9)
    default = se.retrieve(em.embed(qs, "question", embedder), stored, 0)
    assert default.count() == 4


def test_pool_and_embedder_contract(spark):
    hidden = np.array([[[1.0, 0], [3, 0], [9, 9]], [[0, 0], [0, 0], [0, 0]]])
    pooled = em.mean_pool(hidden, np.array([[1, 1, 0], [0, 0, 0]]))
    assert pooled.tolist() == [[2, 0], [0, 0]]
    assert em.unit_rows(pooled).tolist() == [[1, 0], [0, 0]]
    texts = ["alpha beta", "beta alpha", "", None, "word " * 5000, "gamma"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.embedding for r in em.embed(df, "t", em.HashingEmbedder(32)).collect()}
    norms = {i: sum(x * x for x in v) for i, v in got.items()}
    assert all(len(v) == 32 for v in got.values())
    assert norms[0] == pytest.approx(1, abs=1e-3) and norms[2] == norms[3] == 0
    assert got[0] == got[1] != got[5]
    with pytest.raises(Exception, match="expected 8 dimensions, got 3"):
        spark.range(1).select(em.checked(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)).cast("array<float>"), 8)).collect()


def test_widths_must_agree(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "question_id bigint, embedding array<float>")
    c = spark.createDataFrame([("a", [1.0, 0.0, 0.0])], "id string, embedding array<float>")
    with pytest.raises(Exception, match="question width 2, chunk width 3"):
        se.top_k(q, c, 1).collect()


def test_embedder_choice(monkeypatch, tmp_path):
    assert em.choose_embedder(Settings(models_dir=str(tmp_path))).name == "feature-hashing"
    for name in ("minilm.onnx", "tokenizer.json"):
        (tmp_path / name).write_text("x")
    assert isinstance(em.choose_embedder(Settings(models_dir=str(tmp_path))), em.OnnxEmbedder)
    monkeypatch.setenv("EMBEDDER_BACKEND", "hashing")
    assert isinstance(em.choose_embedder(Settings(models_dir=str(tmp_path))), em.HashingEmbedder)


def test_phrase_windows_against_brute_force(values):
    import re

    from lanternfold.functions import text as tx

    rng = random.Random(3)
    alphabet = ["ter", "ters", "load", "exit", "nav", "é", "-", "navs", "x"]
    texts = [" ".join(rng.choice(alphabet) for _ in range(rng.randint(0, 8))) for _ in range(300)]

    def window(text, phrase):
        hay, needle = re.findall("[a-z0-9]+", text.lower()), phrase.split()
        return any(hay[i:i + len(needle)][:-1] == needle[:-1] and hay[i + len(needle) - 1] in (needle[-1], needle[-1] + "s")
                   for i in range(len(hay) - len(needle) + 1))

    for phrase in ("ter", "exit load", "nav x"):
        assert values(lambda c: tx.has_phrase(tx.phrase_text(c), (phrase,)), texts) == [window(t, phrase) for t in texts]


def test_features_of_other_rules_are_made_anew(spark):
    """Two packs of equal length: stored features of one are not used for the other."""
    other = replace(FUNDS, topic_phrases={k: ("never said",) for k in FUNDS.topic_phrases}, topic_labels={})
    assert len(other.topics) == len(FUNDS.topics) and other.fingerprint != FUNDS.fingerprint
    embedder = em.HashingEmbedder(64)
    chunks = spark.createDataFrame(
        [(k, *v, "https://x/" + k, "T", "2026-01-01", 0) for k, v in TEXTS.items()],
        "id string, heading string, text string, scheme string, url string, title string, fetched_at string, chunk_index int")
    plain = em.embed(chunks, "text", embedder)
    qs = em.embed(spark.createDataFrame([(1, "What is the expense ratio of HDFC Flexi Cap Fund?")],
                                        "question_id bigint, question string"), "question", embedder)
    want = [tuple(r) for r in se.retrieve(qs, plain, 5).orderBy("rank").collect()]
    assert [tuple(r) for r in se.retrieve(qs, rr.with_chunk_features(plain, other), 5).orderBy("rank").collect()] == want
    assert [tuple(r) for r in se.retrieve(qs, rr.with_chunk_features(plain, FUNDS), 5).orderBy("rank").collect()] == want


def _message(field, payload):
    """One length-delimited protobuf field."""
    out, n = bytearray([field << 3 | 2]), len(payload)
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n]) + payload


def _number(field, n):
    return bytes([field << 3, n])


def _tiny_model(table):
    """A model that looks ids up in a table: hidden = Gather(table, input_ids)."""
    def tensor(name, kind):
        shape = b"".join(_message(1, _message(2, d)) for d in (b"n", b"s"))
        return _message(1, name) + _message(2, _message(1, _number(1, kind) + _message(2, shape)))

    weights = b"".join(_number(1, d) for d in table.shape) + _number(2, 1) + _message(8, b"table") + _message(9, table.tobytes())
    mask = b"".join(_message(1, x) for x in (b"attention_mask",)) + _message(2, b"unused") + _message(4, b"Identity")
    gather = _message(1, b"table") + _message(1, b"input_ids") + _message(2, b"hidden") + _message(4, b"Gather")
    out = _message(1, b"hidden") + _message(2, _message(1, _number(1, 1)))
    graph = (_message(1, gather) + _message(1, mask) + _message(2, b"g") + _message(5, weights) + _message(11, tensor(b"input_ids", 7))
             + _message(11, tensor(b"attention_mask", 7)) + _message(12, out))
    return _number(1, 8) + _message(7, graph) + _message(8, _number(2, 13))


def test_sentence_encoder_end_to_end(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    words = ["[PAD]", "[UNK]", "red", "green", "blue"]
    tokenizer = Tokenizer(models.WordLevel({w: i for i, w in enumerate(words)}, unk_token="[UNK]"))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    tokenizer.save(str(tmp_path / "tokenizer.json"))
    table = np.array([[0, 0, 0], [1, 1, 1], [1, 0, 0], [0, 1, 0], [0, 0, 1]], np.float32)
    (tmp_path / "minilm.onnx").write_bytes(_tiny_model(table))
    embedder = em.OnnxEmbedder(str(tmp_path), dim=3, max_length=4, batch=2)
    texts = ["red", "red green", "blue " * 4 + "red " * 50, None, "", "odd"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.embedding for r in em.embed(df, "t", embedder).collect()}
    assert got[0] == [1, 0, 0] and got[1] == pytest.approx([0.5 ** 0.5, 0.5 ** 0.5, 0], abs=1e-6)
    assert got[2] == [0, 0, 1]  # four tokens count
    assert got[3] == got[4] == [0, 0, 0] and got[5] == pytest.approx([3 ** -0.5] * 3, abs=1e-6)
    short = em.HashingEmbedder(32, max_length=2)
    pair = spark.createDataFrame([(0, "alpha beta gamma"), (1, "alpha beta")], "i int, t string")
    cut = {r.i: r.embedding for r in em.embed(pair, "t", short).collect()}
    assert cut[0] == cut[1]


def test_window_of_word_pieces(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Expense ratio of the fund", "", None, "antidisestablishmentarianism " * 50, "日本 été", "Expense ratio of the fund"]
    embedder = em.PieceEmbedder(path, dim=64, max_length=20)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    whole = [Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids for t in texts]
    got = {r.i: r.w for r in df.select("i", embedder.window(F.col("t")).alias("w")).collect()}
    assert all(got[i].tokens == len(ids) and got[i].ids == ids[:20] for i, ids in enumerate(whole))
    vectors = {r.i: r.embedding for r in em.embed(df, "t", embedder).collect()}
    assert vectors[0] == vectors[5] and sum(x * x for x in vectors[3]) == pytest.approx(1, abs=1e-3)
    assert not any(vectors[1]) and not any(vectors[2])


def test_rows_are_grouped_by_length():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 257, 1000)
    groups = em.length_groups(lengths, 32)
    assert sorted(np.concatenate(groups).tolist()) == list(range(1000)) and max(map(len, groups)) == 32
    as_they_come = [np.arange(i, min(1000, i + 32)) for i in range(0, 1000, 32)]
    assert em.padding_share(lengths, groups) < 0.05 < 0.4 < em.padding_share(lengths, as_they_come)
    assert em.length_groups(np.zeros(0, np.int64), 4) == [] and em.padding_share(np.zeros(0, np.int64), []) == 0


def test_texts_are_encoded_a_bounded_share_at_a_time():
    texts = pd.Series(["a" * 100_000] * 7 + [None, "", "b" * 1_000_000, "c"], dtype=object)
    shares = list(em._shares(texts))
    assert [t for some in shares for t in some] == ["" if t is None else t for t in texts]
    assert all(len(some) == 1 or sum(map(len, some)) <= em.SHARE_CHARS for some in shares)
    assert list(em._shares(texts[:0])) == []


def test_words_are_hashed_once_a_batch(spark, monkeypatch):
    """Vectors are those of ``hash_tokens``; of a batch each distinct word is hashed once."""
    texts = [None, "", "?!", "the The THE", "Ärger İstanbul ß ǅ straße 12３ a_b", "one two " * 300]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    found = rows.select("t", em.hash_tokens(F.col("t"), 16, 256).alias("codes"), em.HashingEmbedder(16, max_length=256).encode(F.col("t")).alias("v"))
    for r in found.collect():
        total = np.zeros(16)
        for code in r.codes or ():
            total[abs(code) - 1] += np.sign(code)
        length = np.sqrt((total * total).sum())
        assert np.allclose(r.v, total / length if length else total, atol=1e-6), r.t
    hashed, md5 = [], hashlib.md5
    monkeypatch.setattr(hashlib, "md5", lambda x: hashed.append(x) or md5(x))
    place, sign = em._cells(pa.array(["a", "b", "a"] * 1000), 16)
    assert len(place) == len(sign) == 3000 and sorted(hashed) == [b"a", b"b"]
