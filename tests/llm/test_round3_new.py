"""Chat formatting, divergence audit and ranked lexical search against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lanternfold.llm import ball_tree, chat, divergence
from lanternfold.llm.perfect_hash import PerfectHash, padded

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
ODD_ROLES = ["user", "assistant", "system", "tool", None, "[INST]", "a\nb", "<~|role|>"]
CONTROLS = chat.Template().markers() + ["<|endoftext|>"]


@pytest.fixture(scope="module")
def renderer():
    return chat._Encoder(TOKENIZER, chat.Template()).renderer


PIECES = st.lists(st.sampled_from([*CONTROLS, "~", "<", "[", "s>", "/s>", "|", "x", " ", "é", "<~s>", "[~~/INST]"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_escapes_are_reversible_and_hide_control_strings(renderer, text):
    escaped = renderer.escape(text)
    assert renderer.unescape(escaped) == text
    assert not any(c in escaped for c in CONTROLS)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=4))
def test_turns_are_read_back(renderer, turns):
    rendered = "".join(renderer.render(r, t)[0] for r, t in turns)
    assert renderer.parse(rendered) == turns


def test_overlapping_control_strings_are_refused():
    for pair in (("<a<", "<b"), ("<a>", "<a>b"), ("~x", "<y"), ("<", "<y")):
        with pytest.raises(ValueError):
            chat.Renderer(chat.Template({"assistant": pair}), [])


def test_overlap_of_spans():
    tokens = np.array([[0, 3], [3, 4], [3, 4], [4, 9], [9, 9], [9, 12]])
    turns = np.array([[2, 4], [8, 9], [12, 15]])
    found = chat.overlaps(tokens[:, 0], tokens[:, 1], turns[:, 0], turns[:, 1])
    assert found.tolist() == [True, True, True, True, False, False]
    assert not chat.overlaps(tokens[:, 0], tokens[:, 1], turns[:0, 0], turns[:0, 1]).any()


def _chat_rows():
    long = "wörd </s> 日本 " * 4000
    return [(1, 1, "assistant", " a  "), (1, 0, "user", "q"), (1, 2, "assistant", "<s>[~INST]"), (2, 0, "tool", None), (2, 1, "assistant", ""),
            (3, 5, "assistant", long), (3, None, "user", long), (3, 5, "assistant", long), (None, 0, "user", "x"), (None, 1, None, "y"),
            (4, 0, "[INST]", "🙂"), (4, 0, "assistant", "🙂"), (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


@pytest.mark.parametrize("segment", [chat.SEGMENT, 20])
def test_chat_digest_equals_the_rows(spark, segment):
    rows = _chat_rows()
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, segment int, `a.b` int")
    formatted = chat.format_conversations(frame, TOKENIZER, segment=segment)
    found = {r.conv_id: r for r in chat.digest(formatted, TOKENIZER).collect()}
    assert set(found) == {r[0] for r in rows}
    for conv in found:
        turns = sorted(((t is not None, t or 0), r or "", x or "") for c, t, r, x in rows if c == conv)
        trained = "".join(x for _, r, x in turns if r == "assistant")
        assert found[conv].n_turns == len(turns)
        assert found[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert found[conv].loss_chars == len(trained)
        assert found[conv].loss_sha256 == hashlib.sha256(trained.encode()).hexdigest()


def test_segments_have_the_ids_of_the_whole(spark):
    frame = spark.createDataFrame(_chat_rows(), "conv_id long, turn long, role string, text string")
    whole, cut = ({} for _ in range(2))
    for out, segment in ((whole, chat.SEGMENT), (cut, 20)):
        for r in sorted(chat.format_conversations(frame, TOKENIZER, segment=segment).collect(), key=lambda r: r.segment):
            ids, loss, text = out.get(r.conv_id, ([], [], ""))
            out[r.conv_id] = (ids + r.ids, loss + r.loss, text + r.text)
    assert whole == cut
    assert all(len(i) == len(x) for i, x, _ in whole.values())


def test_chat_without_rows(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.format_conversations(frame, TOKENIZER), TOKENIZER).collect() == []


def test_tokenizers_that_drop_characters_are_refused():
    with pytest.raises(ValueError, match="drops"):
        chat._Encoder(public_tokenizers.path("word_bpe_49k.json"), chat.Template()).encode(["a  b"])


# perfect hash


@settings(max_examples=100, deadline=None)
@given(st.sets(st.binary(max_size=30), max_size=200), st.lists(st.binary(max_size=30), max_size=50))
def test_perfect_hash_finds_its_keys_and_no_others(keys, others):
    table = PerfectHash.from_bytes(PerfectHash(list(keys)).to_bytes())
    asked = [*keys, *others, *(k + b"\0" for k in keys)]
    lengths = np.array([len(k) for k in asked], np.int64)
    starts = np.cumsum(np.concatenate([[0], lengths])).astype(np.int64)[:-1]
    place = {k: i for i, k in enumerate(sorted(keys))}
    assert table.find(padded(b"".join(asked)), starts, lengths).tolist() == [place.get(k, -1) for k in asked]
    assert [table.key(i) for i in range(table.n)] == sorted(keys)


def test_keys_of_equal_hash_take_another_seed(monkeypatch):
    from lanternfold.llm import perfect_hash

    true = perfect_hash.hashes
    monkeypatch.setattr(perfect_hash, "hashes", lambda b, s, n, seed=0: true(b, s, n, seed) if seed else np.zeros(len(s), np.uint64))
    table = PerfectHash([b"a", b"b", b"c"])
    assert table.seed == 1 and table.find(padded(b"abcd"), np.arange(4), np.ones(4, np.int64)).tolist() == [0, 1, 2, -1]


# divergence


def _audit(docs, top=200):
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
             for text, lang, source in docs]
    df = Counter((lang, t) for lang, _, found in terms for t in set(found))
    kept = defaultdict(set)
    for (lang, t), n in df.items():
        if n >= 3:
            kept[lang].add(t)
    counts, whole = defaultdict(Counter), defaultdict(Counter)
    for lang, source, found in terms:
        counts[lang, source].update(t for t in found if t in kept[lang])
        whole[lang].update(t for t in found if t in kept[lang])

    def p(counter, lang):
        n, v = sum(counter.values()), len(kept[lang])
        return {t: 1 + 1_000_000_000 * (counter[t] + 1) // (n + v) for t in kept[lang]}

    out = []
    for (lang, source), counter in counts.items():
        mine, q = p(counter, lang), p(whole[lang], lang)
        pairs = []
        for (other_lang, other), theirs in counts.items():
            if other_lang == lang and other != source:
                o = p(theirs, lang)
                pairs.append((-sum((mine[t] - o[t]) ** 2 // o[t] for t in mine), other))
        terms_of = [(-((mine[t] - q[t]) ** 2 // q[t]), t) for t in mine if counter[t] > 0 and mine[t] > q[t]]
        for part, rows in (("pair", pairs), ("term", terms_of)):
            rows = sorted(rows, key=lambda r: (r[0], r[1].encode()))
            out += [(lang, source, part, item, -v, i) for i, (v, item) in enumerate(rows if part == "pair" else rows[:top], 1)]
    return sorted(out)


def _documents():
    rng = np.random.default_rng(5)
    words = ["The", "a", "é", "日本", "naïve", "x" * 40, "y" * 24, "y" * 16, "Über", "zz"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    docs = []
    for i in range(120):
        n = int(rng.integers(0, 40))
        text = " ".join(words[int(k)] for k in rng.zipf(1.4, n) % len(words))
        docs.append((text, ["en", "fr", None][i % 3 if i % 7 else 0], f"s{int(rng.integers(0, 9))}"))
    return docs + [(None, "en", "lonely"), ("only here", "xx", "a"), ("", "xx", None), ("one, two;THREE_four", "en", "s1"), ("w" * 3000 + " zz", "en", "s2")]


@pytest.mark.parametrize("sent, block", [(1 << 20, 128), (400, 3), (0, 2)])
def test_audit_equals_brute_force(spark, sent, block):
    docs = _documents()
    frame = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], "text string, lang string, source string, shard int, term int, `a.b` int")
    found = divergence.audit(frame, sent=sent, block=block, top=7)
    assert sorted(tuple(r) for r in found.select("lang", "source", "part", "item", "value", "rank").collect()) == _audit(docs, 7)


def test_audit_in_small_portions(spark, monkeypatch):
    for name, value in (("AT_ONCE", 50), ("DENSE", 100), ("KEPT_ROWS", 5), ("PER_SHARD", 4)):
        monkeypatch.setattr(divergence, name, value)
    docs = _documents()
    frame = spark.createDataFrame(docs, "text string, lang string, source string").repartition(3)
    found = divergence.audit(frame, sent=300)
    assert sorted(tuple(r) for r in found.select("lang", "source", "part", "item", "value", "rank").collect()) == _audit(docs)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).collect() == []
    one = divergence.audit(spark.createDataFrame([("a", "en", "s")], "text string, lang string, source string"))
    assert one.collect() == []


def test_shares_are_exact_for_large_counts():
    counts = np.array([0, 1, 10**13, 3 * 10**15, 7 * 10**15], np.int64)
    total, kept = int(counts.sum()), 5
    total = min(total, 9 * 10**15 - kept)
    assert divergence.shares(counts, total, kept).tolist() == [1 + 10**9 * (int(c) + 1) // (total + kept) for c in counts]


# ranked lexical search


def _ranked(docs, items, k=10):
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    found = [(d, Counter(terms(t))) for d, t in docs]
    found = [(d, c, sum(c.values())) for d, c in found if c]
    n, total = len(found), sum(x for *_, x in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, length in found:
            m = 100 - 75 + (75 * length * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in terms(text) if c[t])
            if score > 0:
                scores.append((-score, d is None, d))
        out += [(item, i, d, -s) for i, (s, _, d) in enumerate(sorted(scores, key=lambda r: r[:2] + (r[2] or 0,))[:k], 1)]
    return sorted(out, key=str)


def _search_tables():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)] + ["É", "日本", "x1y2", "THE"]
    docs = [(i, " ".join(words[int(w)] for w in rng.zipf(1.3, int(rng.integers(1, 30))) % len(words))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(30)] + [(7, docs[7][1]), (None, docs[7][1]), (2000, None), (2001, ""), (2002, "!?"), (2003, "w1 " * 5000)]
    items = [(i, docs[i * 11][1]) for i in range(20)] + [(3, "w1 W1 w1 the"), (50, "unknown"), (51, None), (None, "É 日本"), (52, docs[7][1])]
    return docs, items


@pytest.mark.parametrize("leaf, cells, item_bytes", [(4, 1 << 22, 1 << 20), (1, 3000, 200), (8, 1, 1)])
def test_search_equals_brute_force(spark, monkeypatch, leaf, cells, item_bytes):
    monkeypatch.setattr(ball_tree, "ITEM_BYTES", item_bytes)
    monkeypatch.setattr(ball_tree, "PARTS", 16)
    docs, items = _search_tables()
    items = items if item_bytes > 1000 else items[18:]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, n int, `a.b` int").repartition(3)
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, score int")
    found = ball_tree.search(frame, asked, leaf=leaf, cells=cells).collect()
    assert sorted((tuple(r) for r in found), key=str) == _ranked(docs, items)


def test_search_without_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ball_tree.search(docs, items).collect() == []
    assert ball_tree.search(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).collect() == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    rows = np.where(rng.random((500, 200)) < 0.1, rng.integers(1, 10**6, (500, 200)), 0)
    queries = np.where(rng.random((20, 200)) < 0.05, rng.integers(1, 10**4, (20, 200)), 0)
    tree = ball_tree.BallTree(rows, np.arange(500))
    bounds = tree.bounds(queries)
    for node, inside in enumerate(tree.members):
        assert (bounds[:, node] >= (rows[inside] @ queries.T).max(axis=0)).all()
    for i, q in enumerate(queries):
        best: list = []
        at = np.flatnonzero(q)
        opened = tree.search(at, q[at], bounds[i].tolist(), best, 3)
        scores = rows @ q
        assert sorted(best, reverse=True) == sorted(((int(s), -j) for j, s in enumerate(scores) if s), reverse=True)[:3]
        assert opened < 500
