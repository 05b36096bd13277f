import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lanternfold.llm import packing, token_counts
from lanternfold.llm.common import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["don't I'll'd 's", "a\x85b c\xa0d", "½x²3 µm ªº ÀÉ ÷×", "x<|endoftext|>y <|ENDOFTEXT|>", "œuvre “q”", "a\tb\r\nc\x1cd\x1fe",
       "", " ", "日本語 text", "İstanbul Σας", "!!a??b__c", "é", "x" * 3000, "'S'T'RE 'VE", "é e ́"]


@pytest.fixture(scope="module")
def encoders():
    return WordEncoder(PATH), Tokenizer.from_file(PATH)


def _whole(tokenizer, texts):
    return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def test_encoder_gives_the_tokenizers_ids(encoders):
    own, tokenizer = encoders
    assert own.by_run
    assert own.encode(ODD * 2) == _whole(tokenizer, ODD * 2)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
def test_encoder_on_any_text(encoders, texts):
    own, tokenizer = encoders
    assert own.encode(texts) == _whole(tokenizer, texts)


def test_encoder_forgets_and_goes_on(encoders):
    own = WordEncoder(PATH)
    own.KEEP = 3
    texts = ["one two three four five"] * 600
    assert own.encode(texts) == _whole(encoders[1], texts)


def test_other_tokenizers_are_used_whole():
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert WordEncoder(path).encode(ODD) == _whole(Tokenizer.from_file(path), ODD)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9, 15, 16, 17, 100])
def test_lengths_are_the_binary_digits(n):
    pieces = packing.lengths_of(n, 8)
    assert sum(pieces) == n and pieces == sorted(pieces, reverse=True)
    assert all(p & (p - 1) == 0 and p <= 8 for p in pieces)
    assert len({p for p in pieces if p < 8}) == len([p for p in pieces if p < 8])


def test_pieces_cover_every_document_once(spark):
    random.seed(3)
    texts = [None, "", "one", "one", *[" ".join(random.choice(["ab", "cd", "ef,"]) for _ in range(n)) for n in (5, 64, 200, 900)]]
    docs = spark.createDataFrame([(i if i != 5 else None, t, 1, "x") for i, t in enumerate(texts)],
                                 "doc_id long, text string, length int, bucket string").repartition(3)
    rows = packing.pack(docs, PATH, longest=64).collect()
    tokenizer = Tokenizer.from_file(PATH)
    for i, text in enumerate(texts):
        whole = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        mine = sorted((r for r in rows if r.doc_id == (i if i != 5 else None)), key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in mine) == whole
        assert [r.start for r in mine] == [0, *np.cumsum([r.length for r in mine])[:-1]]
        assert all(r.doc_tokens == len(whole) // 4 and r.length == 1 << r.bucket and r.offset == 0 for r in mine)
    by_number = sorted(rows, key=lambda r: r.sequence_id)
    assert [r.sequence_id for r in by_number] == list(range(len(rows)))
    assert [r.bucket for r in by_number] == sorted((r.bucket for r in rows), reverse=True)
    sums = {(r.doc_id, r.start): r.ids_crc32 for r in packing.digest(docs, PATH, longest=64).collect()}
    assert sums == {(r.doc_id, r.start): zlib.crc32(bytes(r.ids)) for r in rows}


def test_packing_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none, PATH).count() == 0
    with pytest.raises(ValueError):
        packing.cut(none, PATH, longest=100)


def test_histogram_answers_every_limit(spark):
    random.seed(4)
    rows = [(random.choice(["a", "b", None]), " ".join(["word"] * random.choice([0, 1, 3, 3, 40, 1500]))) for _ in range(60)] + [("a", None)]
    docs = spark.createDataFrame(rows, "source string, text string")
    counted = token_counts.histogram(docs, PATH)
    sums = token_counts.with_sums(counted).collect()
    tokenizer = Tokenizer.from_file(PATH)
    lengths = {s: sorted(len(tokenizer.encode(t or "", add_special_tokens=False).ids) for x, t in rows if x == s) for s in ("a", "b", None)}
    assert len(sums) == sum(len(set(v)) for v in lengths.values())
    for r in sums:
        mine = lengths[r.source]
        assert r.n_docs == mine.count(r.length) and r.docs_le == sum(n <= r.length for n in mine)
        assert r.tokens_le == sum(n for n in mine if n <= r.length) and r.docs_gt == len(mine) - r.docs_le
        assert r.truncated_tokens == sum(min(n, r.length) for n in mine)
    for limit in (0, 2, 77, 10**6):
        found = counted.agg(token_counts.truncated_total(counted, limit)).first()[0]
        assert found == sum(min(n, limit) for v in lengths.values() for n in v)
    for q in (0.1, 0.5, 0.9):
        for r in token_counts.quantile(token_counts.with_sums(counted), q).collect():
            mine = lengths[r.source]
            assert r.length == min(n for n in mine if sum(m <= n for m in mine) >= q * len(mine))
    none = spark.createDataFrame([], "source string, text string")
    assert token_counts.with_sums(token_counts.histogram(none, PATH)).count() == 0
