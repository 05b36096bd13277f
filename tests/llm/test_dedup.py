import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternfold.llm import exact_dedup, jaccard, line_dedup
from lanternfold.llm.components import components


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def _copies():
    random.seed(5)
    long = "start " * 200
    texts = [None, "", "A", "a", "Ä", "ä", long, long + "x", long + "y", long.upper()]
    rows = [(i, random.choice(texts)) for i in range(400)]
    rows += [(1000 + i, long + str(i)) for i in range(60)] + [(None, "only without id"), (None, "A"), (7, "twice"), (7, "twice"), (7, "other")]
    return rows


@pytest.mark.parametrize("share", [None, 1500])
def test_exact_duplicates(spark, share):
    rows = _copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit("clash")).repartition(5)
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    found = exact_dedup.duplicates(docs, share).collect()
    assert Counter((r.doc_id, r.text_sha256) for r in found) == Counter((i, hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in found:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
    assert Counter(r.text_sha256 for r in found if r.kept) == Counter(by_sha.keys())


def test_unique_keeps_one_row_with_its_columns(spark):
    rows = _copies()
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    kept = exact_dedup.unique(docs)
    assert kept.columns == docs.columns
    assert sorted(lower(r.text) for r in kept.collect()) == sorted({lower(t) for _, t in rows})


def test_radix_split_is_equality():
    random.seed(6)
    texts = [bytes(random.choice(b"ab") for _ in range(random.choice([0, 1, 3, 30, 300]))) for _ in range(300)] + [b"a" * 300] * 5
    groups = exact_dedup.split_equal(texts)
    assert sorted(i for g in groups for i in g) == list(range(len(texts)))
    assert all(len({texts[i] for i in g}) == 1 for g in groups) and len(groups) == len(set(texts))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.duplicates(none).count() == 0
    assert line_dedup.without_repeats(none).count() == 0
    assert jaccard.near_duplicates(none).count() == 0


def _lines():
    random.seed(7)
    pool = ["a line that repeats across documents", "  A LINE that repeats across documents\t", "short", "x" * 19, "x" * 20, "é" * 20,
            "\x0bonly in one document, again and again", ""]
    rows = [(i, "\n".join(random.choice(pool) if random.random() < 0.7 else f"own line number {i} {j} of this text"
                          for j in range(random.choice([1, 3, 70, 200])))) for i in range(60)]
    return rows + [(100, None), (101, ""), (None, "\n".join(pool)), (3, "\n".join(pool)), (102, "\n" * 130 + pool[0])]


def test_line_dedup(spark):
    rows = _lines()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("keep", F.lit(1)).repartition(3)

    def key(line):
        return lower(line.strip(" \t\n\x0b\x0c\r"))

    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(-1 if i is None else i)
    expected = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == (-1 if i is None else i)]
        expected[(i, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    assert sum(n[2] for n in expected) > 100
    for named in (line_dedup.NAMED, 1):  # with and without room for the frequent keys
        line_dedup.NAMED, before = named, line_dedup.NAMED
        try:
            found = line_dedup.without_repeats(docs).collect()
        finally:
            line_dedup.NAMED = before
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in found) == expected


def test_bitmaps_hold_only_words_with_a_dropped_line(spark):
    docs = spark.createDataFrame([(i, "\n" * 100 + "the very same line in all") for i in range(3)] + [(9, "nothing to drop here at all")],
                                 "doc_id long, text string")
    rows = {r.doc: r.keep for r in line_dedup.keep_bitmaps(docs).collect()}
    assert rows == {0: {1: ~(1 << 36)}, 1: {1: ~(1 << 36)}}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def _near():
    random.seed(8)
    base = [f"w{random.randrange(900)}" for _ in range(120)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(random.randrange(0, 9)):
            words[random.randrange(120)] = f"x{random.randrange(999)}"
        rows.append((200 + i, " ".join(words)))
    chain = list(base[:60])
    for i in range(20):  # each linked with the next, the ends far apart
        chain[i * 2] = f"c{i}"
        rows.append((400 + i, " ".join(chain)))
    passage = " ".join(base[:40])
    rows += [(500 + i, " ".join(f"p{i}_{j}" for j in range(90)) + " " + passage) for i in range(70)]
    rows += [(600 + i, " ".join(base).upper()) for i in range(30)]
    return rows + [(700, None), (701, ""), (702, " \n"), (703, "A b c"), (704, "a B\tc"), (705, "a b c d"), (706, "é ö")]


@pytest.mark.parametrize("options", [{}, {"share": 3000, "many": 5}])
def test_near_duplicates_lose_no_link(spark, options, monkeypatch):
    if options:
        monkeypatch.setattr(jaccard, "CELL", 20)
    rows = _near()
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).repartition(3)
    found = jaccard.near_duplicates(docs, **options).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == {i: (len(s), top(i)) for i, s in sets.items()}
    assert len(found) == len(rows)


def test_one_document_of_each_component_stays(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "A b c d e f", "x"), (3, None, "x"), (None, "a b c d e f", "x")],
                                 "doc_id long, text string, source string")
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None"]


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(50, 51), (51, 50), (None, 3), (60, 60)]
    found = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(31)}, 50: 50, 51: 50, 60: 60}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_family_whose_members_differ_too_much_from_each_other(spark):
    """1,500 near copies of one text, each with words of its own: most pairs share half their tokens and are not
    linked, some are. Every link counts, and pairs do not grow with the square of the family."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    kept = np.zeros((1500, 146), np.float32)
    docs, own = [], []
    for d in range(1500):
        words = list(base)
        for i in rng.sample(range(150), rng.choice([2, 3, 4, 5, 6, 7, 8])):
            words[i] = f"d{d}w{i}"
        kept[d] = [all(words[i + j][0] == "b" for j in range(5)) for i in range(146)]
        own.append(146 - kept[d].sum())
        docs.append((d, " ".join(words)))
    both = kept @ kept.T
    linked = 100 * both >= 80 * (292 - both)
    label = np.arange(1500)
    while True:  # the least id that is reachable
        new = np.where(linked, label[None, :], 1500).min(axis=1)
        new = np.minimum(label, new)
        if (new == label).all():
            break
        label = new
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(frame, many=3).collect()}
    assert found == {d: (146, int(label[d])) for d in range(1500)}
    assert 1 < len(set(label.tolist())) < 1500


@pytest.mark.parametrize("m", [1, 2, 5, 9, 10, 37, 146, 1000])
def test_latest_places_miss_no_link(m):
    """Two linked sets have their first shared token within the places allowed, for every pair of sizes."""
    for n in range(-(-8 * m // 10), 10 * m // 8 + 1):
        shared = -(-4 * (m + n) // 9)
        while 100 * shared < 80 * (m + n - shared):
            shared += 1
        if shared > min(m, n):
            continue
        for a, b in ((m, n), (n, m)):  # all that is not shared comes first
            assert a - shared <= jaccard.latest(np.array([a]), np.array([b]))[0] < jaccard.needed(a)


def test_representatives_keep_columns_of_any_name(spark):
    rows = [(1, "a b c d e f", 1, "x", 2), (2, "a b c d e f", 3, "y", 4), (None, None, 5, "z", 6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, __id long, `a.b` string, component_id long")
    kept = jaccard.representatives(frame)
    assert kept.columns == frame.columns and {tuple(r) for r in kept.collect()} == {rows[0], rows[2]}


def test_bitmaps_smaller_than_the_corpus_tell_tokens_apart(spark, monkeypatch):
    """360 texts of own words and 40 near copies of some. The bitmaps have fewer slots than there are tokens: still few tokens
    count as common, few of those that one group has only go to the matrix, and no link is lost."""
    monkeypatch.setattr(jaccard, "BUCKETS", 4)
    monkeypatch.setattr(jaccard, "MOST_BITS", 14)
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(304))) for i in range(360)]
    rows += [(1000 + i, rows[i][1] + f" end{i}") for i in range(40)]
    maps, dealt, bitmap, matrix = [], [], jaccard._bitmap, jaccard._matrix

    def bitmaps(*args):
        maps.append(bitmap(*args))
        return maps[-1]

    def rows_of(*args):
        made = matrix(*args)
        dealt.append(made.count())
        return made

    monkeypatch.setattr(jaccard, "_bitmap", bitmaps)
    monkeypatch.setattr(jaccard, "_matrix", rows_of)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs, many=2, bits=14).collect()}
    assert found == {**{i: (300, i) for i in range(360)}, **{1000 + i: (301, i) for i in range(40)}}
    assert np.bitwise_count(maps[0][0]).sum() < 0.1 * (1 << 14)  # slots of common tokens
    assert sum(dealt) < 0.4 * 360 * jaccard.needed(300)
