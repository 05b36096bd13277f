import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternfold.llm import mixing, pii, quality, topk, wrapper

# exact top-k


def _vectors():
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=12).round(2).tolist()) for i in range(600)]
    rows += [(700, [0.5] * 12), (701, [0.5] * 12), (702, [0.5] * 12), (3, [0.25] * 12), (800, None), (900, [1.0, None]),
             (1000, [float("nan")] * 12), (1100, [float("inf")] * 12), (1200, [1.0, -1.0]), (1300, []), (None, [1.0] * 12)]
    return rows


@pytest.mark.parametrize("blocks", [(8192, 512), (100, 3)])
def test_topk_is_brute_force(spark, blocks):
    rows = _vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    vectors = topk.integer_vectors(frame)
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(
        x is not None and math.isfinite(x) for x in v)]
    queries = {i: v for i, v in whole if i % 100 == 0}
    expected = set()
    for q, v in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q)
        expected |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:10])}
    found = topk.search(vectors, vectors.where("vec_id % 100 = 0"), 10, *blocks).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in found} == expected and len(found) == len(expected)


def test_lists_are_not_read_to_the_end_when_few_can_win():
    rng = np.random.default_rng(2)
    values = rng.integers(-50, 50, size=(2000, 4))
    values[:12] += 1000
    lists = topk.SortedLists(values)
    assert len(lists.survivors(np.array([3, 1, 2, 0]), 10)) <= 40


def test_topk_of_nothing(spark):
    none = topk.integer_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.search(none, none).count() == 0


# quality


def test_quality_learns_and_scores_everything(spark):
    random.seed(9)
    good = ["river", "stone", "morning", "letter", "garden", "winter"]
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        words = [random.choice(good) for _ in range(40)]
        rows.append((i, " ".join(w.upper() + "!!" if bad else w for w in words)))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(1000, None), (1001, ""), (None, "river stone"), (5, "river stone")]
    labels += [(1, None, 0), (2, 7, 0), (None, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("quality", F.lit("clash"))
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = quality.classify(docs, told, bits=14).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    out = [r for r in found if r.doc_id is not None and r.held_out and r.doc_id < 300]
    assert out and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found if r.doc_id is not None)
    assert np.mean([r.predicted == (r.doc_id % 3 > 0) for r in out]) > 0.95
    again = {(r.doc_id, r.score) for r in quality.classify(docs.repartition(5), told, bits=14).collect()}
    assert again == {(r.doc_id, r.score) for r in found}
    kept = quality.accepted(docs, told, bits=14)
    assert kept.columns == docs.columns and kept.where("doc_id % 3 = 0 AND doc_id < 300").count() <= 5


def test_held_out_labels_are_never_used(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(100)], "doc_id long, text string")
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0]
    told = spark.createDataFrame([(i, i % 2, 0) for i in held], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.classify(docs, told, bits=10).collect()} == {0.5}
    assert quality.classify(docs.limit(0), told, bits=10).count() == 0


# personal data


def luhn(digits):
    doubled = [int(c) * 2 - (9 if c >= "5" else 0) if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def base_spans(text):
    text, out = text or "", []
    out += [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for place, kind, pattern in ((2, "card", r"[0-9]([\x20-]?[0-9])+"), (3, "phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (14 <= len(digits) <= 19 and luhn(digits)) if kind == "card" else 10 <= len(digits) <= 15:
                out.append((m.start(), place, m.end(), kind))
    return sorted(out)


PERSONAL = [
    None, "", "a@b.c%d@e.f x@y.z. @ a@ a@b", "1.2.3.4.5.6.7.8 300.1.1.1 0001.002.3.4 1.2.3", "4111 1111 1111 1111 and 4111111111111112",
    "555-3296 4111111111111111", "é😀 a.b@c.de 😀 +49 (0) 30-123456 x", "+1 (269) 555-3296 99999999999", "+" + "1" * 30, "9" * 3000,
    "1." * 500, "+1((((((", "1 2 3 4 5-6-7-8 9 0 1 2 3 4 5", "0" * 14, "1 " * 2000, "a@b.c" * 50, "+1-234-567-8901+1-234-567-8902",
]


def test_base_spans(spark):
    random.seed(10)
    texts = PERSONAL + ["".join(random.choice("01a@.+- ()5") for _ in range(random.randrange(60))) for _ in range(250)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("found", F.lit("clash"))
    for r in pii.summarise(pii.find(docs)).collect():
        spans = base_spans(texts[r.doc_id])
        listed = [f"{k}:{s}:{e}" for s, _, e, k in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest(), texts[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[3] == k for s in spans) for k in pii.ORDER[:4]]
        assert not Counter(listed) - Counter(r.spans.split(",") if r.spans else [])


def test_a_long_run_takes_time_in_proportion(spark):
    texts = ["a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "1 " * 100_000, "+" * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert pii.find(docs).where("size(found) >= 0").count() == 5


def test_added_spans(spark):
    cases = {
        "555-3296 4111111111111111": "card:9:25", "+1 (269) 555-3296 99999999999": "phone:0:17",
        "please call (555) 123-4567": "phone:12:26", "sum (555) 123-4567": "", "DE89 3704 0044 0532 0130 00 it": "iban:0:27",
        "GB82WEST12345698765431": "", "his SSN is 123-45-6789": "ssn:11:22", "part 123-45-6789": ""}
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.summarise(pii.find(docs)).collect()}
    assert [found[i] for i in range(len(cases))] == list(cases.values())
    assert pii.summarise(pii.find(docs.limit(0))).count() == 0


# mixing


def _sources():
    random.seed(11)
    rows = [(i, " ".join(["word"] * random.randrange(1, 60)), "big" if i < 300 else random.choice(["s", "t", None])) for i in range(500)]
    return rows + [(1000, None, "s"), (1001, "", "t"), (7, rows[7][1], "big"), (None, "no id", "big")]


def test_mix_meets_limit_and_loses_nothing(spark):
    rows = _sources()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("tokens", F.lit("clash"))
    mixed = mixing.units(docs)
    weights = mixing.weights(mixed, max_repeats=1.5).collect()
    tokens = defaultdict(int)
    for _, t, s in rows:
        tokens[s] += len((t or "").split()) + 1
    assert {w.source: w.tokens for w in weights} == tokens
    assert abs(sum(w.weight for w in weights) - 1) < 1e-9 and len({w.alpha for w in weights}) == 1
    read = [w.weight / w.share for w in weights]
    assert 1.49 < max(read) / min(read) <= 1.5 + 1e-6 and all(w.quota >= w.tokens for w in weights)
    found = mixing.realise(mixed, mixing.weights(mixed, max_repeats=1.5), block_tokens=500).collect()
    assert {(r.doc_id, r.source) for r in found} == {(i, s) for i, _, s in rows}
    for w in weights:
        got = sum(r.tokens for r in found if r.source == w.source)
        assert w.quota - 61 <= got <= w.quota
    blocks = defaultdict(Counter)
    for r in found:
        blocks[r.block][r.source] += r.tokens
    for w in weights:  # every block holds the mix, to a document or two
        each = [blocks[b][w.source] for b in blocks]
        assert max(each) - min(each) < 250
    for b in blocks:
        assert sorted(r.position for r in found if r.block == b) == list(range(1, sum(r.block == b for r in found) + 1))
    assert {(r.doc_id, r.copy) for r in found if r.source == "big"} == {(i, 0) for i, _, s in rows if s == "big"}


def test_mix_meets_entropy_and_budget(spark):
    docs = spark.createDataFrame(_sources(), "doc_id long, text string, source string")
    mixed = mixing.units(docs)
    rows = mixing.weights(mixed, max_repeats=None, target_entropy=1.3, budget=4000).collect()
    assert abs(-sum(r.weight * math.log(r.weight) for r in rows) - 1.3) < 1e-6
    assert abs(sum(r.quota for r in rows) - 4000) <= 2
    found = mixing.realise(mixed, mixing.weights(mixed, max_repeats=None, target_entropy=1.3, budget=4000)).collect()
    assert sum(r.tokens for r in found) <= 4002
    with pytest.raises(ValueError):
        mixing.weights(mixed, target_entropy=1.0)


def test_many_cells_give_the_same_mix(spark, monkeypatch):
    docs = spark.createDataFrame(_sources(), "doc_id long, text string, source string")
    one = {tuple(r) for r in mixing.mix(docs).collect()}
    monkeypatch.setattr(mixing, "PER_CELL", 10)
    assert {tuple(r) for r in mixing.mix(docs).collect()} == one


def test_mixed_documents(spark):
    rows = _sources()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    times = Counter((r.doc_id, r.source) for r in mixing.mix(docs).collect())
    found = mixing.mixed_documents(docs)
    assert found.columns == docs.columns
    got = Counter((r.doc_id, r.source) for r in found.collect())
    assert got[(7, "big")] == 2 * times[(7, "big")] and set(got) == {(i, s) for i, _, s in rows}
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


# html


def test_tree_matching():
    a = wrapper.parse("<ul><li>1<li>2<li><b>3</b></ul>")
    b = wrapper.parse("<ul><li>1<li><b>3</b></ul><p>more")
    assert wrapper.matching(a, a)[0] == 6
    assert wrapper.matching(a, b)[0] == 5
    assert len(wrapper.aligned(a, b)) == 5


def test_deep_and_wide_trees():
    deep, wide = "<div>" * 3000 + "x", "<ul>" + "<li><b>1</b>" * 3000 + "</ul>"
    assert wrapper.matching(wrapper.parse(deep), wrapper.parse(deep))[0] == 3001
    assert wrapper.matching(wrapper.parse(wide), wrapper.parse(wide))[0] == 6002
    assert wrapper.main_text(wrapper.parse(deep), set()) == "x"
    rng = random.Random(5)

    def plain(a, b):  # the definition, without shortcuts
        if a.tag != b.tag or a.label != b.label:
            return 0
        best = {}
        for i in range(len(a.nodes) + 1):
            for j in range(len(b.nodes) + 1):
                best[i, j] = max(best[i - 1, j], best[i, j - 1], best[i - 1, j - 1] + plain(a.nodes[i - 1], b.nodes[j - 1])) if i and j else 0
        return best[len(a.nodes), len(b.nodes)] + 1

    def page(n):
        return "<div>" if n == 0 else "".join(rng.choice(["<p>t</p>", "<i>t</i>", "<div><p>a</p><i>b</i></div>", "<div></div>"]) for _ in range(n))

    for _ in range(200):
        a, b = wrapper.parse(page(rng.randrange(7))), wrapper.parse(page(rng.randrange(7)))
        assert wrapper.matching(a, b)[0] == plain(a, b)
        assert len(wrapper.aligned(a, b)) == plain(a, b)


@pytest.mark.parametrize("html, text", [
    ("", ""), ("plain", "plain"), ("a&amp;b &lt; c", "a&b < c"), ("<p>a<p>b<br>c</p>d", "a\n\nb c\n\nd"),
    ("<b>b<i>o</b>ld</i>", "bold"), ("<script>var a='<p>x</p>'</script>y", "y"), ("<div class='ad'>x</div>y", "y"),
    ("<div class='road'>x</div>", "x"), ("<nav>m</nav><article><h1>T</h1><p>x\n\t y</article><p>z", "T\n\nx y"),
    ("<main><p>m</p></main>tail", "m"), ("<ul><li>1<li>2</ul>", "1\n\n2"), ("<div id=comments>c</div><p>x", "x"),
    ("<p>a<!-- <p>b --><iframe src='x'/>c</p>", "ac"), ("a < b <", "a < b <"), ("<p title=\"it's>\">x", "x"),
])
def test_one_page(html, text):
    assert wrapper.main_text(wrapper.parse(html), set()) == text


def test_constant_slots_are_template(spark):
    pages = [(i, f"https://h{i % 2}.x/p{i}",
              f"<body><div>The same on every page</div><div>Part {i % 2} of many</div><div>Story number {i} by hand</div></body>")
             for i in range(40)]
    pages += [(100, None, None), (101, "no host", ""), (102, "https://alone.x/", "<div>The same on every page</div>")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("template", F.lit("clash")).repartition(3)
    found = {r.page_id: r.text for r in wrapper.main_texts(frame).collect()}
    assert found == {**{i: f"Story number {i} by hand" for i in range(40)}, 100: "", 101: "", 102: "The same on every page"}
    assert wrapper.main_texts(frame.limit(0)).count() == 0


def test_copies_of_a_page_make_no_template(spark):
    pages = [(i, "https://h.x/", "<body><div>Once written, often served</div></body>") for i in range(50)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.text for r in wrapper.main_texts(frame).collect()} == {"Once written, often served"}


def _main_texts(spark, bodies, host="h.x"):
    rows = [(i, f"https://{host}/{i}", b) for i, b in enumerate(bodies)]
    found = wrapper.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r.text for r in sorted(found, key=lambda r: r.page_id)]


def test_only_the_constant_content_of_a_slot_is_dropped(spark):
    notes = [f"Written by reader {i} alone" if i % 5 == 0 else "Common notice of this host" for i in range(40)]
    bodies = [f"<body><div>{n}</div><div>Story number {i} by hand</div></body>" for i, n in enumerate(notes)]
    expected = [f"Written by reader {i} alone\n\nStory number {i} by hand" if i % 5 == 0 else f"Story number {i} by hand" for i in range(40)]
    assert _main_texts(spark, bodies) == expected


def test_near_copies_count_as_one_page(spark):
    story = "".join(f"<p>{f'Sentence {k} of the one long article. ' * 9}</p>" for k in range(12))
    for tag in ("article", "div"):
        found = _main_texts(spark, [f"<body><nav>track {i}</nav><{tag}>{story}<p>offer {i}</p></{tag}></body>" for i in range(30)])
        assert all(f.count("\n\n") == 12 and f.startswith("Sentence 0 of") and f.endswith(f"offer {i}") for i, f in enumerate(found))


LONG = "The whole story of the page, told at some length. " * 4


@pytest.mark.parametrize("html, text", [
    (f"<html class='no-js ads'><body class='single right-sidebar'><p>{LONG}", LONG.strip()),
    (f"<div class='content-with-sidebar'><p>{LONG}</p></div><div class='sidebar'>x</div>", LONG.strip()),
    (f"<article class='post has-comments'><p>{LONG}</article>", LONG.strip()),
    ("<article><h2 id='search'>Search</h2><p>x<h3 id='form-validation'>Form</h3></article>", "Search\n\nx\n\nForm"),
    (f"<div class='widget'><p>{LONG}</p><div class='share'>x</div></div><p>y", f"{LONG.strip()}\n\ny"),
    (f"<article>x</article><div class='ad'>{LONG}</div>", "x"),
])
def test_class_words_cut_no_story(html, text):
    assert wrapper.main_text(wrapper.parse(html), set()) == text


def test_statistics_confirm_what_a_class_word_cuts(spark):
    long = [f"Story {i} of the host. " * 9 for i in range(12)]
    body = [f"<body><p>Told {i}</p><div class='widget'>{long[i]}</div></body>" for i in range(12)]
    assert _main_texts(spark, body) == [f"Told {i}\n\n{long[i].strip()}" for i in range(12)]
    body = [f"<body><p>{long[i]}</p><div class='comments'>Told {i} {long[i] * 2 if i == 3 else ''}</div></body>" for i in range(12)]
    assert _main_texts(spark, body) == [x.strip() for x in long]


def test_every_node_of_deep_and_wide_trees_is_aligned():
    deep = "<div>" * 3000 + "<b>x</b>"
    assert len(wrapper.aligned(wrapper.parse(deep), wrapper.parse(deep + "<i>y</i>"))) == 3002
    rng = random.Random(6)
    words = [rng.choice("abcd") for _ in range(400)]
    a = wrapper.parse("<h1>x</h1>" + "".join(f"<p class={w}>x</p>" for w in words))
    b = wrapper.parse("".join(f"<p class={w}>x</p>" for w in words[3:]) + "<h1>x</h1>")
    assert len(wrapper.aligned(a, b)) == 1 + 397
    xs, ys = [rng.randrange(4) for _ in range(300)], [rng.randrange(4) for _ in range(290)]
    row = [0] * (len(ys) + 1)
    for x in xs:
        above, row = row, [0]
        for j, y in enumerate(ys):
            row.append(max(above[j] + 1 + min(x, y), above[j + 1], row[j]))
    a, b = (wrapper.parse("".join(f"<p>{'<b></b>' * n}</p>" for n in ns)) for ns in (xs, ys))
    score, pairs = wrapper.matching(a, b)
    assert score == len(pairs) == 1 + row[-1]


def test_template_that_the_pattern_page_lacks(spark):
    notice = "<section><p>Join the club of this host today</p></section>"
    story = [f"Story number {i} {'of some length ' * (10 + 400 * (i == 0))}by hand" for i in range(20)]
    bodies = [f"<body>{notice if i % 5 else ''}<div>{story[i]}</div></body>" for i in range(20)]
    assert abs(len(bodies[0]) - wrapper.USUAL) == min(abs(len(b) - wrapper.USUAL) for b in bodies)
    assert _main_texts(spark, bodies) == story


@pytest.mark.parametrize("html, text", [
    ("<main><p>story</p><div class='discussion'><article class='comment'>..</article></div></main>", "story"),
    (f"<main><p>story</p><article class='comment'>{LONG}</article></main>", "story"),
    ("<main><p>story</p><div class='more'><article><h3>teaser</h3></article></div></main>", "story\n\nteaser"),
    (f"<div><p>{LONG}</p></div><article><h3>teaser</h3></article>", f"{LONG.strip()}\n\nteaser"),
    (f"<article>{LONG}</article><p>tail<article>more</article>", f"{LONG.strip()}\n\nmore"),
    (f"<main>x</main><p>tail<article>{LONG}</article>", LONG.strip()),
    (f"<main></main><p>{LONG}", LONG.strip()),
])
def test_articles_hold_the_text_only_if_most_of_it(html, text):
    assert wrapper.main_text(wrapper.parse(html), set()) == text


@pytest.mark.parametrize("tail", ["<a " + "x" * 200_000, "<a '" + "b=\"c\" " * 50_000, "<a<" * 100_000, "<a \"" * 50_001, "<!--" * 50_000,
                                  "<div class=\"x" + " y='1'" * 40_000 + ">", "<" * 200_000, "< /" * 100_000, "<a b='" * 40_000 + ">"])
def test_truncated_and_broken_pages_end_soon(tail):
    began = time.monotonic()
    assert wrapper.main_text(wrapper.parse("<p>story</p>" + tail), set()).startswith("story")
    assert time.monotonic() - began < 2


@pytest.mark.parametrize("html, text", [
    ("<p>a</p><a href='x", "a"), ("<p>a</p>b < c", "a\n\nb < c"), ("<p>a</p><!-- b", "a"),
    (f"<article><header><nav>m</nav><div><h1>Title</h1><p class=byline>who</p></div></header><p>{LONG}</article>", f"Title\n\n{LONG.strip()}"),
    (f"<header><h1>Site</h1></header><article><p>{LONG}</article>", LONG.strip()),
    (f"<article><p class='search'>How to search</p><p>{LONG}</p><p class='ad'>x</p></article>", f"How to search\n\n{LONG.strip()}"),
    (f"<article>{LONG}</article><p class='search'>find</p>", LONG.strip()),
])
def test_headings_and_paragraphs_of_articles(html, text):
    assert wrapper.main_text(wrapper.parse(html), set()) == text


@pytest.mark.parametrize("words", [12, 40, 400])
def test_hosts_of_short_articles_lose_their_menu(spark, words):
    menu = "".join(f"<div>Link number {k}</div>" for k in range(30))
    story = [" ".join(f"w{i}x{k}" for k in range(words)) for i in range(60)]
    assert _main_texts(spark, [f"<body>{menu}<div>{t}</div></body>" for t in story]) == story


def test_induction_equals_counting_by_hand(spark):
    """Pages of one shape: a content is template where at least half of the host's pages have it at its place."""
    rng = random.Random(8)
    pages, want = [], []
    for i in range(80):
        cells = [rng.choice([f"Constant {k} of all", f"Seldom {k} number {i} alone"]) if k < 6 else f"Story {i} in cell {k}" for k in range(9)]
        pages.append(f"<body>{''.join(f'<div>{c}</div>' for c in cells)}</body>")
        want.append(cells)
    counts = Counter((k, c) for cells in want for k, c in enumerate(cells))
    expected = ["\n\n".join(c for k, c in enumerate(cells) if counts[k, c] < 40) for cells in want]
    kept = {k for k in range(6) if counts[k, f"Constant {k} of all"] < 40}
    found = _main_texts(spark, pages)
    # two contents that several slots have in turn may go as well (VALUES); what is a page's own never does
    assert all(set(e.split("\n\n")) - {f"Constant {k} of all" for k in kept} <= set(f.split("\n\n")) <= set(e.split("\n\n")) for e, f in zip(expected, found, strict=True))


def test_short_lists_of_trees_pair_as_long_ones_do(monkeypatch):
    rng = random.Random(9)
    pages = ["".join(rng.choice(["<p>t</p>", "<i>t</i>", "<div><p>a</p><i>b</i></div>", "<div><i>b</i></div>"]) for _ in range(rng.randrange(9)))
             for _ in range(60)]

    def places(shorts):
        monkeypatch.setattr(wrapper._Shapes, "FEW", shorts)
        out = []
        for a, b in zip(map(wrapper.parse, pages), map(wrapper.parse, pages[1:])):
            one, other = wrapper.slots(a), wrapper.slots(b)
            out.append(sorted((one[id(x)], other[id(y)]) for x, y in wrapper.aligned(a, b)))
        return out

    assert places(64) == places(0)


def test_equal_attributes_of_tags_are_read_once(monkeypatch):
    read = []
    monkeypatch.setattr(wrapper, "_NAMED", wrapper._Remembered(lambda a: read.append(a) or wrapper._named(a)))
    page = wrapper.parse("<body>" + "<p class='Story Advert'>x</p><p id=a>y</p>" * 500 + "</body>")
    assert read == [" class='Story Advert'", " id=a"]
    assert [(n.label, n.marked) for n in page.nodes[0].nodes[:2]] == [("story advert", True), ("a", False)]
    wrapper._NAMED.MOST = 2
    wrapper.parse("".join(f"<p id={i}>x</p>" for i in range(9)))
    assert len(wrapper._NAMED) <= 2


def test_values_among_sorted_ones():
    rng = np.random.default_rng(4)
    for size in (0, 1, 50):
        values, others = rng.integers(-40, 40, 90), rng.integers(-30, 30, size)
        assert (wrapper._among(values, np.sort(others)) == np.isin(values, others)).all()
    assert not len(wrapper._among(np.zeros(0, np.int64), np.arange(3)))
