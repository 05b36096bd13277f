import hashlib
import random

from pyspark.sql import functions as F

from lanternfold.operators import chunks as ch


def words(n, seed=0):
    return " ".join(f"w{seed}x{i}" for i in range(n))


def brute_pack(lines):
    """Blocks by walking the lines one at a time."""
    blocks, open_block, total = [], None, 0
    for line in lines:
        n = len(line.split())
        if n > 200:
            open_block = None
            blocks.append([line])
        elif open_block is None or total + n > 160:
            open_block, total = [line], n
            blocks.append(open_block)
        else:
            open_block.append(line)
            total += n
    return blocks


def test_packing_matches_brute_force(spark):
    rng = random.Random(7)
    cases = [[words(rng.choice([1, 5, 30, 80, 159, 160, 161, 200, 201, 260]), i) for i in range(rng.randint(1, 12))]
             for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, lines array<string>")
    got = {r.i: r.b for r in df.select("i", ch.pack_lines(F.col("lines")).alias("b")).collect()}
    for i, lines in enumerate(cases):
        assert got[i] == brute_pack(lines), i


def test_long_line_opens_into_sentences_only_if_all_fit(spark):
    fits = f"A{words(150)}. B{words(100)}."
    does_not = f"A{words(250)}. B{words(10)}."
    df = spark.createDataFrame([(0, [fits]), (1, [does_not])], "i int, lines array<string>")
    got = {r.i: r.b for r in df.select("i", ch.pack_lines(F.col("lines")).alias("b")).collect()}
    assert [len(x) for x in got[0]] == [2]
    assert got[1] == [[does_not]]


def test_overlap_tail(spark):
    cases = [[words(20), words(9, 1)], [words(20), words(10, 1)], [words(20), words(11, 1)], [words(30)], [words(40)],
             [words(5), words(40, 1)], [words(29)], [words(1, i) for i in range(50)], []]
    expected = [2, 1, 1, 0, 0, 0, 1, 29, 0]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, b array<string>")
    got = {r.i: r.t for r in df.select("i", ch.overlap_tail(F.col("b")).alias("t")).collect()}
    for i, n in enumerate(expected):
        assert got[i] == (cases[i][len(cases[i]) - n:] if n else []), i


def chunked(spark, sections):
    rows = [(1, "https://x/y", "T", "s", "2026-01-01T00:00:00+00:00", sections)]
    df = spark.createDataFrame(rows, "page_no bigint, url string, title string, scheme string, fetched_at string, "
                                     "sections array<struct<heading:string,lines:array<string>>>")
    return ch.chunk_pages(df)


def test_drops_ids_and_headings(spark):
    sections = [
        ("Overview", [words(20)]),
        ("Graph", ["Table"]),
        ("Exit Load", ["NIL"]),
        ("Odd", ["Very Very"]),
        ("Short", ["too few words"]),
        ("Big", [words(100, i) for i in range(3)]),
        ("High High", ["Very High Very High"]),
    ]
    c = chunked(spark, sections)
    kept = sorted(ch.kept_chunks(c).collect(), key=lambda r: r.chunk_index)
    assert [k.heading for k in kept] == ["Overview", "Exit Load", "Big", "Big", "Big"]
    assert [k.chunk_index for k in kept] == [0, 1, 2, 3, 4]
    assert kept[1].text == "Exit Load\nNIL" and kept[0].text == words(20)
    assert all(k.id == hashlib.sha1(f"https://x/y#{k.chunk_index}".encode()).hexdigest()[:16] for k in kept)
    reasons = [(d.reason, d.text) for d in sorted(ch.dropped_chunks(c).collect(), key=lambda r: r.drop_no)]
    assert reasons == [("boilerplate", "Table"), ("boilerplate", "Very Very"), ("under 12 words", "too few words"),
                       ("under 12 words", "Very High Very High")]
    counts = ch.page_counts(c).first()
    assert (counts.sections, counts.chunks, counts.dropped) == (7, 5, 4)


def test_overlap_is_taken_from_the_block_without_overlap(spark):
    lines = [words(150), words(8, 1), words(155, 2), words(3, 3), words(150, 4)]
    kept = sorted(ch.kept_chunks(chunked(spark, [("Overview", lines)])).collect(), key=lambda r: r.chunk_index)
    bodies = [k.text.split("\n") for k in kept]
    assert bodies == [lines[:2], [lines[1], *lines[2:4]], [lines[3], lines[4]]]


def test_empty_page_is_reported(spark):
    c = chunked(spark, [("Short", ["x"])])
    assert [r.url for r in ch.empty_pages(c).collect()] == ["https://x/y"]
