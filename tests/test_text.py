from lanternfold.functions import text as tx


def test_whitespace_is_unicode(values):
    samples = ["a b c", " \t a \n\n b\u0085", "", "　", "x\x1cy"]
    assert values(tx.word_count, samples) == [len(s.split()) for s in samples]
    assert values(tx.collapse, samples) == [" ".join(s.split()) for s in samples]
    assert values(tx.strip, samples) == [s.strip() for s in samples]


def test_clean_lines(values):
    samples = ["a  b\r\nc\n\n \x0bd e", ""]
    expected = [[" ".join(x.split()) for x in s.splitlines() if x.strip()] for s in samples]
    assert values(tx.clean_lines, samples) == expected


def test_phrases_are_whole_words(values):
    texts = ["a long term plan", "the ter is 1", "Downloads here", "lock-in period", "navigate", "total TERs", "ter"]
    run = lambda *p: values(lambda c: tx.has_phrase(tx.phrase_text(c), p), texts)
    assert run("ter") == [False, True, False, False, False, True, True]
    assert run("download") == [False, False, True, False, False, False, False]
    assert run("lock in", "nav") == [False, False, False, True, False, False, False]
    assert run("--") == [False] * len(texts)


def test_sentences(values):
    texts = ["One. Two! (Three) four. five", "no stop", "A.B C. D"]
    assert values(tx.split_sentences, texts) == [["One.", "Two!", "(Three) four. five"], ["no stop"], ["A.B C.", "D"]]


def test_numbers(values):
    texts = ["2,181.07 and 2181.07 and 0.77%", "none", "1. 2,"]
    assert [sorted(v) for v in values(tx.numbers, texts)] == [["0.77", "2181.07"], [], ["1", "2"]]


def test_slug(values):
    texts = ["https://www.a.com/", "https://a.com/x/y/", "http://a.com", "https://www."]
    assert values(tx.slug, texts) == ["a.com", "a.com_x_y", "http:__a.com", "home"]


def test_spans(values):
    rows = values(lambda c: tx.match_spans(c, r"\d+"), ["ab12c345", "7", "none", "é1"])
    assert [[(s.gap, s.text) for s in r] for r in rows] == [[(2, "12"), (1, "345")], [(0, "7")], [], [(1, "1")]]
