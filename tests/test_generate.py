from collections import Counter

import pytest
from pyspark.sql import functions as F

from lanternfold.operators import generate as gen
from lanternfold.operators.ledger import LedgerModel
from lanternfold.rules import FUNDS, MODEL_UNAVAILABLE, NOT_IN_PAGES

MESSY = (
    "Units are priced at 41.20 each day, as [this table](https://prices.example.org/t?d=4) shows . Compare "
    "http://other.example.net/list before you decide! More is on www.blog.example.org/2026 today. Nothing else applies."
)


@pytest.mark.parametrize("text,expected", [
    ("Redemption takes two days.", "Redemption takes two days."),
    ("The figure stands in a note from the trustee.", "The figure stands in a note from the trustee."),
    ("See http://a.example/b, redemption takes two days.", "redemption takes two days."),
    ("Reference - www.a.example", ""),
    ("as the [annual note](http://a.example/n) says", "as the annual note says"),
    ("Ask who it was from.", "Ask who it was."),
    ("left [ ] over (  ) right", "left over right"),
])
def test_strip_urls(values, text, expected):
    assert values(gen.strip_urls, [text]) == [expected]


def test_messy_completion(values):
    (out,) = values(gen.postprocess, [MESSY])
    assert "example" not in out and "http" not in out and "www" not in out and "this table" in out
    assert out.startswith("Units are priced at 41.20 each day") and "Nothing else" not in out


def test_trim(values):
    assert values(gen.trim_sentences, ["It rose! Why? Rates fell. So it stayed.", "no end", " \n "]) == ["It rose! Why? Rates fell.", "no end", ""]


def test_decline(values):
    texts = ["This is not in the official pages.", "The pages do not contain it.", "It is not mentioned in them.",
             "The TER is 1.", "it is NOT PROVIDED"]
    assert values(gen.is_decline, texts) == [True, True, True, False, True]


def test_source_date(values):
    texts = ["2026-10-01T16:18:43+00:00", "2026-09-30T23:30:00-05:00", "soon", "", "2026-13-01"]
    assert values(gen.source_date, texts) == ["1 Oct 2026", "30 Sep 2026", "soon", "", "2026-13-01"]
    assert values(gen.last_updated, ["2026-10-01T16:18:43+00:00", ""]) == ["Last updated from sources: 1 Oct 2026", ""]


def rows(spark, cases):
    hit = "struct<rank:int,id:string,url:string,heading:string,scheme:string,fetched_at:string,text:string," \
          "distance:double,score:double,rank_note:string>"
    return spark.createDataFrame(cases, f"question_id bigint, question string, hits array<{hit}>")


def hit(distance, text, url=FUNDS.approved_urls[1], rank=1):
    return (rank, "id", url, "H", "s", "2026-10-01T00:00:00+00:00", text, distance, distance, "")


def fixed(answer, log=None):
    def call(system, user, temperature, max_tokens):
        assert temperature == 0 and max_tokens == 300 and "CONTEXT:" in user and "QUESTION:" in user
        return answer
    return gen.CallableModel(call)


def test_gates(spark):
    near, far = [hit(0.157, "TER 0.77\n% and 2181.07")], [hit(1.5, "t", FUNDS.approved_urls[0])]
    one = lambda hits, text: gen.respond(rows(spark, [(1, "q", hits)]), fixed(text)).first()
    ok = one(near, "The TER is 0.77 % of 2,181.07.")
    assert (ok.answer, ok.refused, ok.citation_url) == ("The TER is 0.77 % of 2,181.07.", False, FUNDS.approved_urls[1])
    assert ok.last_updated_from_sources == "Last updated from sources: 1 Oct 2026" and ok.debug.model == "callable"
    lie = one(near, "The TER is 0.68%.")
    assert lie.answer == NOT_IN_PAGES and lie.refused and lie.debug.reason == "ungrounded_number"
    assert lie.debug.ungrounded_numbers == ["0.68"] and lie.citation_url == FUNDS.approved_urls[1]
    declined = one(near, "That is not in the official pages.")
    assert not declined.refused and declined.citation_url == FUNDS.default_url
    assert declined.last_updated_from_sources == "" and declined.debug.reason == "model_declined"
    empty = one(near, "  ")
    assert empty.answer == NOT_IN_PAGES and empty.debug.reason == "low_confidence" and empty.debug.best_distance == 0.157
    weak = one(far, "never asked")
    assert weak.answer == NOT_IN_PAGES and weak.citation_url == FUNDS.approved_urls[0] and weak.debug.best_distance == 1.5
    nothing = one([], "never asked")
    assert nothing.citation_url == FUNDS.default_url and nothing.debug.best_distance == 0.0
    stray = one([hit(0.2, "x", "https://elsewhere/")], "fine")
    assert stray.citation_url == FUNDS.approved_urls[0]


def test_a_failed_call_leaves_the_other_answers(spark, tmp_path):
    def sometimes(system, user, temperature, max_tokens):
        if "second" in user:
            raise RuntimeError("401 Unauthorized")
        return "It is listed."

    closed = gen.respond(rows(spark, [(1, "second", [hit(1.5, "t")]), (2, "second", [])]), gen.CallableModel(sometimes))
    assert [r.debug.reason for r in closed.collect()] == ["low_confidence"] * 2
    asked = rows(spark, [(1, "first", [hit(0.1, "t")]), (2, "second", [hit(0.1, "t")]), (3, "third", [hit(0.1, "t")])])
    for model in (gen.CallableModel(sometimes), LedgerModel(sometimes, str(tmp_path / "l"))):
        got = {r.question_id: r for r in gen.respond(asked, model).collect()}
        assert [got[i].answer for i in (1, 3)] == ["It is listed."] * 2
        assert got[2].refused and got[2].answer == MODEL_UNAVAILABLE and got[2].debug.reason == "model_unavailable"
        assert "401 Unauthorized" in got[2].debug.error and got[1].debug.error is None


def test_a_ledger_repeats_no_paid_call(spark, tmp_path):
    log, stop = tmp_path / "calls", tmp_path / "stop"
    stop.write_text("")

    def paid(system, user, temperature, max_tokens):
        import os

        with open(log, "a") as f:
            f.write(user.split("QUESTION: ")[1] + "\n")
        if "q7" in user and os.path.exists(stop):
            os._exit(1)  # the worker dies in the middle of its task
        if "q3" in user:
            raise OSError("busy")
        return "It is listed."

    asked = rows(spark, [(i, f"q{i % 10}", [hit(0.1, "t")]) for i in range(20)])  # each prompt twice
    model = LedgerModel(paid, str(tmp_path / "ledger"), tasks=1)
    with pytest.raises(Exception):
        gen.respond(asked, model).collect()
    first = log.read_text().split()
    assert "q7" in first and len(first) == len(set(first))
    stop.unlink()
    got = {r.question_id: r.debug.reason for r in gen.respond(asked, model).collect()}
    assert {i for i, reason in got.items() if reason} == {3, 13}
    calls = Counter(log.read_text().split())
    assert set(calls) == {f"q{i}" for i in range(10)}
    assert all(n == 1 for q, n in calls.items() if q not in ("q3", "q7")) and calls["q7"] == 2
    assert model.ledger(spark).status()["count"] == 10
    before = sum(calls.values())
    assert len(gen.respond(asked, model).collect()) == 20
    assert sum(Counter(log.read_text().split()).values()) == before + 1  # only the failed one is tried again
    other = LedgerModel(paid, str(tmp_path / "ledger"), system_prompt="Another.", tasks=1)
    gen.respond(asked.limit(1), other).collect()
    assert sum(Counter(log.read_text().split()).values()) == before + 2  # another prompt


def test_context_block(spark):
    df = rows(spark, [(1, "q", [hit(0.1, "A"), hit(0.2, "B", rank=2)]), (2, "q", [])])
    got = {r.question_id: r.c for r in df.select("question_id", gen.context_block(F.col("hits")).alias("c")).collect()}
    assert got[2] == "(no context retrieved)"
    assert got[1].split("\n\n")[1].startswith("[2] source: ") and "  (source date: 2026" in got[1]
