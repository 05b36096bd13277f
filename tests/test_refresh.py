"""Fetching a table of addresses with a stub in place of the network."""

import json

from pyspark.sql import functions as F

from lanternfold.sources.refresh import Answer, PageStore, fetch_table


def stub(folder):
    """Pages are files in a folder; every request leaves a line in a log."""
    def ask(url, timeout, headers):
        with open(f"{folder}/log", "a") as f:
            f.write(json.dumps([url, headers]) + "\n")
        with open(f"{folder}/site.json") as f:
            page = json.load(f).get(url)
        if page is None:
            raise OSError("no route")
        if page == "gone":
            return Answer(410)
        if page == "odd":
            raise ValueError("odd answer")
        text, etag = page
        if etag and headers.get("If-None-Match") == etag:
            return Answer(304)
        return Answer(200, text, etag)

    return ask


def asked(folder):
    found = [json.loads(line) for line in (folder / "log").read_text().splitlines()]
    (folder / "log").write_text("")
    return found


def test_only_changed_pages_are_handed_on(spark, tmp_path):
    site = {f"https://h{i % 3}.x/{i}": [f"<p>page {i}", f"v{i}" if i % 2 else None] for i in range(12)}
    (tmp_path / "site.json").write_text(json.dumps(site))
    addresses = spark.createDataFrame([(i, u) for i, u in enumerate(site)] + [(50, "https://h0.x/none"), (51, None)], "page_no bigint, url string")
    store = PageStore(spark, str(tmp_path / "pages"))
    options = {"ask": stub(tmp_path), "pause": 0, "sleep": lambda s: None}
    changed, counts = store.refresh(addresses, **options)
    assert counts == {"changed": 12, "same": 0, "failed": 2}
    assert {r.url: r.html for r in changed.where("error IS NULL").collect()} == {u: p[0] for u, p in site.items()}
    assert {r.page_no for r in changed.where("error IS NOT NULL").collect()} == {50, 51}
    assert sum(u == "https://h0.x/none" for u, _ in asked(tmp_path)) == 3  # tried again, then given up

    site["https://h1.x/1"] = ["<p>page one, again", "w1"]
    site["https://h2.x/2"] = ["<p>page two, again", None]
    site["https://h0.x/3"] = "gone"
    site["https://h1.x/4"] = "odd"
    (tmp_path / "site.json").write_text(json.dumps(site))
    changed, counts = store.refresh(addresses, **options)
    assert counts == {"changed": 2, "same": 8, "failed": 4}
    assert {r.url for r in changed.where("error IS NULL").collect()} == {"https://h1.x/1", "https://h2.x/2"}
    sent = dict(asked(tmp_path))
    assert sent["https://h2.x/5"] == {"If-None-Match": "v5"} and sent["https://h0.x/6"] == {}
    kept = {r.url: r.html for r in store.pages().collect()}
    assert len(kept) == 12 and kept["https://h0.x/3"] == "<p>page 3" and kept["https://h1.x/1"] == "<p>page one, again"


def test_hosts_are_asked_with_pauses_and_no_address_is_in_the_driver(spark, tmp_path):
    (tmp_path / "site.json").write_text(json.dumps({f"https://h{i % 2}.x/{i}": ["x", None] for i in range(10)}))
    addresses = spark.range(10).select(F.col("id").alias("page_no"), F.concat(F.lit("https://h"), F.col("id") % 2, F.lit(".x/"), "id").alias("url"))

    def nap(seconds, log=str(tmp_path / "naps")):
        with open(log, "a") as f:
            f.write(f"{seconds}\n")

    got = fetch_table(addresses, ask=stub(tmp_path), pause=0.5, sleep=nap)
    assert got.where("state = 'changed'").count() == 10
    assert (tmp_path / "naps").read_text().split() == ["0.5"] * 8  # between the five of each host
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" not in plan and "Range" in plan
    assert fetch_table(addresses.limit(0), ask=stub(tmp_path)).count() == 0
