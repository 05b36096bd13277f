"""Fetching a table of addresses again and again, politely and only what has changed.

Addresses are a table of any size, dealt to tasks by host; no list of them is in the driver. A task asks one host
after the other, with a pause between two requests to the same host. What is known of a page from the last time (entity
tag, date, digest of its text) makes the request conditional: an answer "not modified", or a text with the same digest, leaves
the page as it is. Pages are kept in a collection by address, so a refresh writes and hands on the changed pages only.
"""

from __future__ import annotations

import hashlib
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfold.session import release, stage
from lanternfold.sources.collection import Collection
from lanternfold.sources.web import BROWSER_HEADERS, backoff


@dataclass(frozen=True)
class Answer:
    """What a transport gives back: a status and, if there is one, a text with its tag and date."""

    status: int
    text: str | None = None
    etag: str | None = None
    modified: str | None = None


def http_ask(url: str, timeout: float, headers: dict[str, str]) -> Answer:
    request = urllib.request.Request(url, headers={**BROWSER_HEADERS, **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as response:
            text = response.read().decode(response.headers.get_content_charset() or "utf-8", "replace")
            return Answer(getattr(response, "status", None) or 200, text, response.headers.get("ETag"), response.headers.get("Last-Modified"))
    except urllib.error.HTTPError as exc:
        if exc.code == 304:
            return Answer(304)
        raise


FETCHED = "page_no bigint, url string, html string, etag string, modified string, digest string, state string, error string"
_FETCHED = pa.schema([(f.split()[0], pa.int64() if f.endswith("bigint") else pa.string()) for f in FETCHED.split(", ")])


def fetch_table(addresses: DataFrame, known: DataFrame | None = None, *, ask: Callable[[str, float, dict], Answer] = http_ask,
                pause: float = 1.0, lanes: int = 1, attempts: int = 3, timeout: float = 30,
                sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``addresses(page_no, url)`` -> FETCHED, one row each. ``state`` is changed, same or failed; html is there for changed ones.

    ``known(url, etag, modified, digest)`` is what the last time left. ``lanes`` tasks may ask one host at a time."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    rows = addresses.select("page_no", "url", host.alias("host"), F.pmod(F.xxhash64("url"), F.lit(lanes)).alias("lane"))
    if known is not None:
        rows = rows.join(known.select("url", "etag", "modified", "digest"), "url", "left")
    else:
        rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("etag", "modified", "digest")})

    def one(url, etag, modified, digest):
        headers = {k: v for k, v in (("If-None-Match", etag), ("If-Modified-Since", modified)) if v}
        last = "no try was made"
        for wait in backoff(attempts):
            if wait:
                sleep(wait)
            try:
                got = ask(url, timeout, headers)
            except OSError as exc:  # only transport errors are worth another try
                last = f"{url}: {exc}"
                continue
            except Exception as exc:
                return None, None, None, None, "failed", f"{url}: {type(exc).__name__}: {exc}"
            if got.status == 304:
                return None, etag, modified, digest, "same", None
            if got.text is None or got.status >= 400:
                return None, None, None, None, "failed", f"{url}: status {got.status}"
            made = hashlib.sha256(got.text.encode("utf-8", "surrogatepass")).hexdigest()
            return got.text if made != digest else None, got.etag, got.modified, made, "same" if made == digest else "changed", None
        return None, None, None, None, "failed", last

    def run(batches):
        asked = None
        for batch in batches:
            for page_no, url, etag, modified, digest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                of = urlsplit(url or "").netloc.lower()
                if pause and of == asked:
                    sleep(pause)
                asked = of
                html, etag, modified, digest, state, error = one(url, etag, modified, digest) if url else (None,) * 4 + ("failed", "no address")
                yield pa.RecordBatch.from_pylist([dict(zip(_FETCHED.names, (page_no, url, html, etag, modified, digest, state, error)))], schema=_FETCHED)

    dealt = rows.repartition("host", "lane").sortWithinPartitions("host", "lane", "url")
    return dealt.select("page_no", "url", "etag", "modified", "digest").mapInArrow(run, FETCHED)


class PageStore:
    """Pages by address, as they were last fetched."""

    def __init__(self, spark: SparkSession, path: str):
        self.collection = Collection(spark, path)

    def pages(self) -> DataFrame:
        """``page_no, url, html`` of every page kept."""
        return self.collection.read().select("page_no", F.col("id").alias("url"), "html")

    def known(self) -> DataFrame | None:
        if not self.collection.version():
            return None
        return self.collection.read().select(F.col("id").alias("url"), "etag", "modified", "digest")

    def refresh(self, addresses: DataFrame, **options) -> tuple[DataFrame, dict]:
        """Asks every address once. Gives the changed pages (page_no, url, html) and how many changed, stayed or failed.
        A page that failed keeps what it had; its error is in ``failed`` of the result's frame (``error`` not null)."""
        states = {s: F.count_if(F.col("state") == s) for s in ("changed", "same", "failed")}
        got = stage(fetch_table(addresses, self.known(), **options), "fetched", **states)
        counts = dict(got.observed)
        changed = got.where("state = 'changed'")
        if counts["changed"]:
            self.collection.upsert(changed.select(F.col("url").alias("id"), "page_no", "html", "etag", "modified", "digest"))
        out = stage(got.where("state <> 'same'").select("page_no", "url", "html", "error"), "changed-pages")
        release(got)
        return out, counts
