"""Search backends, model clients and fetching, behind plain protocols. A table can stand in for each of them."""

from __future__ import annotations

import datetime as dt
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import mime_type, sniff_type
from ..plans.config import ExtractConfig


class SearchBackend(Protocol):
    name: str

    def search(self, queries: DataFrame) -> DataFrame:
        """Rows with cache_key and RAW_RESULT columns for rows with cache_key and text."""


class TableBackend:
    """Answers from a table (text, RAW_RESULT columns): what a recorded or offline search gives."""

    recorded = True  # asking it twice costs nothing

    def __init__(self, table: DataFrame, name: str = "table"):
        self.table, self.name = table, name

    def search(self, queries: DataFrame) -> DataFrame:
        return queries.select("cache_key", "text").join(self.table, "text").select("cache_key", "url", "title", "snippet", "rank", "published_date", "score")


class CallBackend:
    """Answers from call(text, most) -> list of dicts, run on the executors. Items without a url are skipped, and their ranks
    stay empty; a call that fails has no results. Every use of what it returns is a call: see calls.OnceBackend."""

    def __init__(self, call: Callable[[str, int], list[dict]], name: str, most: int = 10):
        self.call, self.name, self.most = call, name, most

    def search(self, queries: DataFrame) -> DataFrame:
        return self.answers(queries).filter("url is not null")

    def answers(self, queries: DataFrame) -> DataFrame:
        """The results, and for a query that has none a row without a url."""
        call, most = self.call, self.most

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                rows = []
                for key, query in zip(f["cache_key"], f["text"], strict=True):
                    rows += [(key, *x) for x in results_of_call(call, query, most)] or [(key, None, None, None, None, None, None)]
                yield pd.DataFrame(rows, columns=["cache_key", "url", "title", "snippet", "rank", "published_date", "score"])

        return queries.select("cache_key", "text").mapInPandas(run, f"cache_key string, {schemas.RAW_RESULT}")


def results_of_call(call: Callable[[str, int], list[dict]], query: str, most: int) -> list[tuple]:
    """RAW_RESULT rows of one call; none if it fails, whatever the reason."""
    try:
        items = list(call(query, most))
    except Exception:  # noqa: BLE001  any failure of a remote service is an empty answer
        return []
    number = lambda x: None if x is None else float(x)
    return [(x["url"], x.get("title", ""), x.get("content", ""), i, x.get("published_date"), number(x.get("score"))) for i, x in enumerate(items, 1) if isinstance(x, dict) and x.get("url")]


class ModelClient(Protocol):
    def complete(self, prompts: DataFrame) -> DataFrame:
        """(key, raw_text, input_tokens, output_tokens, model) for (key, prompt)."""


class TableModel:
    """Replies recorded by key."""

    recorded = True  # asking it twice costs nothing

    def __init__(self, replies: DataFrame):
        self.replies = replies

    def complete(self, prompts: DataFrame) -> DataFrame:
        return prompts.select("key").join(self.replies, "key")


def with_reply_columns(replies: DataFrame) -> DataFrame:
    """REPLY columns of a model's answers, null where it says nothing of them."""
    kinds = [c.split() for c in schemas.REPLY.split(", ")]
    return replies.select(*[(F.col(c) if c in replies.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds])


def fetch_http(requests: DataFrame, cfg: ExtractConfig = ExtractConfig(), agent: str = "evloom") -> DataFrame:
    """FETCH_RESULT rows for requests (url), fetched by the executors; redirects are followed.

    A body may have most_bytes bytes: a larger announced length is refused before the body is read, and a larger body where it goes
    beyond. Any failure is a row with an error and without content; other status codes than 2xx are none. Deal the requests by domain
    beforehand to be polite. Every use of what it returns is a request: see calls.fetch_once.
    """
    limit, timeout = cfg.most_bytes, cfg.timeout_s

    def get(url: str) -> tuple:
        now = dt.datetime.now(dt.UTC).replace(tzinfo=None)
        try:
            request = urllib.request.Request(url, headers={"User-Agent": agent})
            try:
                reply = urllib.request.urlopen(request, timeout=timeout)  # noqa: S310
            except urllib.error.HTTPError as e:
                reply = e
            with reply:
                known = (url, reply.geturl(), reply.status, reply.headers.get("Content-Type"))
                announced = reply.headers.get("Content-Length")
                if announced and announced.isdigit() and int(announced) > limit:
                    return (*known, None, now, f"content too large: {announced} bytes announced")
                body = bytearray()
                while piece := reply.read(1 << 16):
                    body += piece
                    if len(body) > limit:
                        return (*known, None, now, f"content too large: more than {limit} bytes")
                return (*known, bytes(body), now, None)
        except Exception as e:  # noqa: BLE001  whatever a remote host does is a row
            return (url, url, None, None, None, now, str(e) or type(e).__name__)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["url", "final_url", "status_code", "header", "content_bytes", "fetched_at", "error"]
        for f in frames:
            for url in f["url"]:  # one at a time, so that a batch of large bodies is never held
                yield pd.DataFrame([get(url)], columns=names).astype({"status_code": "Int32"})

    got = requests.select("url").mapInPandas(run, "url string, final_url string, status_code int, header string, content_bytes binary, fetched_at timestamp, error string")
    head = F.decode(F.substring("content_bytes", 1, 64), "ISO-8859-1")
    kind = F.when(F.col("content_bytes").isNotNull(), sniff_type(F.col("header"), head)).otherwise(mime_type(F.col("header")))
    return got.select("url", "final_url", "status_code", kind.alias("content_type"), "content_bytes", "fetched_at", "error")


def fetch_table(requests: DataFrame, pages: DataFrame, cfg: ExtractConfig = ExtractConfig()) -> DataFrame:
    """FETCH_RESULT rows for requests (url) from a table pages (url, final_url, status_code, header, content_bytes, fetched_at).

    Bodies over most_bytes become an error without content; a url that the table lacks is a failed connection. Other status codes
    than 2xx are no errors.
    """
    j = requests.select("url").join(pages, "url", "left")
    size = F.octet_length("content_bytes")
    error = F.when(F.col("fetched_at").isNull(), "connection failed").when(size > cfg.most_bytes, F.concat(F.lit("content too large: "), size, F.lit(" bytes")))
    head = F.decode(F.substring("content_bytes", 1, 64), "ISO-8859-1")
    return j.select("url", F.coalesce("final_url", "url").alias("final_url"), "status_code", F.when(error.isNull(), sniff_type(F.col("header"), head)).otherwise(mime_type(F.col("header"))).alias("content_type"), F.when(error.isNull(), F.col("content_bytes")).alias("content_bytes"), "fetched_at", error.alias("error"))
