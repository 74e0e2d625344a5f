"""Fetching requests: a pluggable transport inside ``mapInPandas``, and a web simulated by a table."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkflow.settings import Settings

FETCHED = "url string, effective_url string, current_priority int, status_code int, rep_header map<string,string>, content_body binary, req_time double, error string"
#: Status of a fetch that failed without a response.
FAILED = 710
Transport = Callable[[dict, Settings], tuple[int, dict, bytes | None]]


def http_transport(request: dict, settings: Settings) -> tuple[int, dict, bytes | None]:
    """One GET by the standard library; redirects are not followed unless set."""

    class NoRedirect(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, *args):
            return super().redirect_request(*args) if settings.follow_redirects else None

    handlers: list = [NoRedirect()]
    if settings.proxy:
        handlers.append(urllib.request.ProxyHandler({"http": settings.proxy, "https": settings.proxy}))
    call = urllib.request.Request(request["effective_url"], headers={"User-Agent": settings.user_agent, **(request["req_header"] or {})})
    try:
        with urllib.request.build_opener(*handlers).open(call, timeout=settings.request_timeout) as r:
            return r.status, dict(r.headers.items()), r.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers.items()), None if e.code == 304 else e.read()


def fetch(requests: DataFrame, transport: Transport = http_transport, settings: Settings = Settings()) -> DataFrame:
    """Results of requests (``url, effective_url, current_priority, req_header``); a failed one has status 710 and an ``error``."""

    def one(r: dict) -> tuple:
        start = time.monotonic()
        try:
            status, headers, body = transport(r, settings)
            error = None
        except Exception as e:  # noqa: BLE001 - one bad url must not end the task
            status, headers, body, error = FAILED, None, None, repr(e)
        return r["url"], r["effective_url"], r["current_priority"], status, headers, body, time.monotonic() - start, error

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(settings.fetch_concurrency) as pool:
            for f in frames:
                rows = f.assign(req_header=[None if h is None else dict(h) for h in f["req_header"]]).to_dict("records")
                yield pd.DataFrame(list(pool.map(one, rows)), columns=[c.split()[0] for c in FETCHED.split(", ")])

    return requests.select("url", "effective_url", "current_priority", "req_header").mapInPandas(run, FETCHED)


def simulated(requests: DataFrame, web: DataFrame) -> DataFrame:
    """Results from a table ``url, status_code, rep_header, content_body, req_time`` in place of the net; unknown urls get 404."""
    pages = web.select("url", "status_code", "rep_header", "content_body", "req_time")
    return requests.join(pages, "url", "left").select(
        "url", "effective_url", "current_priority", F.coalesce("status_code", F.lit(404)).alias("status_code"), "rep_header", "content_body", F.coalesce("req_time", F.lit(0.0)).alias("req_time"), F.lit(None).cast("string").alias("error")
    )
