"""Lines that stand on many pages of one site (problem 6).

Every visible line of a page is reduced to its ASCII letters, case aside, and cut into
tokens of four letters: two lines with the same letters get the same tokens, whatever
stands between the letters. The tokens are sorted into a tree of fixed depth per site
(number of tokens, first two tokens, last token); the slots in between are wildcards, so
a leaf is a template. Trees are counted per partition and merged by adding. A template on
fewer than five pages can hold no line on five, so its lines are dropped; the rest is
counted exactly, per line and url, spread by (line, url) so that no line gets one task.

Pages without visible lines, and lines without an ASCII letter, give nothing. A page that
was fetched again counts once, as its url is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkflow.llm.pages import Cache, charset_of, codec_of, decode, html_pages, look, parse
from linkflow.session import fits, materialize

MIN_URLS = 5
TOKEN = 4
#: Keys (8 bytes each) up to which they are broadcast; the number is counted first.
BROADCAST_KEYS = 1_000_000

_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_REST = bytes(i for i in range(256) if i not in _LETTERS)
_SIGN = 1 << 63


def letters(text: str) -> bytes:
    """ASCII letters of a visible text in lower case."""
    return text.encode("ascii", "ignore").translate(None, _REST).lower()


def template_path(key: bytes) -> bytes:
    """Path of a line in the token tree: number of tokens, first two tokens, last token."""
    n = -(-len(key) // TOKEN)
    return b"%d/" % n + key[: 2 * TOKEN] + b"/" + key[(n - 1) * TOKEN :]


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= _SIGN else h


LINES = "fetch_id long, line_no int, url_hash long, node long, line long"


def page_lines(pages: DataFrame) -> DataFrame:
    """``fetch_id, line_no, url_hash, node, line`` per visible line with a letter.

    ``node`` and ``line`` are 64-bit hashes of site and template path, and of site and
    letters. Lines that repeat within a partition are parsed once.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        see = Cache(look)
        keys = Cache(lambda t: ((k := letters(t)), template_path(k)))
        digest = xxhash.xxh3_64_intdigest
        for f in frames:
            ids, numbers, urls, nodes, lines = [], [], [], [], []
            for fetch_id, url, site, charset, body in zip(f["fetch_id"], f["url"], f["site"], f["charset"], f["content_body"], strict=True):
                text = decode(body, codec_of(charset) if charset else charset_of(body, None))
                name = site.encode() + b"\n"
                u = _signed(digest(url))
                for x in parse(text, see)[0]:
                    key, path = keys[x.text]
                    if key:
                        ids.append(fetch_id)
                        numbers.append(x.n)
                        urls.append(u)
                        nodes.append(digest(name + path))
                        lines.append(digest(name + key))
            yield pd.DataFrame(
                {
                    "fetch_id": np.array(ids, np.int64),
                    "line_no": np.array(numbers, np.int32),
                    "url_hash": np.array(urls, np.int64),
                    "node": np.array(nodes, np.uint64).view(np.int64),
                    "line": np.array(lines, np.uint64).view(np.int64),
                }
            )

    return pages.select("fetch_id", "url", "site", "charset", "content_body").mapInPandas(run, LINES)


def _keep(lines: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of ``lines`` whose key is among ``keys``: by broadcast if there are few, else by a join that AQE may split."""
    keys = materialize(keys)
    return lines.join(F.broadcast(keys) if fits(keys, BROADCAST_KEYS) else keys, on, "left_semi")


def repeated_lines(pages: DataFrame, min_urls: int = MIN_URLS) -> DataFrame:
    """``fetch_id, line_no`` of the lines that stand on at least ``min_urls`` different urls of the page's site."""
    lines = materialize(page_lines(pages))
    nodes = lines.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_urls).select("node")
    some = _keep(lines, nodes, "node")
    exact = some.select("line", "url_hash").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_urls).select("line")
    return _keep(lines, exact, "line").select("fetch_id", "line_no")


def templates(pages: DataFrame, min_urls: int = MIN_URLS) -> DataFrame:
    """``site, template, n_lines, n_urls`` of the merged trees' leaves on at least ``min_urls`` urls.

    ``template``: the letters that all lines of the leaf begin and end with, a wildcard
    between them if lines differ.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        see = Cache(look)
        for f in frames:
            rows = []
            for url, site, charset, body in zip(f["url"], f["site"], f["charset"], f["content_body"], strict=True):
                got = {}
                for x in parse(decode(body, codec_of(charset) if charset else charset_of(body, None)), see)[0]:
                    if key := letters(x.text):
                        p = template_path(key).decode()
                        k = key.decode()
                        n, lo, hi = got.get(p, (0, k, k))
                        got[p] = (n + 1, min(lo, k), max(hi, k))
                rows += [(site, url, p, *v) for p, v in got.items()]
            yield pd.DataFrame(rows, columns=["site", "url", "path", "n", "lo", "hi"])

    found = pages.select("url", "site", "charset", "content_body").mapInPandas(run, "site string, url string, path string, n long, lo string, hi string")
    per_url = found.groupBy("site", "path", "url").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    leaf = per_url.groupBy("site", "path").agg(F.sum("n").alias("n_lines"), F.count(F.lit(1)).alias("n_urls"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    head = F.substring_index(F.substring_index("path", "/", -2), "/", 1)
    text = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.concat(head, F.lit("*"), F.substring_index("path", "/", -1)))
    return leaf.where(F.col("n_urls") >= min_urls).select("site", text.alias("template"), "n_lines", "n_urls")


def without_repeats(crawl_uris: DataFrame, min_urls: int = MIN_URLS) -> DataFrame:
    """``fetch_id, n_removed, text``: visible text of each HTML page without the repeated lines of its site."""
    pages = html_pages(crawl_uris)
    gone = repeated_lines(pages, min_urls).groupBy("fetch_id").agg(F.collect_list("line_no").alias("gone"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        see = Cache(look)
        for f in frames:
            rows = []
            for fetch_id, charset, body, drop in zip(f["fetch_id"], f["charset"], f["content_body"], f["gone"], strict=True):
                cut = set() if drop is None else set(drop)
                kept = [x.text for x in parse(decode(body, codec_of(charset) if charset else charset_of(body, None)), see)[0] if x.n not in cut]
                rows.append((fetch_id, len(cut), "\n".join(kept)))
            yield pd.DataFrame(rows, columns=["fetch_id", "n_removed", "text"])

    return pages.select("fetch_id", "charset", "content_body").join(gone, "fetch_id", "left").mapInPandas(run, "fetch_id long, n_removed long, text string")


def repeated_lines_of_crawl(crawl_uris: DataFrame) -> DataFrame:
    """``fetch_id, line_no`` of the repeated lines of all HTML pages."""
    return repeated_lines(html_pages(crawl_uris))
