"""Text read in a wrong encoding: find it, and restore it where possible (problem 3).

A hidden Markov model labels the characters of a text with one clean state and one state
per encoding pair (text written as UTF-8 and read as the state's charset). Observed are
the runs of characters outside ASCII; ASCII between them says nothing and is free. In a
pair's state a run is likely if its bytes in that charset are well-formed UTF-8 of
plausible characters; in the clean state such a run is very unlikely. Viterbi gives the
labels, and each labelled span gets its state's inverse transform, which must decode
strictly. This repeats for text that went through the mistake more than once. U+FFFD
marks text that is lost: it is found but cannot be restored.

Null and empty texts have no spans. Every text is looked at whole.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkflow.llm.pages import charset_of, codec_of, decode, html_pages

#: Charsets that UTF-8 text was read in, one state each; where a charset lacks a byte, the control character of its number stands for it.
PAIRS = ("cp1252", "latin-1", "iso8859-15", "cp1250", "cp1251", "cp437", "cp850", "mac_roman")
ROUNDS = 3
LOST = "�"

# Log probabilities of the model.
_STAY, _LEAVE, _ENTER, _SWITCH = math.log(0.98), math.log(1e-2), math.log(1e-4), math.log(1e-6)
_FITS, _MISFITS = math.log(0.4), math.log(1e-5)
_PATTERN_CLEAN, _RARE_PATTERN_CLEAN = math.log(1e-7), math.log(1e-3)
_LETTER, _SYMBOL, _CONTROL, _NEXT = math.log(0.3), math.log(0.05), math.log(1e-4), math.log(0.3)


@lru_cache(4096)
def _byte(char: str, pair: str) -> int:
    """Byte of a character in a charset, -1 if it has none; a control character is the byte that the charset lacks, as ``decode`` reads it."""
    try:
        return char.encode(pair)[0]
    except UnicodeEncodeError:
        k = ord(char)
        return k if 0x80 <= k <= 0x9F and (pair == "cp1252" or bytes([k]).decode(pair, "linkflow-latin") == char) else -1


def _bytes(run: str, pair: str) -> bytes | None:
    got = [_byte(c, pair) for c in run]
    return None if -1 in got else bytes(got)


def _plausible(char: str) -> int:
    """2: Latin letters, punctuation, signs; 1: other scripts in use; 0: neither."""
    k = ord(char)
    if 0xA0 <= k < 0x250 or 0x2010 <= k < 0x2300 or k == 0xFFFD:
        return 2
    if 0x80 <= k < 0xA0 or not char.isprintable():
        return 1 if k < 0xA0 else 0
    return 1 if 0x370 <= k < 0x530 or 0x5D0 <= k < 0x600 or 0x620 <= k < 0x650 or 0x3040 <= k < 0xA000 or k in range(0x2500, 0x25A0) else 0


@lru_cache(20_000)
def _read(run: str, pair: str) -> tuple[int, int, int]:
    """Characters of a run that are well-formed under a pair; groups that give plausible and that give rare characters."""
    fits = plain = rare = i = 0
    values = [_byte(c, pair) for c in run]
    while i < len(run):
        b = values[i]
        n = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 0
        if n and i + n <= len(run) and all(0x80 <= x <= 0xBF for x in values[i + 1 : i + n]):
            try:
                kind = _plausible(bytes(values[i : i + n]).decode("utf-8"))
            except UnicodeDecodeError:
                kind = 0
            if kind:
                fits, plain, rare, i = fits + n, plain + (kind == 2), rare + (kind == 1), i + n
                continue
        i += 1
    return fits, plain, rare


@lru_cache(20_000)
def _emissions(run: str) -> tuple[float, ...] | None:
    """Log probability of a run in the clean state and in each pair's; None if no pair explains a part of it."""
    reads = [_read(run, p) for p in PAIRS]
    if not any(f for f, _, _ in reads):
        return None
    clean = 0.0
    for c in run:
        kind = unicodedata.category(c)
        clean += _LETTER if kind[0] in "LP" else _CONTROL if kind in ("Cc", "Co", "Cn") else _SYMBOL
    clean += _NEXT * (len(run) - 1)
    clean += _PATTERN_CLEAN * min(3, max(p for _, p, _ in reads)) + _RARE_PATTERN_CLEAN * min(3, max(r for _, p, r in reads if p == max(q for _, q, _ in reads)))
    return (clean, *(_FITS * f + _MISFITS * (len(run) - f) for f, _, _ in reads))


RUN = re.compile(r"[^\x00-\x7f]{2,}")
_SINGLE = math.log(0.3)
_ONE = re.compile(r"[^\x00-\x7f]+")


def label(text: str) -> list[tuple[int, int, str]]:
    """Viterbi: ``(start, end, pair)`` of the runs that get a pair's state, in order."""
    if not any(_emissions(x) for x in set(RUN.findall(text))):
        return []
    runs = [(m.start(), m.end(), m.group()) for m in _ONE.finditer(text)]
    k = len(PAIRS) + 1
    score = [0.0] + [_ENTER] * (k - 1)
    back = []
    for _, _, run in runs:
        e = _emissions(run) or (_SINGLE * len(run), *[_MISFITS * len(run)] * (k - 1))
        best = max(range(1, k), key=score.__getitem__)
        came, now = [], []
        for s in range(k):
            options = [(score[s] + _STAY, s)]
            if s:
                options += [(score[0] + _ENTER, 0), (score[best] + _SWITCH, best)]
            else:
                options.append((score[best] + _LEAVE, best))
            top = max(options, key=lambda o: o[0])
            now.append(top[0] + e[s])
            came.append(top[1])
        score = now
        back.append(came)
    s = max(range(k), key=score.__getitem__)
    states = []
    for came in reversed(back):
        states.append(s)
        s = came[s]
    states.reverse()
    return [(a, b, PAIRS[s - 1]) for (a, b, _), s in zip(runs, states, strict=True) if s]


def invert(run: str, pair: str) -> str | None:
    """A labelled span in its original characters; None if it does not decode."""
    raw = _bytes(run, pair)
    try:
        return raw.decode("utf-8") if raw else None
    except UnicodeDecodeError:
        return None


def restore(text: str | None) -> tuple[str | None, int, int, str]:
    """Restored text, number of restored spans, of lost characters, and the pairs in use.

    Null gives ``(None, 0, 0, "")``. Spans that do not decode stay as they are.
    """
    if not text or text.isascii():
        return text, 0, 0, ""
    spans, pairs = 0, []
    for _ in range(ROUNDS):
        out, at, done = [], 0, 0
        for a, b, pair in label(text):
            got = invert(text[a:b], pair)
            if got is not None:
                out += [text[at:a], got]
                at, done = b, done + 1
                if pair not in pairs:
                    pairs.append(pair)
        if not done:
            break
        text = "".join([*out, text[at:]])
        spans += done
    return text, spans, text.count(LOST), ",".join(pairs)


def damaged(text: str) -> bool:
    """Whether a text has lost characters or a span that the model labels and that decodes."""
    return not text.isascii() and (LOST in text or any(invert(text[a:b], p) is not None for a, b, p in label(text)))


REPAIRED = "fetch_id long, field string, restored string, spans long, lost long, pairs string"


def repair_bodies(pages: DataFrame) -> DataFrame:
    """``fetch_id, field, restored, spans, lost, pairs`` of the damaged bodies among pages (``fetch_id, charset, content_body``).

    ``restored`` is the whole body, decoded by the page's charset, its entities outside
    ASCII decoded too.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for fetch_id, charset, body in zip(f["fetch_id"], f["charset"], f["content_body"], strict=True):
                text = decode(body, codec_of(charset) if charset else charset_of(body, None))
                if "&" in text:
                    text = html.unescape(text)
                if damaged(text):
                    rows.append((fetch_id, "content_body", *restore(text)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in REPAIRED.split(", ")])

    return pages.select("fetch_id", "charset", "content_body").mapInPandas(run, REPAIRED)


def repair_headers(crawl_uris: DataFrame) -> DataFrame:
    """The same for header values: one row per record with a damaged value; ``restored`` joins its values by line ends.

    Records whose values are all ASCII are left out before any Python runs.
    """
    odd = crawl_uris.where(F.exists(F.map_values("rep_header"), lambda v: v.rlike(r"[^\x00-\x7f]")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for fetch_id, values in zip(f["fetch_id"], f["v"], strict=True):
                bad = [restore(v) for v in values if v and damaged(v)]
                if bad:
                    rows.append((fetch_id, "rep_header", "\n".join(b[0] for b in bad), sum(b[1] for b in bad), sum(b[2] for b in bad), ",".join(sorted({b[3] for b in bad} - {""}))))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in REPAIRED.split(", ")])

    return odd.select("fetch_id", F.map_values("rep_header").alias("v")).mapInPandas(run, REPAIRED)


def repair(crawl_uris: DataFrame) -> DataFrame:
    """Damaged bodies of HTML pages and damaged header values of all records, with their restored text."""
    return repair_bodies(html_pages(crawl_uris)).unionByName(repair_headers(crawl_uris))


def damaged_fields(crawl_uris: DataFrame) -> DataFrame:
    """``fetch_id, field`` of the records with damaged text."""
    return repair(crawl_uris).select("fetch_id", "field")
