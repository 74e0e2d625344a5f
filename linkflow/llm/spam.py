"""Keyword-stuffed pages, link lists and tag lists (problem 5).

A page's main body, without the site's frame, is split into its sentences and the rest:
lines with few sentence ends for their length. The rest is cut into blocks of one size,
whatever the page's length; each block is compressed, and its ratio is divided by the
ratio that prose of that length and language has. A block is extremely redundant below a
bound that one in a hundred blocks of prose lies below. A page is a case if such blocks,
confirmed by their low density of sentence ends, hold most of the main body's text. There
is no least length: a page of few words is judged like one of many blocks.

Links keep their tags in the blocks, which makes lists of short links redundant. The
blocks are judged a second time with every linked word written as the same word, as linked
words are no running text: so a list of links is redundant although its headlines all
differ. As an article may have a long list of references, the second way counts only if
the main body has no line of sentences and next to no line but links.

Null and empty bodies, and bodies without text, are no case. Repeated rows are judged
each on its own.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from linkflow.llm.pages import Cache, charset_of, codec_of, decode, html_pages, look, main_block, parse, visible

#: Characters of a block; the rest of a page is cut into equal parts of about that size.
BLOCK = 1_000
#: A block below this times the ratio of prose is extremely redundant: the first percentile of prose blocks from 60 to
#: 1,000 characters is 0.85 to 0.90 times their median. Table rows repeat their form anyhow and have a bound of their own.
EXTREME, ROWS = 0.88, 0.75
#: Share of the main body's text that extremely redundant blocks must have, as they stand and with linked words alike.
SHARE, LINKED = 0.65, 0.95
#: Sentence ends per 1000 characters; prose has 3 and more.
SENTENCES = 2.4

# Frequent function words by language; a and b of the ratio exp(a) * n ** -b that prose of n characters has (median of article text, 60 to 1,000 characters).
LANGUAGES = {
    "en": (frozenset("the of and in was by that for".split()), 1.058, 0.246),
    "de": (frozenset("die der und das wird ist den wurde".split()), 1.160, 0.256),
    "fr": (frozenset("la le de fut une des sera été".split()), 1.263, 0.286),
    "es": (frozenset("la el de fue una del será los".split()), 1.285, 0.291),
    "pt": (frozenset("foi da na em pela uma do será".split()), 1.384, 0.310),
    "pl": (frozenset("jest w na pod że się została nad".split()), 1.429, 0.314),
}
_OF_WORD = {w: [k for k, v in LANGUAGES.items() if w in v[0]] for v in LANGUAGES.values() for w in v[0]}
END = re.compile("[.!?…](?=[\\s”“»«\"')\\]]|$)")
WORD = re.compile(r"[^\W\d_]+")
_NO_LINK = re.compile(r"(?i)<(?!/?a\b)[^>]*>")
_LINKED = re.compile(r"(?is)<a\b[^>]*>(.*?)(?:</a\s*>|$)")


def language(text: str) -> str:
    """Language with most function words in ``text``; English if none has one among twenty words."""
    words = WORD.findall(text.lower())
    count = Counter(k for w in words if w in _OF_WORD for k in _OF_WORD[w])
    best = max(LANGUAGES, key=lambda k: (count[k], k == "en"))
    return best if count[best] * 20 >= len(words) else "en"


def redundancy(text: str, lang: str) -> float:
    """Compression ratio of a block over the ratio of prose; about 1 for prose, lower is more redundant; 1 for an empty one."""
    raw = text.encode("utf-8", "replace")
    if not raw:
        return 1.0
    _, a, b = LANGUAGES[lang]
    return len(zlib.compress(raw, 6)) / len(raw) / (math.exp(a) * len(raw) ** -b)


def with_links(raw: str) -> str:
    """Visible text of a line in which the tags of links stay."""
    return " ".join(html.unescape(_NO_LINK.sub(" ", raw)).split())


def unlinked(raw: str) -> str:
    """Visible text of a line with every linked word written as ``link``."""
    return visible(_LINKED.sub(lambda m: " " + "link " * len(visible(m.group(1)).split()), raw))


def cut(text: str, size: int = BLOCK) -> list[str]:
    """``text`` in equal parts of about ``size`` characters; nothing is left out."""
    n = max(1, round(len(text) / size))
    step = max(1, -(-len(text) // n))
    return [text[i : i + step] for i in range(0, len(text), step)]


def kinds(block) -> list[tuple[str, str, str, bool]]:
    """Of each line of a main block the visible text, that with links, that without linked words, and whether it is a row of several cells."""
    return [(x.text, *((with_links(x.raw), unlinked(x.raw)) if "<a" in x.raw or "<A" in x.raw else (x.text, x.text)), x.own.startswith("tr>td>td")) for x in block]


def judge(lines: list[tuple[str, str, str, bool]]) -> tuple[int, float, float, bool]:
    """Characters, redundancy and sentence ends per 1000 characters of the most redundant block, and the verdict.

    Texts without characters give ``(0, 1, 0, False)``.
    """
    n = sum(len(t) for t, _, _, _ in lines)
    if not n:
        return 0, 1.0, 0.0, False
    rest: dict[bool, list[tuple[str, str, str]]] = {False: [], True: []}
    ends, links, sentences = 0, 0, False
    for text, linked, plain, row in lines:
        e = len(END.findall(plain))
        ends += e
        if e * 1000 < SENTENCES * max(1, len(plain)):
            rest[row].append((text, linked, plain))
            links += len(text) if set(plain.split()) == {"link"} else 0
        else:
            sentences = True
    worst, density, heavy = 1.0, ends * 1000 / n, [0.0, 0.0]
    for row, some in rest.items():
        shown = sum(len(t) for t, _, _ in some)
        ways = ["\n".join(x[1] for x in some), "\n".join(x[2] for x in some)]
        for way, whole in enumerate(ways if ways[0] != ways[1] else ways[:1]):
            for block in cut(whole):
                ratio = redundancy(block, language(block))
                e = len(END.findall(block)) * 1000 / len(block)
                if ratio < worst and not way:
                    worst, density = ratio, e
                if ratio < (ROWS if row else EXTREME) and e < SENTENCES:
                    heavy[way] += shown * len(block) / len(whole)
    return n, worst, density, heavy[0] >= SHARE * n or not sentences and min(heavy[1], links) >= LINKED * n


def is_spam(lines, parent, name) -> bool:
    """Verdict for a parsed page."""
    return judge(kinds(main_block(lines, parent, name)[1]))[3]


def score_spam(pages: DataFrame) -> DataFrame:
    """``fetch_id, n_chars, redundancy, sentence_ends, spam`` of pages (``fetch_id, charset, content_body``); one narrow stage."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        see = Cache(look)
        for f in frames:
            rows = []
            for fetch_id, charset, body in zip(f["fetch_id"], f["charset"], f["content_body"], strict=True):
                codec = codec_of(charset) if charset else charset_of(body, None)
                page = parse(decode(body, codec), see)
                rows.append((fetch_id, *judge(kinds(main_block(*page)[1]))))
            yield pd.DataFrame(rows, columns=["fetch_id", "n_chars", "redundancy", "sentence_ends", "spam"])

    return pages.select("fetch_id", "charset", "content_body").mapInPandas(run, "fetch_id long, n_chars long, redundancy double, sentence_ends double, spam boolean")


def spam_pages(crawl_uris: DataFrame) -> DataFrame:
    """``fetch_id`` of the HTML pages that are keyword, link or tag lists."""
    return score_spam(html_pages(crawl_uris)).where("spam").select("fetch_id")
