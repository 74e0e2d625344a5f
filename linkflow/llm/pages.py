"""HTML pages of a crawl: selection, charset, lines and their place in the document.

The Spark side selects the pages and prunes the columns; the Python side turns one body
into lines with visible text and open elements. Lines are looked at whole and never cut.
"""

from __future__ import annotations

import codecs
import html
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkflow.session import header, site, spread

HTML_TYPES = ("text/html", "application/xhtml+xml")


def html_pages(crawl_uris: DataFrame) -> DataFrame:
    """``fetch_id, url, site, charset, content_body`` of the HTML pages.

    An HTML page has status 200 and Content-Type ``text/html`` or
    ``application/xhtml+xml``. ``charset`` is the header's, null if it has none. Rows
    whose body is null are left out: they have no lines.
    """
    kind = header("rep_header", "content-type")
    found = (
        crawl_uris.where((F.col("status_code") == 200) & F.col("content_body").isNotNull() & F.col("rep_header").isNotNull())
        .select("fetch_id", "url", "content_body", kind.alias("_kind"))
        .where(F.lower(F.trim(F.substring_index("_kind", ";", 1))).isin(*HTML_TYPES))
        .select(
            "fetch_id",
            "url",
            site(F.col("url")).alias("site"),
            F.nullif(F.lower(F.regexp_extract("_kind", r"(?i)charset\s*=\s*[\"']?([^\s;\"']+)", 1)), F.lit("")).alias("charset"),
            "content_body",
        )
    )
    return spread(found, "fetch_id")


META = re.compile(rb"<meta[^>]*charset\s*=\s*[\"']?\s*([A-Za-z0-9_:.-]+)", re.I)


def _latin_rest(e):
    """Bytes without a character become the control characters of the same number, as browsers have it."""
    if isinstance(e, UnicodeDecodeError):
        return e.object[e.start : e.end].decode("latin-1"), e.end
    raise e


codecs.register_error("linkflow-latin", _latin_rest)


@lru_cache(4096)
def codec_of(name: str | None) -> str:
    """Python codec of a charset label; Latin-1 is read as windows-1252, an unknown label as UTF-8."""
    try:
        known = codecs.lookup((name or "utf-8").strip()).name
    except (LookupError, ValueError):
        return "utf-8"
    return "cp1252" if known in ("iso8859-1", "ascii") else known


def charset_of(body: bytes, declared: str | None) -> str:
    """Charset of a page: the header's, else the meta element's, else UTF-8."""
    if declared:
        return codec_of(declared)
    found = META.search(body)
    return codec_of(found.group(1).decode("ascii")) if found else "utf-8"


def decode(body: bytes, codec: str) -> str:
    """Text of a body; bytes that the charset lacks become U+FFFD in UTF-8 and control characters in one-byte charsets."""
    return body.decode(codec, "replace" if codec.startswith("utf") else "linkflow-latin")


TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)[^>]*>")
ANY_TAG = re.compile(r"<[^>]*>")
SPACED = re.compile(r"(?i)</?(?:td|th|br|li|p|div|option)\b[^>]*>")
HIDDEN = re.compile(r"(?is)<script\b.*?(?:</script\s*>|$)|<style\b.*?(?:</style\s*>|$)|<!--.*?(?:-->|$)")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a b i em strong u s small sub sup br img code q cite abbr mark".split())


def visible(line: str) -> str:
    """Visible text of a line without hidden parts: tags gone, entities decoded, white space single."""
    if "<" in line:
        line = ANY_TAG.sub("", SPACED.sub(" ", line))
    if "&" in line:
        line = html.unescape(line)
    return " ".join(line.split())


def body_lines(text: str) -> list[tuple[int, str]]:
    """``(line number, raw line)`` of the lines inside the body element; hidden parts are cut out, also if they span lines."""
    lines = text.split("\n")
    out, inside, until = [], False, ""
    for n, raw in enumerate(lines, 1):
        if until:
            at = raw.lower().find(until)
            if at < 0:
                continue
            raw, until = raw[at + len(until) :], ""
        if not inside:
            at = raw.lower().find("<body")
            if at < 0:
                continue
            inside, raw = True, raw[at:]
        if "<!" in raw or "<s" in raw or "<S" in raw:
            low = raw.lower()
            for start, end in (("<script", "</script>"), ("<style", "</style>"), ("<!--", "-->")):
                at = low.rfind(start)
                if at >= 0 and low.find(end, at) < 0:
                    until = end
            raw = HIDDEN.sub(" ", raw)
        if "</body" in raw:
            raw = raw[: raw.find("</body")]
            out.append((n, raw))
            break
        out.append((n, raw))
    return out


@lru_cache(50_000)
def _shape(tags: str) -> tuple[tuple[str, ...], tuple[str, ...], str]:
    """Of a line's tags: elements it closes from outside, elements it leaves open, innermost block elements it holds."""
    closed, stack, held = [], [], []
    for t in tags.split():
        name = t.lstrip("/")
        if t[0] == "/":
            if name in stack:
                while stack.pop() != name:
                    pass
            else:
                closed.append(name)
        elif name not in VOID:
            stack.append(name)
            held.append(name)
        else:
            held.append(name)
    return tuple(closed), tuple(stack), ">".join(held[:4])


def tag_signature(raw: str) -> str:
    """Tags of a line in lower case, closing ones with a slash."""
    return " ".join([s + t for s, t in TAG.findall(raw)]).lower() if "<" in raw else ""


class Line:
    """A line with visible text: number, raw, text, open elements around it, its own elements, container, containers it opens as a paragraph."""

    __slots__ = ("n", "raw", "text", "path", "own", "box", "opens")

    def __init__(self, n, raw, text, path, own, box, opens=()):
        self.n, self.raw, self.text, self.path, self.own, self.box, self.opens = n, raw, text, path, own, box, opens


class Cache(dict):
    """``f(key)`` kept for up to ``size`` keys, then begun anew: repeated lines of a site are parsed once, memory stays bounded."""

    def __init__(self, f, size=40_000):
        super().__init__()
        self.f, self.size = f, size

    def __call__(self, key):
        return self[key]

    def __missing__(self, key):
        if len(self) >= self.size:
            self.clear()
        got = self[key] = self.f(key)
        return got


def look(raw: str) -> tuple[str, tuple, tuple, str]:
    """Visible text and tag shape of a raw line."""
    return (visible(raw), *_shape(tag_signature(raw)))


def parse(text: str, see=look) -> tuple[list[Line], list[int], list[str]]:
    """Lines of a page that have visible text, in order; parent and name of each container (0: the document).

    ``see``: ``look`` or a ``Cache`` of it.
    """
    out: list[Line] = []
    stack: list[int] = [0]
    parent, name = [0], [""]
    path = ""
    for n, raw in body_lines(text):
        seen, closed, opened, own = see(raw)
        if seen:
            # beside text and inline elements only, what stays open is a paragraph that goes on
            goes_on = opened and all(o in INLINE or o in opened for o in own.split(">"))
            out.append(Line(n, raw, seen, path, own, stack[-1], range(len(name), len(name) + len(opened)) if goes_on else ()))
        if closed or opened:
            for c in closed:
                for k in range(len(stack) - 1, 0, -1):
                    if name[stack[k]] == c:
                        del stack[k:]
                        break
            for o in opened:
                parent.append(stack[-1])
                name.append(o)
                stack.append(len(name) - 1)
            path = "/".join([name[k] for k in stack[1:]])
    return out, parent, name


#: Elements that structure an article and do not set a part of the page apart. A cell that stays open over lines is layout, not among them.
FLOW = frozenset("ul ol li table tbody tr blockquote p dl dd dt figure".split())


def main_block(lines: list[Line], parent: list[int], name: list[str]) -> tuple[int, list[Line]]:
    """Index of the headline (first h1 or h2; -1: none) and the lines after it in its container.

    Lists, tables and quotations inside the container belong to it, and so do elements
    that a line with text opens (a div used as a paragraph); boxes of their own do not.
    Without a headline the container with most text is taken.
    """
    at = next((i for i, x in enumerate(lines) if x.own.startswith(("h1", "h2"))), -1)
    paragraphs = {k for x in lines for k in x.opens}

    def home(box: int) -> int:
        while name[box] in FLOW or box in paragraphs:
            box = parent[box]
        return box

    if at >= 0:
        box = home(lines[at].box)
        return at, [x for x in lines[at + 1 :] if home(x.box) == box]
    size: dict[int, int] = {}
    for x in lines:
        size[home(x.box)] = size.get(home(x.box), 0) + len(x.text)
    if not size:
        return -1, []
    box = max(size, key=lambda b: (size[b], -b))
    return -1, [x for x in lines if home(x.box) == box]
