"""Links of pages: tags, attributes, base, entities, resolution; redirect targets; the pipeline of stages."""

from __future__ import annotations

import html.entities
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from linkflow.functions import http, urls
from linkflow.session import header, spread
from linkflow.settings import Settings

# The tag and link patterns, which give the links their meaning.
TAG = r"(?is)<(?:((script[^>]*)>[^(</script)]*</script)|((style[^/]*)>[^(</style)]*</style)|(((meta)|(?:\w{1,MAX}))\s+[^>]*)|(!--.*?--))>"
LINK = r"(?is)(\w+)[^>]*?(href|src)\s*=\s*(\"[^\"]+\"|'[^']+')"
#: One-byte charsets: every byte is a character.
ONE_BYTE = r"^(windows|iso|latin|cp1?25|us_ascii|ascii)"


def page_text(body, charset):
    """Text of a body: by a one-byte charset if one is declared, else UTF-8 if valid, else Latin-1."""
    latin = F.decode(body, "ISO-8859-1")
    return F.when(charset.rlike(ONE_BYTE) | ~F.is_valid_utf8(body.cast("string")), latin).otherwise(body.cast("string"))


def pages(crawl_uris: DataFrame) -> DataFrame:
    """``fetch_id, url, html`` of the records whose type allows links and whose extraction is not finished.

    ``html`` has ``?`` for characters outside ASCII, as links get it in any case.
    """
    kind, charset = http.content_type("rep_header", F.col("content_body"))
    crawl_uris = spread(crawl_uris.select("fetch_id", "url", "effective_url", "rep_header", "content_body", "optional_vars"), "fetch_id")
    allowed = crawl_uris.where("content_body is not null and rep_header is not null").withColumn("_kind", kind).where(F.col("_kind").isin(*http.LINK_TYPES))
    finished = F.coalesce(F.try_element_at("optional_vars", F.lit("extraction_finished")), F.lit("")) == "1"
    robots = F.coalesce(F.col("effective_url"), F.col("url")).endswith("robots.txt")
    return allowed.where(~finished & ~robots).select("fetch_id", "url", urls.ascii_only(page_text(F.col("content_body"), charset)).alias("html"))


def limiter(crawl_uris: DataFrame) -> DataFrame:
    """``optional_vars`` with ``extraction_finished`` = "1" where the effective url ends with ``robots.txt``."""
    flag = F.create_map(F.lit("extraction_finished"), F.lit("1"))
    none = F.create_map().cast("map<string,string>")
    own = F.map_filter(F.coalesce("optional_vars", none), lambda k, v: k != "extraction_finished")
    return crawl_uris.withColumn("optional_vars", F.when(F.col("effective_url").endswith("robots.txt"), F.map_concat(own, flag)).otherwise(F.col("optional_vars")))


def _found(max_element: int) -> Column:
    return F.filter(F.regexp_extract_all("html", F.lit(TAG.replace("MAX", str(max_element))), F.lit(5)), lambda x: x != "")


def tags(page: DataFrame, max_element: int = 64) -> DataFrame:
    """``fetch_id, url, pos, tag, element``: open tags with attributes, in order, without meta; ``pos`` counts from 0."""
    return (
        page.select("fetch_id", "url", F.posexplode(_found(max_element)).alias("pos", "tag"))
        .withColumn("element", F.lower(F.regexp_extract("tag", r"^(\w+)", 1)))
        .where("element <> 'meta'")
    )


def _unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        name = m.group(1)
        try:
            if name.startswith("#x"):
                return chr(int(name[2:], 16))
            if name.startswith("#"):
                return chr(int(name[1:]))
        except (ValueError, OverflowError):
            return m.group(0)
        code = html.entities.name2codepoint.get(name)
        return m.group(0) if code is None else chr(code)

    return re.sub(r"&(#?\w+);", one, text, flags=re.ASCII)


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """Entities decoded; unknown ones stay. Links use ``unescape_ascii``, which needs no Python."""
    return text.map(lambda t: t if t is None else _unescape(t))


#: Stands for any character outside ASCII, which links show as ``?``.
_FOREIGN = "\u00a4"


def unescape_ascii(text: Column) -> Column:
    """Entities decoded without leaving the JVM: ASCII characters exactly, all others as one character outside ASCII; unknown ones stay."""
    names = html.entities.name2codepoint
    plain = F.create_map(*[F.lit(x) for n, c in names.items() if c < 128 for x in (n, chr(c))])
    foreign = F.split(F.lit(",".join(n for n, c in names.items() if c >= 128)), ",")  # folded to one literal

    def piece(x: Column) -> Column:
        name = F.regexp_extract(x, r"^(#?\w+);", 1)
        rest = F.substring(x, F.length(name) + 2, F.length(x))
        code = F.when(name.rlike("^#[0-9]{1,7}$"), F.substring(name, F.lit(2), F.length(name)).try_cast("int")).when(
            name.rlike("^#x[0-9A-Fa-f]{1,6}$"), F.conv(F.substring(name, F.lit(3), F.length(name)), 16, 10).try_cast("int")
        )
        known = F.when(code < 128, F.char(code)).when(code <= 0x10FFFF, F.lit(_FOREIGN))
        char = F.coalesce(known, F.try_element_at(plain, name), F.when(F.array_contains(foreign, name), F.lit(_FOREIGN)))
        return F.when((name != "") & char.isNotNull(), F.concat(char, rest)).otherwise(F.concat(F.lit("&"), x))

    parts = F.split(text, "&")
    tail = F.transform(F.slice(parts, 2, F.size(parts)), piece)
    return F.when(text.contains("&"), F.concat(F.get(parts, F.lit(0)), F.array_join(tail, ""))).otherwise(text)


def tag_links(tag: Column) -> Column:
    """Quoted, non-empty href and src values of a tag; those with mailto: or javascript: are left out."""
    quoted = F.regexp_extract_all(unescape_ascii(tag), F.lit(LINK), F.lit(3))
    bare = F.transform(quoted, lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    return F.filter(bare, lambda x: ~x.contains("mailto:") & ~x.contains("javascript:"))


def _based(found: Column, url: Column) -> Column:
    """Each (pos, tag, element, base): the link of the last base element before it, else the page's url.

    Only pages with a base element pay for the fold over their tags.
    """
    kind = "struct<base:string,out:array<struct<pos:int,tag:string,element:string,base:string>>>"
    place = lambda t, base: F.struct(t.pos.alias("pos"), t.tag.alias("tag"), t.element.alias("element"), base.alias("base"))
    start = F.struct(url.alias("base"), F.array().cast("array<struct<pos:int,tag:string,element:string,base:string>>").alias("out")).cast(kind)

    def step(acc: Column, t: Column) -> Column:
        own = F.when(t.element == "base", F.get(tag_links(t.tag), F.lit(0)))
        return F.struct(F.coalesce(own, acc.base).alias("base"), F.array_append(acc.out, place(t, acc.base)).alias("out")).cast(kind)

    folded = F.aggregate(found, start, step, lambda acc: acc.out)
    return F.when(F.exists(found, lambda t: t.element == "base"), folded).otherwise(F.transform(found, lambda t: place(t, url)))


def html_links(page: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``fetch_id, url, pos, k, raw, link``: the links of ``a`` elements, resolved; ``pos`` and ``k`` give their order."""
    found = F.transform(_found(settings.max_element), lambda t, i: F.struct(i.alias("pos"), t.alias("tag"), F.lower(F.regexp_extract(t, r"^(\w+)", 1)).alias("element")))
    wanted = F.filter(found, lambda t: t.element.isin("a", "base"))
    one = page.select("fetch_id", "url", wanted.alias("_t")).select("fetch_id", "url", F.explode(_based(F.col("_t"), F.col("url"))).alias("t")).where("t.element = 'a'")
    links = one.select("fetch_id", "url", "t.pos", "t.base", F.posexplode(tag_links(F.col("t.tag"))).alias("k", "raw"))
    return links.select("fetch_id", "url", "pos", "k", urls.ascii_only(F.col("raw")).alias("raw"), urls.ascii_only(urls.resolve(F.col("base"), F.col("raw"))).alias("link"))


def redirect_links(crawl_uris: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``fetch_id, url, pos, k, raw, link``: the target of each 3xx record with a Location; ``pos`` is after all tags."""
    found = crawl_uris.where(F.col("status_code").between(300, 399)).withColumn("raw", header("rep_header", "location")).where("raw is not null")
    out = found.select("fetch_id", "url", F.lit(2**30).alias("pos"), F.lit(0).alias("k"), "raw", urls.resolve(F.col("url"), F.col("raw")).alias("link"))
    return out.where(~F.col("link").isin(*settings.not_found_redirects)) if settings.not_found_redirects else out


def scope(links: DataFrame, settings: Settings) -> DataFrame:
    """Links that match any positive and no negative pattern from their start; without positive patterns none is kept."""
    keep = F.lit(False)
    for p in settings.scope_positive:
        keep = keep | F.col("link").rlike(f"^(?:{p})")
    for p in settings.scope_negative:
        keep = keep & ~F.col("link").rlike(f"^(?:{p})")
    return links.where(keep)


def clean(links: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Links without session ids, then without anchors and one trailing mark."""
    return links.withColumn("link", urls.cleanup(urls.strip_sessions(F.col("link")), settings.remove_anchors))


def pipeline(crawl_uris: DataFrame, settings: Settings, stages=()) -> DataFrame:
    """All links of records in the fixed order of stages: limiter, page links, redirects, own ``stages``, scope, sessions, cleanup.

    ``stages``: functions from links to links (``fetch_id, url, pos, k, raw, link``).
    """
    links = html_links(pages(limiter(crawl_uris)), settings).unionByName(redirect_links(crawl_uris, settings))
    for stage in stages:
        links = links.transform(stage)
    return links.transform(lambda x: scope(x, settings)).transform(lambda x: clean(x, settings))


def new_links(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Distinct ``link`` of more than five characters that is not among ``known`` (``url``); compared by hash."""
    fresh = links.where(F.length("link") > 5).select("link").distinct()
    if known is None:
        return fresh
    seen = known.select(F.sha1("url").alias("_h")).distinct()
    return fresh.withColumn("_h", F.sha1("link")).join(seen, "_h", "left_anti").drop("_h")


def extracted_urls(links: DataFrame) -> DataFrame:
    """``fetch_id, extracted_urls``: a record's links in order, joined by line ends."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "k", "link")))
    return links.groupBy("fetch_id").agg(F.array_join(F.transform(ordered, lambda x: x.link), "\n").alias("extracted_urls"))
