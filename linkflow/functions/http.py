"""HTTP functions as Columns: dates, content types, request headers, outcome classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkflow.session import header

# Content types whose pages are searched for links, and day names.
LINK_TYPES = ("text/html", "application/xhtml", "text/vnd.wap.wml", "application/vnd.wap.wml", "application/vnd.wap.xhtm")
LAST_SECOND = 253_402_300_799
DAYS = ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")


def http_date(value: Column) -> Column:
    """Epoch seconds of a date in the standard header form, else null (other forms: ``operators.timestamps``)."""
    standard = value.rlike(r"^[A-Z][a-z]{2}, [0-9]{2} [A-Z][a-z]{2} [0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2} GMT$")
    return F.when(standard, F.unix_timestamp(F.try_to_timestamp(F.substring(value, 6, 20), F.lit("dd MMM yyyy HH:mm:ss"))))


def format_http_date(seconds: Column) -> Column:
    """Standard header form of epoch seconds; null for null and for seconds outside the years 1970 to 9999."""
    at = F.timestamp_seconds(F.when(seconds.between(0, LAST_SECOND), seconds))
    day = F.get(F.array(*[F.lit(d) for d in DAYS]), F.dayofweek(at) - 1)
    return F.concat(day, F.lit(", "), F.date_format(at, "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))


def type_and_charset(value: Column) -> tuple[Column, Column]:
    """Type and charset of a content-type value: lower case, trimmed, ``-`` as ``_`` in the charset; empty if missing."""
    parts = F.transform(F.split(F.lower(value), ";"), lambda x: F.trim(x))
    kinds = F.filter(parts, lambda x: ~x.startswith("charset"))
    sets = F.filter(parts, lambda x: x.startswith("charset"))
    kind = F.coalesce(F.try_element_at(kinds, F.lit(-1)), F.lit(""))
    charset = F.replace(F.coalesce(F.get(F.split(F.try_element_at(sets, F.lit(-1)), "="), F.lit(1)), F.lit("")), F.lit("-"), F.lit("_"))
    return kind, charset


def content_type(rep_header: str, body: Column) -> tuple[Column, Column]:
    """Type and charset of a record: the header's, else (no charset there, body of 512 bytes and more) those of the meta element.

    Without a header the type is ``text/plain``. The meta element counts if ``content-type``
    and a ``content="..."`` after it stand within the first 512 bytes.
    """
    value = header(rep_header, "content-type")
    kind, charset = type_and_charset(value)
    kind = F.when(value.isNull(), "text/plain").otherwise(kind)
    head = F.lower(F.decode(F.substring(body, 1, 512), "ISO-8859-1"))
    meta = F.regexp_extract(head, r'(?s)content-type.*?content="([^"]*)"', 1)
    sniff = (charset == "") & (F.octet_length(body) >= 512) & (meta != "")
    meta_kind, meta_charset = type_and_charset(meta)
    return F.when(sniff, meta_kind).otherwise(kind), F.when(sniff, meta_charset).otherwise(charset)


def outcome(status: Column) -> Column:
    """Class of a status: success, redirect, not_found, server_error (also 710, a failed fetch), else unhandled."""
    return (
        F.when(status.between(200, 299), "success")
        .when(status.between(300, 399), "redirect")
        .when(status.between(400, 499), "not_found")
        .when(status.between(500, 599) | (status == 710), "server_error")
        .otherwise("unhandled")
    )


def request_headers(etag: Column, mod_date: Column, host: Column) -> Column:
    """Headers of a conditional request; entries without a value are left out."""
    full = F.create_map(F.lit("Host"), host, F.lit("If-None-Match"), etag, F.lit("If-Modified-Since"), format_http_date(mod_date))
    return F.map_filter(full, lambda k, v: v.isNotNull())
