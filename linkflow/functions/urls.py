"""URL functions as Columns (JVM side). Null in, null out, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Session keys in the order in which they are removed, and default ports.
SESSION_KEYS = ("jsessionid=", "phpsessid=", "aspsessionid=", "sid=")
DEFAULT_PORTS = {"http": 80, "https": 443, "ftp": 21, "ftps": 990, "sftp": 115}

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
HOST_PATTERN = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^:/?#]*)"


def scheme(url: Column) -> Column:
    """Scheme in lower case, empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def netloc(url: Column) -> Column:
    """Authority part as it stands, user info and port included."""
    return F.regexp_extract(url, _AUTHORITY, 1)


def hostname(url: Column) -> Column:
    """Host in lower case without user info and port, empty if the url has none."""
    return F.lower(F.regexp_extract(url, HOST_PATTERN, 1))


def port(url: Column) -> Column:
    """Port of the url, else the default of its scheme, else null."""
    given = F.regexp_extract(netloc(url), r":(\d{1,5})$", 1)
    table = F.create_map(*[F.lit(x) for kv in DEFAULT_PORTS.items() for x in kv])
    return F.coalesce(F.nullif(given, F.lit("")).try_cast("int"), F.try_element_at(table, scheme(url)))


def username(url: Column) -> Column:
    """User of the user info, null without one."""
    return F.nullif(F.regexp_extract(netloc(url), r"^([^:@]*)(?::[^@]*)?@", 1), F.lit(""))


def password(url: Column) -> Column:
    """Password of the user info, null without one."""
    return F.nullif(F.regexp_extract(netloc(url), r"^[^:@]*:([^@]*)@", 1), F.lit(""))


def strip_sessions(url: Column) -> Column:
    """``url`` without session ids: each key is removed, case aside, with all up to the next ``&``, which stays."""
    for key in SESSION_KEYS:
        url = F.regexp_replace(url, f"(?i){key}[^&]*", "")
    return url


def cleanup(url: Column, remove_anchors: bool = True) -> Column:
    """``url`` up to its first ``#`` (if not empty then), without one trailing ``?`` or ``&``."""
    if not remove_anchors:
        return F.regexp_replace(url, "[?&]$", "")
    # each step names its input once, so that a computed url is computed once
    cut = F.regexp_replace(url, "(?s)^([^#]+)#.*$", "$1")
    return F.regexp_replace(cut, "(?s)^([^#].*)?[?&]$", "$1")


def ascii_only(text: Column) -> Column:
    """Characters outside ASCII as ``?``, one per code point."""
    return F.regexp_replace(text, r"[^\x00-\x7F]", "?")


def resolve(base: Column, link: Column) -> Column:
    """``link`` against ``base`` as RFC 3986 has it; links with ``://`` or a scheme stay as they are."""
    joined = _join(base, link)
    return F.when(has_dots(link) & ~link.contains("://"), remove_dots(joined)).otherwise(joined)


def remove_dots(url: Column) -> Column:
    """``url`` with the dot segments of its path resolved; surplus ``..`` are dropped."""
    origin = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^?#]*(.*)$", 1)
    parts = F.split(path, "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)).when(x == ".", acc).otherwise(F.array_append(acc, x)),
    )
    folder = F.when(F.element_at(parts, -1).isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    return F.concat(origin, F.array_join(folder, "/"), rest)


def _join(base: Column, link: Column) -> Column:
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, r"^(.*/)[^/]*$", 1))
    return (
        F.when(link.contains("://") | link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link == "", base)
        .when(link.startswith("//"), F.concat(scheme(base), F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?"), F.concat(origin, path, link))
        .when(link.startswith("#"), F.concat(F.substring_index(base, "#", 1), link))
        .otherwise(F.concat(origin, folder, link))
    )


def has_dots(link: Column) -> Column:
    """Whether the path of a link has dot segments."""
    return F.substring_index(F.substring_index(link, "?", 1), "#", 1).rlike(r"(^|/)\.{1,2}(/|$)")


def effective_url(url: Column, ip: Column, ip_port: Column) -> Column:
    """``url`` with every occurrence of its authority replaced by ``ip:port``; unchanged if the address is unknown."""
    return F.when(ip.isNull() | (netloc(url) == ""), url).otherwise(F.replace(url, netloc(url), F.concat_ws(":", ip, ip_port.cast("string"))))


def url_hash(url: Column, kind: str = "sha1") -> Column:
    """Hex digest of a url: ``sha1``, ``md5``, ``sha256`` or ``sha512``."""
    if kind == "sha1":
        return F.sha1(url)
    if kind == "md5":
        return F.md5(url)
    if kind in ("sha256", "sha512"):
        return F.sha2(url, int(kind[3:]))
    raise ValueError(f"unknown hash: {kind}")
