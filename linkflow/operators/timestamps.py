"""Timestamps of many forms to UTC instants (JVM expressions only).

An ordered cascade of anchored patterns rewrites a value to canonical fields; the
first pattern that matches wins, and only a complete and valid set of fields gives an
instant. Values without a zone are wall time in the zone of their source. Of two
possible instants the earlier is taken; a skipped wall time moves forward by the length
of the gap. A bare number counts from 1970 in the unit that puts it into 2000-2029,
else its digits spell a wall time. Anything else, null and empty values included, is
null ("unreadable").
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkflow.session import site, small

#: Instants are read within these years (UTC), as epoch seconds: from 2000 up to, not including, 2030.
FIRST, END = 946_684_800, 1_893_456_000

# Names of months (en, de, fr, es, pt, it, pl; full, short and inflected) and offsets of zone abbreviations in minutes.
MONTH_NAMES = {
    1: "jan january januar jänner janvier janv enero ene janeiro gennaio gen styczeń stycznia sty",
    2: "feb february februar février fév fevr févr fevrier febrero fevereiro fev febbraio luty lutego lut",
    3: "mar march märz mär maerz mrz mars marzo março marco marzec marca",
    4: "apr april avril avr abril abr aprile kwiecień kwietnia kwi",
    5: "may mai mayo maio maggio mag maj maja",
    6: "jun june juni juin junio junho giugno giu czerwiec czerwca cze",
    7: "jul july juli juillet juil julio julho luglio lug lipiec lipca lip",
    8: "aug august août aoû aout agosto ago sierpień sierpnia sie",
    9: "sep sept september septembre septiembre setembro set settembre wrzesień września wrz",
    10: "oct october oktober okt octobre octubre outubro out ottobre ott październik października paź",
    11: "nov november novembre noviembre novembro listopad listopada lis",
    12: "dec december dezember dez décembre déc decembre diciembre dic dezembro dicembre grudzień grudnia gru",
}
MONTHS = {name: k for k, names in MONTH_NAMES.items() for name in names.split()}
ZONES = {
    "gmt": 0, "utc": 0, "ut": 0, "z": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "mez": 60, "cest": 120, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "jst": 540, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
}
USUAL_HEADER = (
    r"^(Mon|Tue|Wed|Thu|Fri|Sat|Sun), [0-9]{2} (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) [0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2} GMT$"
)
USUAL_NUMBER = r"^[0-9]{10}$"

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?:\s*([ap])\.?m\.?)?(?:\s+(?:uhr|h))?"
_ZONE = r"\s*([+-]\d{2}:?\d{2}|[a-z]{1,4})?(?:\s*\[([a-z0-9_+/-]+)\])?"
_NAME = r"([a-zà-ÿčśźżńłęą]{3,12})\.?"
_DAY = r"(?:[a-zà-ÿśź-]{2,14}\.?,?\s+)?"
#: (pattern, order of its groups as year, month, day); the groups after the date are hour, minute, second, fraction, a/p, offset, region.
CASCADE = (
    (rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:t|\s+){_CLOCK}{_ZONE}$", "$1|$2|$3"),
    (rf"^{_DAY}(\d{{1,2}})[ -]{_NAME}[ -](\d{{4}}|\d{{2}})\s+{_CLOCK}{_ZONE}$", "$3|$2|$1"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),?\s+{_CLOCK}{_ZONE}$", "$3|$1|$2"),
    (rf"^{_DAY}(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),?\s+{_CLOCK}{_ZONE}$", "$3|$2|$1"),
)
#: asctime has the year last, compact ISO has no separators.
ASCTIME = rf"^(?:[a-zà-ÿśź-]{{2,14}}\.?,?\s+){_NAME}\s+(\d{{1,2}})\s+(\d{{1,2}}):(\d{{2}})(?::(\d{{2}}))?(?:\s+([a-z]{{1,4}}))?\s+(\d{{4}})$"
COMPACT = r"^(\d{4})(\d{2})(\d{2})t?(?:(\d{2})(\d{2})(\d{2})?)?(?:[.,](\d{1,9}))?" + _ZONE + "$"
NUMBER = r"^[0-9]{1,19}([.][0-9]{1,9})?$"
DATE_ONLY = (
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})$", "$1|$2|$3"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3|$1|$2"),
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", "$3|$2|$1"),
    (rf"^{_DAY}(\d{{1,2}})[ -]{_NAME}[ -](\d{{4}})$", "$3|$2|$1"),
)


#: Offsets beyond this many minutes are no offsets.
FARTHEST = 18 * 60


@lru_cache(1)
def _zone_names(jvm) -> tuple[str, ...]:
    return tuple(sorted(jvm.java.time.ZoneId.getAvailableZoneIds()))


def zone_names(spark: SparkSession) -> dict[str, str]:
    """Names of the zones that this JVM knows, by their lower-case form; a name that is not among them never reaches a date function."""
    return {n.lower(): n for n in _zone_names(spark.sparkContext._jvm)}


def known_zone(name: Column, names: dict[str, str]) -> Column:
    """``name`` in the spelling of the list, case aside; null if it is not listed."""
    key = F.lower(F.trim(name))
    # one literal string, split at each use by a folded expression
    listed = F.map_from_arrays(F.split(F.lit(",".join(names)), ","), F.split(F.lit(",".join(names.values())), ","))
    return F.try_element_at(listed, key)


def _lookup(values: dict[str, int], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, so that the expression stays small however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _wall(part: Column, zone: Column, names: dict[str, str]) -> Column:
    """Milliseconds from canonical fields: year, month, day, hour, minute, second, fraction, a/p, offset, region.

    ``zone`` is a known name or null. A region that is not a known name, and an offset
    beyond 18 hours, make the value unreadable.
    """
    at = lambda i: F.get(part, F.lit(i))
    whole = lambda i: F.when(at(i) == "", F.lit(0)).otherwise(at(i).try_cast("int"))
    year = whole(0)
    year = F.when(F.length(at(0)) == 2, year + F.when(year < 70, 2000).otherwise(1900)).otherwise(year)
    month = F.coalesce(at(1).try_cast("int"), _lookup(MONTHS, at(1)))
    hour = F.when(at(7) == "", whole(3)).when(whole(3).between(1, 12), whole(3) % 12 + F.when(at(7) == "p", 12).otherwise(0))
    named = at(8)
    digits = F.regexp_replace(named, "[^0-9]", "")
    minutes = F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")
    size = F.when((minutes <= FARTHEST) & (F.substring(digits, 3, 2).try_cast("int") < 60), minutes)
    offset = F.when(named.rlike("^[+]"), size).when(named.startswith("-"), -size).otherwise(_lookup(ZONES, named))
    # a region counts only without an offset, but must be known in any case; its name comes in lower case
    region = F.when(at(9).isin("utc", "gmt", "z", "etc/utc"), F.lit("UTC")).when(at(9).contains("/"), known_zone(at(9), names))
    readable = (at(9) == "") | region.isNotNull()
    wall_zone = F.when((named == "") & readable, F.coalesce(region, zone, F.lit("UTC"))).otherwise(F.lit("UTC"))
    stamp = F.try_make_timestamp(year, month, at(2).try_cast("int"), hour, whole(4), whole(5).cast("decimal(16,6)"), wall_zone)
    millis = F.unix_millis(stamp) - F.coalesce(offset, F.lit(0)).cast("long") * 60_000 + F.rpad(at(6), 3, "0").try_cast("long")
    return F.when(readable & ((named == "") | offset.isNotNull()) & (whole(5) < 60), millis)


def _counted(number: Column) -> Column:
    """Milliseconds from a bare number in the unit that puts it into the years read; null if none does."""
    count = F.substring_index(number, ".", 1).try_cast("long")
    fraction = F.when(number.contains("."), F.rpad(F.substring_index(number, ".", -1), 3, "0").try_cast("long")).otherwise(F.lit(0))
    inside = lambda unit: (count >= FIRST * unit) & (count < END * unit)
    return (
        F.when(inside(1), count * 1000 + fraction)
        .when(inside(1000), count)
        .when(inside(1_000_000), F.call_function("div", count, F.lit(1000)))
        .when(inside(1_000_000_000), F.call_function("div", count, F.lit(1_000_000)))
    )


def utc_millis(value: Column, zone: Column, names: dict[str, str]) -> Column:
    """Milliseconds since 1970 UTC that ``value`` (string) names, null if it names none in 2000-2029.

    ``zone``: IANA name for values without a zone, one of ``names`` (``zone_names``); null means UTC.
    """
    forms = [(p, f"{d}|$4|$5|$6|$7|$8|$9|$10") for p, d in CASCADE]
    forms += [(ASCTIME, "$7|$1|$2|$3|$4|$5|||$6|"), (COMPACT, "$1|$2|$3|$4|$5|$6|$7||$8|$9")]
    forms += [(p, f"{d}|||||||") for p, d in DATE_ONLY]

    def read(v: Column) -> Column:
        text = F.lit(None).cast("string")
        for pattern, to in reversed(forms):
            text = F.when(v.rlike(pattern), F.regexp_replace(v, pattern, to)).otherwise(text)
        spelt = _let(F.split(text, r"\|", 10), lambda part: _wall(part, zone, names))
        return F.coalesce(F.when(v.rlike(NUMBER), _counted(v)), spelt)

    got = _let(F.lower(F.trim(F.regexp_replace(value, r"[\s\u00a0]+", " "))), read)
    return _let(got, lambda x: F.when((x >= FIRST * 1000) & (x < END * 1000), x))


def normalize_timestamps(values: DataFrame, zones: DataFrame, value: str, url: str, out: str = "utc_ms") -> DataFrame:
    """``values`` with a column ``out`` of UTC milliseconds (null: unreadable).

    values: any table with a string column ``value`` and a url column ``url``.
    zones: ``identifier, zone`` per site; a site's smallest zone counts if it is listed
    twice, and a zone that no list has counts as not listed. It is broadcast after a check
    of its size. A site that is not listed is UTC.
    """
    names = zone_names(values.sparkSession)
    zones = zones.withColumn("zone", known_zone(F.col("zone"), names))
    z = zones.where("identifier is not null and zone is not null").groupBy(site(F.concat(F.lit("http://"), "identifier")).alias("_tz_site")).agg(F.min("zone").alias("_tz"))
    return (
        values.withColumn("_tz_site", site(F.col(url)))
        .join(small(z), "_tz_site", "left")
        .withColumn(out, utc_millis(F.col(value), F.col("_tz"), names))
        .drop("_tz_site", "_tz")
    )


def crawl_timestamps(crawl_uris: DataFrame, queue: DataFrame, zones: DataFrame, only_unusual: bool = False) -> DataFrame:
    """Every ``Date`` and ``Last-Modified`` header and every ``mod_date``: ``src, rec, raw, usual, utc_ms``.

    A header map that is null, or a null value, gives no row.
    """
    headers = crawl_uris.select("fetch_id", "url", F.explode("rep_header").alias("_k", "raw")).select(
        F.lower("_k").alias("src"), F.col("fetch_id").cast("string").alias("rec"), "url", "raw"
    ).where(F.col("src").isin("date", "last-modified") & F.col("raw").isNotNull())
    marks = queue.where("mod_date is not null").select(F.lit("mod_date").alias("src"), F.col("url").alias("rec"), "url", F.col("mod_date").cast("string").alias("raw"))
    both = headers.withColumn("usual", F.col("raw").rlike(USUAL_HEADER)).unionByName(marks.withColumn("usual", F.col("raw").rlike(USUAL_NUMBER)))
    both = both.where("not usual") if only_unusual else both
    return normalize_timestamps(both, zones, "raw", "url").select("src", "rec", "raw", "usual", "utc_ms")


def unusual_timestamps(crawl_uris: DataFrame, queue: DataFrame, zones: DataFrame) -> DataFrame:
    """``src, rec, utc_ms`` of the readable values that are not in the usual form, each row once."""
    found = crawl_timestamps(crawl_uris, queue, zones, only_unusual=True)
    return found.select("src", "rec", "utc_ms").distinct().where("utc_ms is not null")
