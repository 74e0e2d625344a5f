from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from linkflow.operators.timestamps import crawl_timestamps, normalize_timestamps, unusual_timestamps
from linkflow.session import table

ZONES = [("bad.test", "Mars/Olympus"), ("lower.test", "europe/berlin"), ("a.test", "Europe/Berlin"), ("b.test", "America/New_York"), ("c.test", "Australia/Sydney")]


def ms(*a, zone=timezone.utc):
    return int(datetime(*a, tzinfo=zone).timestamp() * 1000)


def wall(y, mo, d, h, mi, s, zone):
    """Wall time by the policy: earlier of two instants, skipped times moved forward by the gap."""
    z = ZoneInfo(zone)
    return int(datetime(y, mo, d, h, mi, s, tzinfo=z, fold=0).timestamp() * 1000)


CASES = [
    ("Wednesday, 01-Jan-25 13:15:45 GMT", "x.test", ms(2025, 1, 1, 13, 15, 45)),
    ("  Sun, 03 Jul 2022 06:42:47 GMT  ", "x.test", ms(2022, 7, 3, 6, 42, 47)),
    ("Mo, 16 Mai 2022 04:58:37 GMT", "x.test", ms(2022, 5, 16, 4, 58, 37)),
    ("So, 26 Mär 2023 01:38:27 GMT", "x.test", ms(2023, 3, 26, 1, 38, 27)),
    ("2025-01-01 14:06:32.833", "x.test", ms(2025, 1, 1, 14, 6, 32) + 833),
    ("2023-05-01T08:26:51+02:00", "a.test", ms(2023, 5, 1, 6, 26, 51)),
    ("2024-06-16T21:13:57+02:00[Europe/Berlin]", "x.test", ms(2024, 6, 16, 19, 13, 57)),
    ("2024-06-16T21:13:57[America/New_York]", "x.test", ms(2024, 6, 17, 1, 13, 57)),
    ("2025-01-01T14:21:52.084308794Z", "x.test", ms(2025, 1, 1, 14, 21, 52) + 84),
    ("20250101T211653Z", "a.test", ms(2025, 1, 1, 21, 16, 53)),
    ("Wed Jan  1 11:13:55 2025", "b.test", ms(2025, 1, 1, 16, 13, 55)),
    ("22 Jul 2022 11:18 +0200", "x.test", ms(2022, 7, 22, 9, 18)),
    ("01/02/2025 10:40:22 AM", "x.test", ms(2025, 1, 2, 10, 40, 22)),
    ("12/16/2022 12:31 AM EST", "x.test", ms(2022, 12, 16, 5, 31)),
    ("2.1.2025, 03:10:38 Uhr", "x.test", ms(2025, 1, 2, 3, 10, 38)),
    ("1688669131.25", "x.test", 1688669131250),
    ("1735740786", "x.test", 1735740786000),
    ("1711842464533", "x.test", 1711842464533),
    ("1735722407053930", "x.test", 1735722407053),
    ("1698542392470878394", "x.test", 1698542392470),
    ("20230407222108", "b.test", ms(2023, 4, 8, 2, 21, 8)),
    # the later hour of two: the earlier instant; a skipped hour: moved forward
    ("2022-10-30T02:30:00", "a.test", wall(2022, 10, 30, 2, 30, 0, "Europe/Berlin")),
    ("2022-03-27T02:30:00", "a.test", ms(2022, 3, 27, 1, 30)),
    ("2024-11-03 01:15:00", "b.test", ms(2024, 11, 3, 5, 15)),
    ("2024-03-10 02:15:00", "b.test", ms(2024, 3, 10, 7, 15)),
    ("2023-13-45T99:00:00Z", "x.test", None),
    ("never", "x.test", None),
    ("", "x.test", None),
    ("0", "x.test", None),
    ("-1", "x.test", None),
    ("99999999", "x.test", None),
    ("1999-12-31T23:59:59Z", "x.test", None),
    ("2030-01-01T00:00:00Z", "x.test", None),
    ("13/25/2024 10:00 AM UTC", "x.test", None),
    (None, "x.test", None),
    # zones: names that exist in any case, three parts and hyphens; names that do not exist
    ("2024-06-16T21:13:57[america/port-au-prince]", "x.test", ms(2024, 6, 17, 1, 13, 57)),
    ("2024-06-16T21:13:57[America/Indiana/Knox]", "x.test", ms(2024, 6, 17, 2, 13, 57)),
    ("2024-06-16T21:13:57[Europe/Nowhere]", "x.test", None),
    ("2024-06-16T21:13:57+02:00[Europe/Nowhere]", "x.test", None),
    ("2024-06-16T21:13:57[//]", "x.test", None),
    ("2024-06-16T21:13:57", "bad.test", ms(2024, 6, 16, 21, 13, 57)),
    ("2024-06-16T21:13:57", "lower.test", ms(2024, 6, 16, 19, 13, 57)),
    # offsets
    ("2024-06-16T21:13:57+18:00", "x.test", ms(2024, 6, 16, 3, 13, 57)),
    ("2024-06-16T21:13:57+18:01", "x.test", None),
    ("2024-06-16T21:13:57+25:00", "x.test", None),
    ("2024-06-16T21:13:57-0199", "x.test", None),
    # months of seven languages
    ("3 juin 2022 06:42", "x.test", ms(2022, 6, 3, 6, 42)),
    ("14 juillet 2022 06:42", "x.test", ms(2022, 7, 14, 6, 42)),
    ("15 aout 2022 06:42", "x.test", ms(2022, 8, 15, 6, 42)),
    ("2 giugno 2022 06:42", "x.test", ms(2022, 6, 2, 6, 42)),
    ("5 paź 2022 06:42", "x.test", ms(2022, 10, 5, 6, 42)),
    ("5 października 2022 06:42", "x.test", ms(2022, 10, 5, 6, 42)),
    ("terça-feira, 5 março 2024 06:42", "x.test", ms(2024, 3, 5, 6, 42)),
    ("5 marmalade 2022 06:42", "x.test", None),
    ("5 junk 2022 06:42", "x.test", None),
]


def test_cases(spark):
    rows = [(k, v, f"http://{s.upper()}:80/p") for k, (v, s, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "k int, v string, url string")
    zones = spark.createDataFrame(ZONES, "identifier string, zone string")
    got = {r["k"]: r["utc_ms"] for r in normalize_timestamps(df, zones, "v", "url").collect()}
    for k, (v, s, want) in enumerate(CASES):
        assert got[k] == want, (v, s, got[k], want)


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kolkata"])
def test_every_hour_of_a_year(spark, zone):
    start = datetime(2023, 1, 1)
    hours = [start + timedelta(hours=k, minutes=30) for k in range(365 * 24)]
    df = spark.createDataFrame([(k, t.strftime("%Y-%m-%d %H:%M:%S"), "http://z.test/") for k, t in enumerate(hours)], "k int, v string, url string")
    got = {r["k"]: r["utc_ms"] for r in normalize_timestamps(df, spark.createDataFrame([("z.test", zone)], "identifier string, zone string"), "v", "url").collect()}
    for k, t in enumerate(hours):
        assert got[k] == int(t.replace(tzinfo=ZoneInfo(zone), fold=0).timestamp() * 1000)


def test_empty_tables_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "v string, url string, _tz2 int")
    zones = spark.createDataFrame([], "identifier string, zone string")
    assert normalize_timestamps(empty, zones, "v", "url").columns == ["v", "url", "_tz2", "utc_ms"]
    df = spark.createDataFrame([("2024-01-01", None, 1)], "v string, url string, zone int")
    assert normalize_timestamps(df, zones, "v", "url").first()["utc_ms"] == ms(2024, 1, 1)


def test_tables(spark, data):
    t = lambda n: table(spark, data, n)
    found = unusual_timestamps(t("crawl_uris"), t("queue"), t("site_zones"))
    every = crawl_timestamps(t("crawl_uris"), t("queue"), t("site_zones"))
    assert found.count() == found.distinct().count() == every.where("not usual and utc_ms is not null").select("src", "rec", "utc_ms").distinct().count()
