import pytest
from pyspark.sql import functions as F

from linkflow.functions import http
from linkflow.operators import extract, frontier, rounds
from linkflow.schema import FRONTIER, FRONTIER_SINGLE
from linkflow.settings import Settings
from linkflow.sources.fetch import fetch, simulated
from linkflow.sources.store import SnapshotStore

ROWS = [("http://a/1", 1, "e", 1, 2000, 1), ("http://a/2", 1, None, None, 404, 1), ("http://a/3", 1, None, None, 3000, 2), ("http://b/1", 2, None, None, 2500, 1)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, FRONTIER)


def urls_of(df):
    return sorted(r["url"] for r in df.collect())


def test_head_skips_ignored(table):
    assert [r["url"] for r in frontier.queue_head(table, 1, 1).collect()] == ["http://b/1"]
    heads = {(r["queue"], r["pos"]): r["url"] for r in frontier.queue_heads(table, 2).collect()}
    assert heads == {(1, 1): "http://a/1", (1, 2): "http://a/3", (2, 1): "http://b/1"}


def test_lookup(spark, table):
    assert frontier.get_uri(table, "http://b/1")["queue"] == 2
    with pytest.raises(frontier.UriNotFound):
        frontier.get_uri(table, "http://none/")
    queues = spark.createDataFrame([(1, "a")], "queue long, identifier string")
    assert frontier.queue_for(queues, "a") == 1
    with pytest.raises(frontier.QueueNotFound):
        frontier.queue_for(queues, "b")


def test_add_update_remove_ignore(spark, table):
    new = spark.createDataFrame([("http://a/1", 1, None, None, 1, 1), ("http://c/1", 3, None, None, 1500, 1), ("http://c/1", 3, None, None, 1400, 1)], FRONTIER)
    grown = frontier.add_uris(table, new)
    assert grown.count() == 5 and frontier.get_uri(grown, "http://c/1")["next_date"] == 1400
    with pytest.raises(frontier.DuplicateUri):
        frontier.add_uris(table, new, strict=True)
    changed = frontier.update_uris(table, spark.createDataFrame([("http://a/1", 1, "x", None, 9000, 4), ("http://none", 1, "x", None, 1, 1)], FRONTIER))
    row = frontier.get_uri(changed, "http://a/1")
    assert changed.count() == 4 and (row["etag"], row["mod_date"], row["next_date"], row["priority"]) == ("x", None, 9000, 4)
    assert urls_of(frontier.remove_uris(table, new)) == ["http://a/2", "http://a/3", "http://b/1"]
    gone = frontier.ignore_uris(table, spark.createDataFrame([("http://a/1", 500)], "url string, status int"))
    row = frontier.get_uri(gone, "http://a/1")
    assert (row["queue"], row["etag"], row["next_date"], row["priority"]) == (None, None, 500, 1)
    assert {r["queue"]: r["n"] for r in frontier.queue_sizes(gone).collect()} == {None: 1, 1: 2, 2: 1}


def test_queue_ids(spark):
    queues = spark.createDataFrame([(3, "test")], "queue long, identifier string")
    got = frontier.add_queues(queues, spark.createDataFrame([("test2",), ("test",), ("abc",), ("test2",), (None,)], "identifier string"))
    assert {r["identifier"]: r["queue"] for r in got.collect()} == {"test": 3, "abc": 4, "test2": 5}
    none = spark.createDataFrame([], "queue long, identifier string")
    assert frontier.add_queues(none, none.select("identifier")).count() == 0


def test_transition(spark, table):
    h = {"ETag": "n", "Date": "Wed, 27 Nov 2024 10:24:44 GMT"}
    rows = [(1, "http://a/1", 304, 3, h), (2, "http://a/3", 301, 1, {}), (3, "http://b/1", 200, 5, None)]
    got = {r["url"]: r for r in frontier.transition(table, spark.createDataFrame(rows, "fetch_id long, url string, status_code int, current_priority int, rep_header map<string,string>"), 5000).collect()}
    assert (got["http://a/1"]["priority"], got["http://a/1"]["next_date"], got["http://a/1"]["etag"]) == (4, 5000 + 4 * 86400, "n")
    assert (got["http://a/3"]["queue"], got["http://a/3"]["next_date"]) == (None, 301)
    assert (got["http://b/1"]["priority"], got["http://b/1"]["next_date"], got["http://b/1"]["mod_date"]) == (1, 5000, None)
    single = spark.createDataFrame([("http://a/1", None, None, 2000, 1)], FRONTIER_SINGLE)
    compat = frontier.transition(single, spark.createDataFrame(rows, "fetch_id long, url string, status_code int, current_priority int, rep_header map<string,string>"), 5000, Settings(compat=True))
    assert compat.first()["next_date"] == 304


def test_outcomes(spark):
    got = spark.createDataFrame([(s,) for s in (200, 304, 404, 500, 710, 100, 600)], "s int").select(http.outcome(F.col("s")).alias("o")).collect()
    assert [r["o"] for r in got] == ["success", "redirect", "not_found", "server_error", "server_error", "unhandled", "unhandled"]


def test_budget_and_ready_set(spark, table):
    state = frontier.host_state(table, Settings(queue_budget=4))
    results = spark.createDataFrame([(1, 500, 0.5)], "queue long, status_code int, req_time double")
    after = frontier.apply_politeness(state, results, 100)
    assert {r["queue"]: (r["budget"], r["not_before"]) for r in after.collect()} == {1: (-1, 105), 2: (4, 0)}
    assert urls_of(frontier.ready_set(table, after, 9000)) == ["http://b/1"]
    assert urls_of(frontier.ready_set(table, state, 9000)) == ["http://a/1", "http://b/1"]
    flying = spark.createDataFrame([("http://a/1",)], "url string")
    assert urls_of(frontier.ready_set(table, state, 9000, in_flight=flying)) == ["http://a/3", "http://b/1"]
    active = spark.createDataFrame([(1,)], "queue long")
    assert [r["queue"] for r in frontier.rotate(after, active).collect()] == [2]


def test_rotation_prefers_low_ranks(spark):
    state = spark.range(1, 11).select(F.col("id").alias("queue"), F.lit(5).alias("budget"))
    none = spark.createDataFrame([], "queue long")
    first = [frontier.rotate(state, none, Settings(active_queues=1), seed=k).first()["queue"] for k in range(60)]
    assert first.count(1) > first.count(5) and first.count(1) > 10


def test_requests(spark, table):
    dns = spark.createDataFrame([("a:80", "1.2.3.4", 8080)], "host_port string, ip string, port int")
    got = {r["url"]: r for r in frontier.to_request(table, dns).collect()}
    assert got["http://a/1"]["effective_url"] == "http://1.2.3.4:8080/1" and got["http://a/1"]["req_header"] == {"Host": "a", "If-None-Match": "e", "If-Modified-Since": "Thu, 01 Jan 1970 00:00:01 GMT"}
    assert got["http://b/1"]["effective_url"] == "http://b/1"


def test_fetch_isolates_errors(spark):
    requests = spark.createDataFrame([("http://a/", "http://a/", 1, {"Host": "a"}), ("http://b/", "http://b/", 1, None)], "url string, effective_url string, current_priority int, req_header map<string,string>")

    def transport(r, settings):
        if r["url"] == "http://b/":
            raise OSError("no route")
        return 200, {"X": "y"}, b"body"

    got = {r["url"]: r for r in fetch(requests, transport).collect()}
    assert got["http://a/"]["status_code"] == 200 and got["http://a/"]["content_body"] == b"body"
    assert got["http://b/"]["status_code"] == 710 and "no route" in got["http://b/"]["error"]


def test_rounds_follow_links(spark):
    settings = Settings(scope_positive=("http://.*",))
    web = spark.createDataFrame(
        [("http://a/", 200, {"Content-Type": "text/html"}, b"<a href='/x'> <a href='http://b/'>", 0.1), ("http://a/x", 404, {}, None, 0.1), ("http://b/", 302, {"Location": "http://c/y"}, None, 0.1)],
        "url string, status_code int, rep_header map<string,string>, content_body binary, req_time double",
    )
    none = spark.createDataFrame([], "queue long, identifier string")
    at, queues = rounds.seed(spark, ["http://a/"], none, 2000)
    state = frontier.host_state(at, settings)
    dns = spark.createDataFrame([], "host_port string, ip string, port int")
    seen = []
    links = lambda r: extract.pipeline(r.withColumn("optional_vars", F.lit(None).cast("map<string,string>")), settings)
    for k in range(3):
        at, queues, state, n = rounds.crawl_round(at, queues, state, lambda q: simulated(q, web), links, 2000 + 100 * k, settings, dns, {"success": lambda d: seen.extend(urls_of(d))})
    assert urls_of(at) == ["http://a/", "http://a/x", "http://b/", "http://c/y"]
    assert "http://a/" in seen
    assert frontier.get_uri(at, "http://b/")["next_date"] == 302


def test_store(spark, tmp_path, table):
    store = SnapshotStore(spark, f"file://{tmp_path}/t")
    with pytest.raises(LookupError):
        store.read()
    assert store.write(table) == 1 and store.write(table.limit(1)) == 2
    assert store.read().count() == 1 and store.read(1).count() == 4
    store.trim(1)
    assert store.versions() == [2]
