"""Frontier tables: scans, lookups, mutations, queue ids, ready set, transitions after a fetch.

A frontier is a DataFrame ``url, queue, etag, mod_date, next_date, priority`` (the single
form has no ``queue``). Mutations return a new DataFrame; ``sources.store`` keeps
snapshots. Urls are keys; where a table holds a url twice, both rows are mutated alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkflow.functions import http, schedule, urls
from linkflow.operators.skew import salted_top
from linkflow.schema import IGNORED
from linkflow.session import header, materialize, small
from linkflow.settings import Settings


class UriNotFound(LookupError):
    """No row has this url."""


class QueueNotFound(LookupError):
    """No queue has this identifier."""


class DuplicateUri(ValueError):
    """An inserted url exists already."""


def not_ignored() -> Column:
    """Rows whose ``next_date`` is a time, not a status."""
    return F.col("next_date") > IGNORED


def queue_head(frontier: DataFrame, n: int = 1, offset: int = 0) -> DataFrame:
    """The ``n`` rows due first, ties by url, after ``offset``; ignored rows are left out. A top-k without a full sort."""
    return frontier.where(not_ignored()).orderBy("next_date", "url").offset(offset).limit(n)


def queue_heads(frontier: DataFrame, n: int = 1, offset: int = 0) -> DataFrame:
    """``queue_head`` of every queue at once, numbered by ``pos`` from 1; hot queues are salted."""
    order = [F.col("next_date"), F.col("url"), F.col("priority"), F.col("mod_date"), F.col("etag")]
    top = salted_top(frontier.where(not_ignored() & F.col("queue").isNotNull()), "queue", order, n + offset)
    return top.where(F.col("pos") > offset)


def all_uris(frontier: DataFrame, queue: int | None = None) -> DataFrame:
    """``url`` of all rows, or of one queue."""
    return (frontier if queue is None else frontier.where(F.col("queue") == queue)).select("url")


def get_uri(frontier: DataFrame, url: str):
    """The row of a url, the one due first if there are several; ``UriNotFound`` if there is none."""
    row = frontier.where(F.col("url") == url).orderBy("next_date").first()
    if row is None:
        raise UriNotFound(url)
    return row


def queue_for(queues: DataFrame, identifier: str) -> int:
    """The smallest queue id of an identifier; ``QueueNotFound`` if there is none."""
    row = queues.where(F.col("identifier") == identifier).agg(F.min("queue").alias("queue")).first()
    if row["queue"] is None:
        raise QueueNotFound(identifier)
    return row["queue"]


def size(frontier: DataFrame) -> DataFrame:
    """``n``: number of urls."""
    return frontier.agg(F.count("url").alias("n"))


def queue_sizes(frontier: DataFrame) -> DataFrame:
    """``queue, n`` per queue; ignored rows have no queue and are under null."""
    return frontier.groupBy("queue").agg(F.count("url").alias("n"))


def queue_count(queues: DataFrame) -> DataFrame:
    """``n``: number of queues."""
    return queues.agg(F.count("queue").alias("n"))


def add_uris(frontier: DataFrame, new: DataFrame, strict: bool = False) -> DataFrame:
    """``frontier`` with the rows of ``new`` whose url it lacks, one row per url (the one due first).

    ``strict`` raises ``DuplicateUri`` instead of leaving rows out.
    """
    if strict:
        twice = new.groupBy("url").count().where("count > 1").select("url").unionByName(new.select("url").join(frontier.select("url"), "url", "left_semi")).limit(1).collect()
        if twice:
            raise DuplicateUri(twice[0]["url"])
        return frontier.unionByName(new)
    one = Window.partitionBy("url").orderBy("next_date", F.col("priority"), F.col("mod_date"), F.col("etag"))
    fresh = new.join(frontier.select("url"), "url", "left_anti").withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
    return frontier.unionByName(fresh.select(frontier.columns))


def update_uris(frontier: DataFrame, updates: DataFrame, order: str | None = None) -> DataFrame:
    """``frontier`` with all other columns taken from ``updates`` where the url matches; of several updates the last by ``order`` wins.

    Without ``order`` the urls of ``updates`` must be unique. Urls that ``frontier`` lacks do nothing.
    """
    if order is not None:
        last = Window.partitionBy("url").orderBy(F.col(order).desc())
        updates = updates.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    values = [c for c in frontier.columns if c != "url"]
    new = updates.select("url", F.struct(*values).alias("_new"))
    return frontier.join(new, "url", "left").select([F.col("url") if c == "url" else F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in frontier.columns])


def ignore_uris(frontier: DataFrame, ignored: DataFrame) -> DataFrame:
    """``frontier`` with the urls of ``ignored`` (``url, status``) out of play: dates and tags null, ``next_date`` the status, priority 1, no queue."""
    one = ignored.groupBy("url").agg(F.max("status").alias("_status"))
    hit = F.col("_status").isNotNull()
    values = {"etag": F.lit(None), "mod_date": F.lit(None), "queue": F.lit(None), "next_date": F.col("_status").cast("long"), "priority": F.lit(1)}
    return frontier.join(one, "url", "left").select([F.when(hit, values[c]).otherwise(F.col(c)).cast(frontier.schema[c].dataType).alias(c) if c in values else F.col(c) for c in frontier.columns])


def remove_uris(frontier: DataFrame, gone: DataFrame) -> DataFrame:
    """``frontier`` without the urls of ``gone``."""
    return frontier.join(gone.select("url"), "url", "left_anti")


def add_queues(queues: DataFrame, identifiers: DataFrame) -> DataFrame:
    """``queues`` with an id for each new identifier: from the highest id on, in the order of identifiers.

    Ids are dense without one task seeing all identifiers: each range partition counts its
    own and starts after those before it.
    """
    top = queues.agg(F.coalesce(F.max("queue"), F.lit(0)).alias("top")).first()["top"]
    new = identifiers.where("identifier is not null").select("identifier").distinct().join(queues.select("identifier"), "identifier", "left_anti")
    placed = new.repartitionByRange(F.col("identifier")).sortWithinPartitions("identifier").withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() % F.lit(2**33))
    placed = materialize(placed)  # the places are used twice
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    ids = placed.join(F.broadcast(before), "_part").select((F.lit(top) + F.col("_before") + F.col("_at") + 1).cast("long").alias("queue"), "identifier")  # a row per partition
    return queues.select("queue", "identifier").unionByName(ids)


def assign_queue(rows: DataFrame, queues: DataFrame, url: str = "url") -> DataFrame:
    """``rows`` with ``queue`` by the host of their url, null where the host has no queue."""
    ids = queues.groupBy("identifier").agg(F.min("queue").alias("queue"))
    return rows.withColumn("identifier", urls.hostname(F.col(url))).join(small(ids), "identifier", "left").drop("identifier")


def assign_ip(rows: DataFrame, dns: DataFrame, url: str = "url") -> DataFrame:
    """``rows`` with ``ip`` and ``ip_port`` of their url's host and port, null where the address is unknown.

    ``dns``: ``host_port, ip, port``; of several addresses the last by name counts.
    """
    one = dns.groupBy("host_port").agg(F.max(F.struct("ip", "port")).alias("_a")).select("host_port", F.col("_a.ip").alias("ip"), F.col("_a.port").alias("ip_port"))
    key = F.concat_ws(":", urls.hostname(F.col(url)), urls.port(F.col(url)).cast("string"))
    return rows.withColumn("host_port", key).join(small(one), "host_port", "left").drop("host_port")


def from_result(fetched: DataFrame, now: int, settings: Settings = Settings()) -> DataFrame:
    """``fetch_id, url, etag, mod_date, next_date, priority`` of fetch results.

    ``mod_date`` is Last-Modified, else Date. A dated result is due after its priority's
    time; an undated one is due now, with priority 1.
    """
    dated = F.coalesce(http.http_date(header("rep_header", "last-modified")), http.http_date(header("rep_header", "date")))
    level = schedule.priority(F.col("status_code"), F.col("current_priority"), settings.num_priorities)
    return fetched.select("fetch_id", "url", header("rep_header", "etag").alias("etag"), dated.alias("mod_date"), level.alias("_p")).select(
        "fetch_id",
        "url",
        "etag",
        "mod_date",
        F.when(F.col("mod_date").isNull(), F.lit(now).cast("long")).otherwise(schedule.next_date(F.col("_p"), now, settings.crawl_delta)).alias("next_date"),
        F.when(F.col("mod_date").isNull(), F.lit(1)).otherwise(F.col("_p")).alias("priority"),
    )


def to_request(frontier: DataFrame, dns: DataFrame) -> DataFrame:
    """``url, effective_url, current_priority, req_header, username, password`` of rows that are to be fetched."""
    placed = assign_ip(frontier, dns)
    url = F.col("url")
    return placed.select(
        "url",
        urls.effective_url(url, F.col("ip"), F.col("ip_port")).alias("effective_url"),
        F.col("priority").alias("current_priority"),
        http.request_headers(F.col("etag"), F.col("mod_date"), urls.hostname(url)).alias("req_header"),
        urls.username(url).alias("username"),
        urls.password(url).alias("password"),
    )


def host_state(frontier: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """First state of every queue: full budget, no rest, nothing in the heap."""
    return frontier.where("queue is not null").select("queue").distinct().select("queue", F.lit(settings.queue_budget).alias("budget"), F.lit(0).cast("long").alias("not_before"), F.lit(False).alias("in_heap"))


def apply_politeness(state: DataFrame, results: DataFrame, now: int, settings: Settings = Settings()) -> DataFrame:
    """``state`` after results (``queue, status_code, req_time``): budgets fall, hosts rest, queues leave the heap."""
    cost = schedule.budget_cost(F.col("status_code"), settings.budget_punish)
    rest = F.lit(now) + F.max(schedule.delay(F.col("req_time"), settings.crawl_delay_factor, settings.min_delay)).cast("long")
    per = results.where("queue is not null").groupBy("queue").agg(F.sum(cost).alias("_cost"), rest.alias("_rest"))
    hit = F.col("_cost").isNotNull()
    return state.join(per, "queue", "left").select(
        "queue",
        (F.col("budget") - F.coalesce("_cost", F.lit(0))).cast("int").alias("budget"),
        F.when(hit, F.col("_rest")).otherwise(F.col("not_before")).alias("not_before"),
        F.when(hit, F.lit(False)).otherwise(F.col("in_heap")).alias("in_heap"),
    )


def rotate(state: DataFrame, active: DataFrame, settings: Settings = Settings(), seed: int = 0) -> DataFrame:
    """Next active queues (``queue``): exhausted ones leave, free places are drawn by weight 1 / rank among the others.

    The draw is without replacement (exponential keys) and seeded by the queue, so it is repeatable.
    """
    alive = active.join(state.where("budget > 0"), "queue", "left_semi").select("queue")
    free = max(0, settings.active_queues - alive.count())
    fresh = state.where("budget > 0").join(active, "queue", "left_anti")
    u = (F.pmod(F.xxhash64("queue", F.lit(seed)), F.lit(2**31)) + F.lit(0.5)) / F.lit(2.0**31)
    drawn = fresh.withColumn("_key", -F.log(u) * F.col("queue")).orderBy("_key", "queue").limit(free).select("queue")
    return alive.unionByName(drawn)


def ready_set(frontier: DataFrame, state: DataFrame, now: int, settings: Settings = Settings(), in_flight: DataFrame | None = None) -> DataFrame:
    """Rows to fetch now: of every queue that may work the row due first, up to ``ready_limit`` in order of dates (all without a limit).

    A queue may work if its budget is left, its rest is over and it has nothing in the heap.
    Urls in flight are taken out before the choice, so they cannot block a queue.
    """
    free = state.where(F.expr(f"budget > 0 and not_before <= {now} and not in_heap")).select("queue")
    due = frontier.where(not_ignored() & (F.col("next_date") <= now))
    if in_flight is not None:
        due = due.join(in_flight.select("url"), "url", "left_anti")
    first = queue_heads(due.join(free, "queue", "left_semi"), 1).drop("pos")
    return first if settings.ready_limit is None else first.orderBy("next_date", "url").limit(settings.ready_limit)


def transition(frontier: DataFrame, fetched: DataFrame, now: int, settings: Settings = Settings()) -> DataFrame:
    """``frontier`` after results, one per url (the last to arrive): updated, ignored or released by outcome.

    Success and 304 update the row; 301, 302 (``compat``: every redirect), 4xx, 5xx and
    710 ignore it; other redirects and unhandled statuses leave it as it is.
    """
    last = Window.partitionBy("url").orderBy(F.col("fetch_id").desc())
    one = fetched.withColumn("_n", F.row_number().over(last)).where("_n = 1")
    kind = http.outcome(F.col("status_code"))
    redirect = kind == "redirect"
    update = (kind == "success") | ((F.col("status_code") == 304) & F.lit(not settings.compat))
    ignore = kind.isin("not_found", "server_error") | F.col("status_code").isin(301, 302) | (redirect & F.lit(settings.compat))
    act = F.when(update, "update").when(ignore, "ignore").otherwise("keep")
    results = from_result(one, now, settings).join(one.select("fetch_id", "status_code", act.alias("_act")), "fetch_id").drop("fetch_id").where("_act <> 'keep'")
    new = results.select("url", F.struct("etag", "mod_date", "next_date", "priority", "status_code", "_act").alias("_r"))
    a = F.col("_r._act")
    gone = a == "ignore"
    pick = {
        "etag": F.when(gone, None).when(a == "update", F.col("_r.etag")).otherwise(F.col("etag")),
        "mod_date": F.when(gone, None).when(a == "update", F.col("_r.mod_date")).otherwise(F.col("mod_date")),
        "next_date": F.when(gone, F.col("_r.status_code").cast("long")).when(a == "update", F.col("_r.next_date")).otherwise(F.col("next_date")),
        "priority": F.when(gone, F.lit(1)).when(a == "update", F.col("_r.priority")).otherwise(F.col("priority")),
        "queue": F.when(gone, None).otherwise(F.col("queue")) if "queue" in frontier.columns else None,
    }
    return frontier.join(new, "url", "left").select([pick[c].cast(frontier.schema[c].dataType).alias(c) if c in pick else F.col(c) for c in frontier.columns])
