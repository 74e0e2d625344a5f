"""The crawl as rounds: ready set, fetch, links, next frontier; a snapshot per round."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkflow.functions import http, urls
from linkflow.operators import extract, frontier
from linkflow.session import materialize
from linkflow.settings import Settings


def seed(spark, seeds: list[str], queues: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """First frontier and queues from seed urls; copies count once."""
    rows = spark.createDataFrame([(u,) for u in dict.fromkeys(seeds)], "url string")
    all_queues = frontier.add_queues(queues, rows.select(urls.hostname(F.col("url")).alias("identifier")))
    placed = frontier.assign_queue(rows, all_queues)
    return placed.select("url", "queue", F.lit(None).cast("string").alias("etag"), F.lit(None).cast("long").alias("mod_date"), F.lit(now).cast("long").alias("next_date"), F.lit(1).alias("priority")), all_queues


def route(fetched: DataFrame, sinks: dict[str, Callable[[DataFrame], None]]) -> None:
    """Hand each outcome class to its sink (``success, redirect, not_found, server_error, unhandled``); classes without a sink are passed over."""
    for kind, sink in sinks.items():
        sink(fetched.where(http.outcome(F.col("status_code")) == kind))


def crawl_round(table: DataFrame, queues: DataFrame, state: DataFrame, fetch: Callable[[DataFrame], DataFrame], links: Callable[[DataFrame], DataFrame], now: int, settings: Settings, dns: DataFrame, sinks: dict | None = None):
    """One round: ``(frontier, queues, state, number fetched)`` after fetching the ready set.

    ``fetch``: from requests to results. ``links``: from results to rows with ``link``.
    Tables are written once per round, so that lineage does not grow.
    """
    ready = materialize(frontier.ready_set(table, state, now, settings))
    n = ready.count()
    if not n:
        return table, queues, state, 0
    results = materialize(fetch(frontier.to_request(ready, dns)).withColumn("fetch_id", F.monotonically_increasing_id()))
    if sinks:
        route(results, sinks)
    new = extract.new_links(links(results), table)
    hosts = materialize(frontier.add_queues(queues, new.select(urls.hostname(F.col("link")).alias("identifier")).where("identifier <> ''")))
    fresh = frontier.assign_queue(new.select(F.col("link").alias("url")), hosts).where("queue is not null")
    rows = fresh.select("url", "queue", F.lit(None).cast("string").alias("etag"), F.lit(None).cast("long").alias("mod_date"), F.lit(now).cast("long").alias("next_date"), F.lit(1).alias("priority"))
    after = frontier.transition(table, results, now, settings)
    grown = materialize(frontier.add_uris(after, rows))
    known = frontier.host_state(grown, settings).join(state, "queue", "left_anti")
    per = results.join(ready.select("url", "queue"), "url")
    next_state = materialize(frontier.apply_politeness(state.unionByName(known), per, now, settings))
    return grown, hosts, next_state, n
