"""Streaming forms: de-duplication, politeness per host, and rounds by ``foreachBatch``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from linkflow.functions import http
from linkflow.settings import Settings


def unseen(stream: DataFrame, url: str = "url") -> DataFrame:
    """First row of each url; the state of hashes is unbounded by design (use the RocksDB state store)."""
    return stream.withColumn("url_hash", F.sha1(F.col(url))).dropDuplicates(["url_hash"])


class Politeness(StatefulProcessor):
    """Per queue: budget left and the time before which it rests. Rows ``queue, status_code, req_time, at`` in, state rows out."""

    def __init__(self, settings: Settings):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("politeness", "budget int, not_before long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = self.settings
        budget, rest = self.state.get() if self.state.exists() else (s.queue_budget, 0)
        for f in rows:
            status = f["status_code"]
            budget -= int(status.between(200, 499).sum() + s.budget_punish * status.between(500, 599).sum())
            wait = (f["req_time"].fillna(0) * s.crawl_delay_factor).clip(lower=s.min_delay)
            rest = max(rest, int((f["at"] + wait).max()))
        self.state.update((budget, rest))
        yield pd.DataFrame({"queue": [key[0]], "budget": [budget], "not_before": [rest]})

    def close(self) -> None:
        pass


def politeness(stream: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``queue, budget, not_before`` after each batch for the queues with results; needs the RocksDB state store."""
    return stream.groupBy("queue").transformWithStateInPandas(Politeness(settings), "queue long, budget int, not_before long", "update", "none")


def sink_outcomes(stream: DataFrame, sinks: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, tick: str = "60 seconds"):
    """Start a query that hands every batch, split by outcome, to ``sinks``; a batch that is run again has the same number."""

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("outcome", http.outcome(F.col("status_code")))
        for kind, sink in sinks.items():
            sink(batch.where(F.col("outcome") == kind), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=tick).start()
