"""Scheduling functions as Columns; the time is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def priority(status: Column, current: Column, levels: int = 10) -> Column:
    """Next priority: one more after 304 (at most ``levels``), else 1."""
    return F.when((status == 304) & (F.coalesce(current, F.lit(0)) > 0), F.least(current + 1, F.lit(levels))).otherwise(F.lit(1)).cast("int")


def next_date(level: Column, now: int, delta: int = 86_400) -> Column:
    """Time of the next fetch."""
    return (F.lit(now) + level * delta).cast("long")


def delay(req_time: Column, factor: float = 4.0, least: float = 5.0) -> Column:
    """Seconds that a host rests after a fetch; the least if the time is unknown."""
    return F.greatest(F.coalesce(req_time, F.lit(0.0)) * factor, F.lit(least))


def budget_cost(status: Column, punish: int = 5) -> Column:
    """What a fetch takes from its queue's budget."""
    return F.when(status.between(200, 499), 1).when(status.between(500, 599), punish).otherwise(0)


def selection_weight(rank: Column) -> Column:
    """Weight of the queue with ``rank`` (from 1) when the next active queue is drawn: in proportion to 1 / rank."""
    return F.lit(1.0) / rank
