"""Per-key results when a few keys hold most rows: two-stage salted aggregation.

Heavy keys are found over all rows with a Misra-Gries pass (``freqItems``, bounded
memory, no key above the support is missed). Rows of heavy keys get a salt, partial
results are made per (key, salt) and merged per key, so that no task gets all rows of a
key. Light keys keep salt 0 and are done after the first stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkflow.session import site, small

#: A key with more than this share of the rows is salted; at most 1 / SUPPORT keys are.
SUPPORT = 0.005
SALTS = 32


def heavy_keys(df: DataFrame, key: str, support: float = SUPPORT) -> list:
    """Keys that may hold more than ``support`` of the rows (a superset, at most about 1 / support); null is left out."""
    found = df.select(key).freqItems([key], support).first()
    return sorted(k for k in (found[0] if found else []) if k is not None)


def salted(df: DataFrame, key: str, support: float = SUPPORT, salts: int = SALTS) -> DataFrame:
    """``df`` with ``_salt``: 0 for light keys, spread over ``salts`` values for heavy and null keys.

    The salt is the row's number in its input, not a draw: a task that is run again gives
    the same salts.
    """
    heavy = heavy_keys(df, key, support)
    many = F.col(key).isNull()
    if heavy:
        many = many | F.col(key).isin(heavy)
    return df.withColumn("_salt", F.when(many, F.pmod(F.monotonically_increasing_id(), F.lit(salts))).otherwise(F.lit(0)).cast("int"))


def salted_aggregate(df: DataFrame, key: str, partial: Sequence[Column], merge: Sequence[Column], support: float = SUPPORT, salts: int = SALTS) -> DataFrame:
    """``groupBy(key)`` in two stages.

    partial: aliased aggregates per (key, salt); merge: aggregates over those aliases per
    key. Null is a key of its own, as in ``groupBy``. An empty table gives no row.
    """
    return salted(df, key, support, salts).groupBy(key, "_salt").agg(*partial).groupBy(key).agg(*merge)


def salted_top(df: DataFrame, key: str, order: Sequence[Column], n: int, out: str = "pos", support: float = SUPPORT, salts: int = SALTS) -> DataFrame:
    """First ``n`` rows per key by ``order``, numbered in ``out``; top n per (key, salt) first, then per key.

    Give an ``order`` without ties for a defined result.
    """
    part = Window.partitionBy(key, "_salt").orderBy(*order)
    whole = Window.partitionBy(key).orderBy(*order)
    top = salted(df, key, support, salts).withColumn("_rn", F.row_number().over(part)).where(F.col("_rn") <= n).drop("_rn", "_salt")
    return top.withColumn(out, F.row_number().over(whole).cast("long")).where(F.col(out) <= n)


def host_ids(queue_identifiers: DataFrame) -> DataFrame:
    """``queue, identifier``: the site of each queue id; an id listed with several names takes the smallest site."""
    named = queue_identifiers.where("queue is not null and identifier is not null")
    return named.groupBy("queue").agg(F.min(site(F.concat(F.lit("http://"), "identifier"))).alias("identifier"))


def per_host(queues: DataFrame, queue_identifiers: DataFrame, now: int) -> DataFrame:
    """``identifier, n_rows, n_urls_due, first_due, last_due`` per site.

    Rows are first counted per queue id with salts, so that only one row per queue id
    meets the names. Due: ``1000 < next_date <= now``. Rows without a queue and ids
    without a name belong to no site.
    """
    due = F.when((F.col("next_date") > 1000) & (F.col("next_date") <= now), F.col("next_date"))
    counts = salted_aggregate(
        queues.where("queue is not null").select("queue", "next_date"),
        "queue",
        [F.count(F.lit(1)).alias("n"), F.count(due).alias("d"), F.min(due).alias("lo"), F.max(due).alias("hi")],
        [F.sum("n").alias("n"), F.sum("d").alias("d"), F.min("lo").alias("lo"), F.max("hi").alias("hi")],
    )
    return (
        counts.join(host_ids(queue_identifiers), "queue")
        .groupBy("identifier")
        .agg(F.sum("n").alias("n_rows"), F.sum("d").alias("n_urls_due"), F.min("lo").alias("first_due"), F.max("hi").alias("last_due"))
    )


def dominant_hosts(queues: DataFrame, queue_identifiers: DataFrame, share: float = 0.02) -> DataFrame:
    """``identifier`` of the sites whose ids together hold at least ``share`` of all rows, rows without a queue included in the total."""
    hosts = per_host(queues, queue_identifiers, 0)
    return hosts.where(F.col("n_rows") >= queues.count() * share).select("identifier")


def next_urls(queues: DataFrame, queue_identifiers: DataFrame, now: int, n: int = 10) -> DataFrame:
    """``identifier, pos, url, next_date``: the ``n`` due urls of each site that were due first, ties by url; a url once per site."""
    due = queues.where((F.col("next_date") > 1000) & (F.col("next_date") <= now) & F.col("queue").isNotNull()).select("queue", "url", "next_date")
    named = due.join(small(host_ids(queue_identifiers), 200_000), "queue").groupBy("identifier", "url").agg(F.min("next_date").alias("next_date"))
    return salted_top(named, "identifier", [F.col("next_date"), F.col("url")], n).select("identifier", "pos", "url", "next_date")
