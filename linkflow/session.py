"""Session helpers: table access, lineage cuts in the shared folder, checked broadcasts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join may be broadcast; the count is checked at run time.
BROADCAST_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one is made only where none is set and the master is local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="linkflow-")
    sc.setCheckpointDir(path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage, so that neither a later consumer nor a lost executor computes it anew.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/linkflow-{os.getpid()}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows (reads no more than one beyond)."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its row count is checked to be small, else unchanged."""
    return F.broadcast(df) if fits(df, rows) else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` on all cores before costly work per row, if its input has fewer pieces than there are cores.

    That is so for small inputs only; larger ones are not shuffled. ``key``: a unique column.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def header(column: str, name: str) -> Column:
    """First value of a header in a ``map<string,string>`` column, whatever the case of its name; null if absent."""
    return F.expr(f"get(filter(map_entries({column}), e -> lower(e.key) = '{name.lower()}'), 0).value")


def site(url: Column) -> Column:
    """Host of a url: lower case, without user info, port and trailing dot; empty if the url has no host."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^:/?#]*)", 1)
    return F.regexp_replace(F.lower(host), r"\.$", "")
