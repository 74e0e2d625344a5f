"""Has this key been seen before? Blocked Bloom filters over hash-partitioned keys (problem 7).

Keys are routed by hash to shards, so a shard's filter answers for all keys that can
come to it. A shard reads its keys in order of arrival in batches: query, then insert. A
filter is made of blocks of 512 bits; a key sets all its bits in one block, so a query
touches one cache line. Filters are sized from the shard's number of keys for a target
rate of false positives.

A key with very many arrivals does not load one shard: of the arrivals of a key in one
input partition only the first goes on, the others are known then and there.

A Bloom filter never misses a key; what it claims to know is checked exactly, so the
answers are right whatever the rate. The rate is measured with keys known to be absent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkflow.session import materialize

TARGET = 0.01
#: Keys of a shard; a shard's filter at TARGET takes about 1.5 bytes a key.
SHARD_KEYS = 2_000_000
BLOCK_WORDS = 8
#: Keys that a task keeps to mark repeats before the shuffle.
HELD = 500_000
#: Arrival of keys that are asked for after all others and not inserted.
ASK_ONLY = 2**62


class BlockedBloom:
    """Bloom filter of 512-bit blocks over 64-bit hashes, sized for ``n`` keys at a false-positive rate ``target``.

    Blocks fill unevenly, so the bits are those of a plain filter for a third of the target.
    """

    def __init__(self, n: int, target: float = TARGET):
        bits = max(1, n) * -np.log(target / 3) / np.log(2) ** 2
        self.hashes = max(1, round(-np.log2(target / 3)))
        self.blocks = max(1, int(np.ceil(bits / 512)))
        self.words = np.zeros((self.blocks, BLOCK_WORDS), np.uint64)

    def _bits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = h.astype(np.int64).view(np.uint64)
        with np.errstate(over="ignore"):
            block = ((h >> np.uint64(32)) * np.uint64(self.blocks)) >> np.uint64(32)
            x = h
            mask = np.zeros((len(h), BLOCK_WORDS), np.uint64)
            rows = np.arange(len(h))
            for _ in range(self.hashes):
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
                pos = (x >> np.uint64(55)).astype(np.int64)
                mask[rows, pos >> 6] |= np.uint64(1) << (pos & 63).astype(np.uint64)
        return block.astype(np.int64), mask

    def query(self, h: np.ndarray) -> np.ndarray:
        """Which of the hashes may have been inserted."""
        block, mask = self._bits(h)
        return ((self.words[block] & mask) == mask).all(axis=1)

    def insert(self, h: np.ndarray) -> None:
        block, mask = self._bits(h)
        np.bitwise_or.at(self.words, block, mask)


def _first_per_partition(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Map side: a row is marked known if an earlier arrival of its key has passed in this partition; the others go on.

    The keys that have passed are kept up to ``HELD`` and then forgotten, which lets more
    rows go on and changes no answer.
    """
    passed: dict[str, int] = {}
    for f in frames:
        f = f.sort_values(["key", "arrival"], kind="stable")
        known = f["key"].duplicated().to_numpy()
        keys, arrivals = f["key"].tolist(), f["arrival"].tolist()
        if len(passed) > HELD:
            passed.clear()
        for i in np.flatnonzero(~known):
            before = passed.get(keys[i])
            if before is None or arrivals[i] < before:
                passed[keys[i]] = arrivals[i]
            else:
                known[i] = True
        yield f.assign(known=known)


def _shard(target: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bloom = None
        for f in frames:
            if not len(f):
                continue
            if bloom is None:
                bloom = BlockedBloom(int(f["shard_keys"].iloc[0]), target)
            h = f["hash"].to_numpy()
            maybe = bloom.query(h)
            # a key that comes twice within the batch: the later one is not new
            maybe |= pd.Series(h).duplicated().to_numpy()
            bloom.insert(h[f["arrival"].to_numpy() < ASK_ONLY])
            out = f.loc[f["wanted"] & maybe, ["row", "key", "arrival"]]
            if len(out):
                yield out

    return run


def route(records: DataFrame, before: DataFrame, key: str, arrival: str, row: str) -> tuple[DataFrame, DataFrame]:
    """Rows known within their input partition, and the first arrivals that go to the filters with those of ``before``.

    Keys of ``before`` count as arrived before every record. Null keys are never known.
    """
    schema = "row long, key string, arrival long, known boolean"
    own = records.where(F.col(key).isNotNull()).select(F.col(row).alias("row"), F.col(key).alias("key"), F.col(arrival).alias("arrival"))
    marked = materialize(own.mapInPandas(_first_per_partition, schema))
    old = before.where(F.col(key).isNotNull()).select(F.lit(None).cast("long").alias("row"), F.col(key).alias("key"), F.lit(-(2**62)).cast("long").alias("arrival"))
    first = marked.where("not known").drop("known").withColumn("wanted", F.lit(True)).unionByName(old.withColumn("wanted", F.lit(False)))
    return marked.where("known").select("row"), first


def filter_claims(first: DataFrame, shards: int, keys: int, target: float) -> DataFrame:
    """``row, key, arrival`` of the records that the shards' filters claim to know."""
    routed = first.withColumn("hash", F.xxhash64("key")).withColumn("shard_keys", F.lit(-(-keys // shards) + 64).cast("long"))
    return routed.repartition(shards, "hash").sortWithinPartitions("arrival").select("row", "key", "arrival", "wanted", "hash", "shard_keys").mapInPandas(_shard(target), "row long, key string, arrival long")


def known_records(records: DataFrame, before: DataFrame, key: str, arrival: str, row: str, target: float = TARGET) -> DataFrame:
    """``row`` of the records whose key is in ``before`` or in a record with a smaller ``arrival``; every answer is exact.

    ``arrival`` and ``row``: unique long columns of ``records``.
    """
    known, first = route(records, before, key, arrival, row)
    keys = first.count()
    shards = max(1, -(-keys // SHARD_KEYS), min(64, -(-keys // 20_000)))
    claims = materialize(filter_claims(first, shards, keys, target))
    # exact check of the claims alone: their keys against all first arrivals
    earliest = first.join(claims.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("arrival").alias("earliest"))
    right = claims.join(earliest, "key").where(F.col("earliest") < F.col("arrival")).select("row")
    return known.unionByName(right).select(F.col("row").alias(row))


def error_rate(records: DataFrame, before: DataFrame, key: str, arrival: str, row: str, target: float = TARGET) -> DataFrame:
    """One row ``n_keys, n_absent, n_wrong, false_positive_rate, target``: the filters asked for keys that are known to be absent.

    Every first arrival is asked for again with a suffix that no key has (a line end),
    after all keys are in, so that the filters are as full as they get.
    """
    _, first = route(records, before, key, arrival, row)
    keys = first.count()
    shards = max(1, -(-keys // SHARD_KEYS), min(64, -(-keys // 20_000)))
    absent = first.select("row", F.concat("key", F.lit("\n")).alias("key"), F.lit(ASK_ONLY).cast("long").alias("arrival"), F.lit(True).alias("wanted")).dropDuplicates(["key"])
    every = first.withColumn("wanted", F.lit(False)).unionByName(absent)
    wrong = filter_claims(every, shards, keys, target)
    asked = absent.agg(F.count(F.lit(1)).alias("n_absent"))
    return wrong.agg(F.count(F.lit(1)).alias("n_wrong")).join(asked).select(
        F.lit(keys).cast("long").alias("n_keys"), "n_absent", "n_wrong", (F.col("n_wrong") / F.greatest(F.col("n_absent"), F.lit(1))).alias("false_positive_rate"), F.lit(target).alias("target")
    )
