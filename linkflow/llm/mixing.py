"""Mixing sources to target shares of tokens (problem 9).

The total is as large as the caps allow (or given): every source contributes its share of
it, so a document of source ``s`` is to be used ``share * total / tokens(s)`` times,
which is at most its cap. The whole part is given to every document; the fraction is
decided by the pivotal method: two documents with fractional probabilities trade token
mass, in a random direction that keeps both expectations, until one is used or not. The
source's token mass stays the same in each trade. Each partition leaves at most one
undecided document per source; these meet in a reduction tree, and the last one is drawn.
Large documents are decided first and the others' rate makes up for the outcome, so a
source's reached tokens differ from its budget by less than one document of 1 % of it. A
document above its source's whole budget is not used.

Draws are seeded by partition, source and level: the same input gives the same mix.
Documents without tokens, without a source, or of a source without a target are not used.
Sources with a target but without tokens are reported with share 0 and don't hold back
the others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkflow.llm.tokens import VOCABULARY, sized
from linkflow.session import materialize

FAN = 32
#: A document above this share of its source's budget is large.
LARGE = 0.01
MIXED = "doc_id long, source string, tokens long, copies long, p double, part long"


def trade(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Pivotal method: probabilities after trading; at most one stays between 0 and 1, and ``sum(p * size)`` is kept."""
    out = p.astype(float).copy()
    draws = rng.random(len(out))
    a = -1
    for b in range(len(out)):
        if not 0 < out[b] < 1:
            continue
        if a < 0:
            a = b
            continue
        up = min((1 - out[a]) * size[a], out[b] * size[b])
        down = min(out[a] * size[a], (1 - out[b]) * size[b])
        if draws[b] * (up + down) < down:
            move = up
        else:
            move = -down
        x, y = out[a] + move / size[a], out[b] - move / size[b]
        x = 0.0 if x < 1e-12 else 1.0 if x > 1 - 1e-12 else x
        y = 0.0 if y < 1e-12 else 1.0 if y > 1 - 1e-12 else y
        out[a], out[b] = x, y
        if not 0 < x < 1:
            a = b if 0 < y < 1 else -1
    return out


def rates(available: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """Uses per document of each source, for the largest total that all caps allow or for ``total`` (cut to the caps)."""
    live = {s: (share, cap) for s, (share, cap) in targets.items() if share > 0 and available.get(s, 0) > 0}
    if not live:
        return {}
    top = min(cap * available[s] / share for s, (share, cap) in live.items())
    t = top if total is None else total
    return {s: min(float(cap), share * t / available[s]) for s, (share, cap) in live.items()}


def _settle(f: pd.DataFrame, seed: int, last: bool) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    p = trade(f["p"].to_numpy(), f["tokens"].to_numpy(), rng)
    if last:
        p = np.where((p > 0) & (p < 1), rng.random(len(p)) < p, p).astype(float)
    done = (p <= 0) | (p >= 1)
    return f.assign(copies=f["copies"] + np.where(done, p, 0).astype(np.int64), p=np.where(done, 0.0, p))


def _seed(seed: int, *parts) -> int:
    return zlib.crc32(repr((seed, *parts)).encode())


def _meet(seed: int, step: int, last: bool):
    """A node of the reduction tree: at most ``FAN`` undecided documents of a source."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["doc_id", "tokens"])
        return _settle(f, _seed(seed, "level", step, int(f["part"].iloc[0]), f["source"].iloc[0]), last)

    return run


def pivot(docs: DataFrame, rate: dict[str, float], seed: int) -> DataFrame:
    """``doc_id, source, tokens, copies`` of documents whose source has a rate: whole copies, and the fraction by the pivotal method."""

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        open_: dict[str, pd.DataFrame] = {}
        for k, f in enumerate(frames):
            f = f[f["source"].isin(list(rate))]
            if not len(f):
                continue
            r = f["source"].map(rate).to_numpy(float)
            whole = np.floor(r + 1e-12)
            f = f.assign(copies=whole.astype(np.int64), p=np.clip(r - whole, 0, 1), part=part)
            f.loc[f["p"] < 1e-12, "p"] = 0.0
            for s, g in f.groupby("source", sort=True):
                if s in open_:
                    g = pd.concat([open_.pop(s), g], ignore_index=True)
                g = _settle(g, _seed(seed, part, s, k), False)
                held = g["p"] > 0
                if held.any():
                    open_[s] = g[held]
                yield g[~held]
        yield from open_.values()

    level = materialize(docs.select("doc_id", "source", "tokens").mapInPandas(first, MIXED))
    out, rest = level.where("p = 0"), level.where("p > 0")
    groups = (level.agg(F.max("part")).first()[0] or 0) + 1
    step, last = 0, False
    while not last:
        step += 1
        last = FAN**step >= groups
        level = materialize(rest.withColumn("part", F.call_function("div", F.col("part"), F.lit(FAN))).groupBy("source", "part").applyInPandas(_meet(seed, step, last), MIXED))
        out, rest = out.unionByName(level.where("p = 0")), level.where("p > 0")
    return out.select("doc_id", "source", "tokens", "copies")


def _sums(df: DataFrame, value) -> dict[str, int]:
    """Per source, one row per target."""
    return {r["source"]: r["n"] or 0 for r in df.groupBy("source").agg(F.sum(value).alias("n")).collect()}


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, path: str = VOCABULARY, seed: int = 7) -> DataFrame:
    """``doc_id, source, tokens, copies`` of the documents that are used at least once.

    ``targets`` (``source, target_share, max_repeats``) is a table of settings and is read
    to the driver. A document's ``copies`` are at most its source's ``max_repeats``.
    """
    goal = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in targets.where("source is not null").collect()}
    docs = materialize(sized(documents, path).where("tokens > 0 and source is not null"))
    known = docs.where(F.col("source").isin(list(goal))) if goal else docs.limit(0)
    available = _sums(known, F.col("tokens"))
    rate = rates(available, goal, total)
    if not rate:
        return docs.limit(0).select("doc_id", "source", "tokens", F.lit(0).cast("long").alias("copies"))
    budget = {s: r * available[s] for s, r in rate.items()}
    of = F.try_element_at(F.create_map(*[F.lit(x) for kv in budget.items() for x in kv]), F.col("source"))
    # large documents first: what they leave of a source's budget is made up by the others
    large = materialize(pivot(known.where((F.col("tokens") > of * LARGE) & (F.col("tokens") <= of)), rate, seed))
    used = _sums(large, F.col("tokens") * F.col("copies"))
    small = known.where(F.col("tokens") <= of * LARGE)
    there = _sums(small, F.col("tokens"))
    rest = {s: min(float(goal[s][1]), max(0.0, b - used.get(s, 0)) / there[s]) for s, b in budget.items() if there.get(s)}
    return large.unionByName(pivot(small, rest, seed + 1)).where("copies > 0")


def shares(documents: DataFrame, targets: DataFrame, total: float | None = None, path: str = VOCABULARY, seed: int = 7) -> DataFrame:
    """``source, target_share, max_repeats, mixed_tokens, n_docs, max_copies, actual_share`` of the mix, a row per target."""
    used = mix(documents, targets, total, path, seed).groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("copies").alias("max_copies")
    )
    used = materialize(used)
    whole = used.agg(F.sum("mixed_tokens")).first()[0] or 1
    zero = F.lit(0).cast("long")
    return targets.join(used, "source", "left").select(
        "source",
        "target_share",
        "max_repeats",
        F.coalesce("mixed_tokens", zero).alias("mixed_tokens"),
        F.coalesce("n_docs", zero).alias("n_docs"),
        F.coalesce("max_copies", zero).alias("max_copies"),
        (F.coalesce("mixed_tokens", zero) / F.lit(whole)).alias("actual_share"),
    )
