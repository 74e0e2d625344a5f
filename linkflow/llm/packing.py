"""Filling containers of fixed capacity with whole documents (problem 8).

A plan is made from the histogram of sizes, which is bounded by the capacity whatever the
number of documents. Sizes are put into classes; patterns of a few classes that nearly
fill a container are enumerated, their repeat counts are fitted to the histogram by
non-negative least squares and rounded down; what is left (residuals) goes, longest
first, into the tightest gap that takes it, or into new containers. Plans hold runs of
equal containers, not containers, so their size is bounded too.

Documents meet the plan by their rank among those of the same size. Ranks are counted
per input partition and offset by the counts of the partitions before, so that no task
sees all documents of a frequent size.

A document above the capacity is cut into full containers and one rest; no other is cut.
Documents without tokens (null and empty texts) need no container and give no row.
"""

from __future__ import annotations

import itertools
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkflow.llm.tokens import VOCABULARY, sized
from linkflow.session import materialize

#: Size classes, documents of a pattern, and the least fill of a pattern by its classes' upper bounds.
CLASSES, MEMBERS, LEAST_FILL = 22, 4, 0.97
#: Part of a container that a pattern's documents may leave empty; what fits worse is left to the residuals.
SLACK = 0.002


def nnls(a: np.ndarray, b: np.ndarray, limit: int = 300) -> np.ndarray:
    """Non-negative least squares by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x = np.zeros(n)
    on = np.zeros(n, bool)
    tolerance = 1e-9 * max(1.0, np.abs(a.T @ b).max())
    for _ in range(limit):
        w = a.T @ (b - a @ x)
        w[on] = -np.inf
        k = int(np.argmax(w))
        if on.all() or w[k] <= tolerance:
            break
        on[k] = True
        while True:
            s = np.zeros(n)
            s[on] = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if s[on].min() > 0:
                x = s
                break
            down = on & (s <= 0)
            step = np.min(x[down] / np.maximum(x[down] - s[down], 1e-300))
            x = x + step * (s - x)
            on &= x > 1e-12
            x[~on] = 0
            if not on.any():
                break
    return x


def classes(sizes: np.ndarray, counts: np.ndarray, k: int = CLASSES) -> np.ndarray:
    """Upper bounds of at most ``k`` classes of like volume."""
    volume = np.cumsum(sizes * counts)
    cuts = np.searchsorted(volume, volume[-1] * np.arange(1, k + 1) / k)
    return np.unique(sizes[np.minimum(cuts, len(sizes) - 1)])


def patterns(bounds: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Class numbers of up to ``MEMBERS`` documents that surely fit and fill the container well."""
    out = []
    for n in range(1, MEMBERS + 1):
        for p in itertools.combinations_with_replacement(range(len(bounds)), n):
            if LEAST_FILL * capacity <= sum(bounds[i] for i in p) <= capacity:
                out.append(p)
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Runs of equal containers, ``(number, sizes)``, that hold the whole histogram (size to count, sizes 1 to capacity)."""
    left = {s: c for s, c in histogram.items() if c > 0}
    runs: list[tuple[int, list[int]]] = []
    if not left:
        return runs
    sizes = np.array(sorted(left))
    bounds = classes(sizes, np.array([left[s] for s in sizes]))
    of_class = np.searchsorted(bounds, sizes)
    shapes = patterns(bounds, capacity)
    if shapes:
        a = np.zeros((len(bounds), len(shapes)))
        for j, p in enumerate(shapes):
            for i in p:
                a[i, j] += 1
        h = np.bincount(of_class, [left[s] for s in sizes], len(bounds))
        scale = bounds / capacity  # a class counts by its volume
        repeats = np.floor(nnls(a * scale[:, None], h * scale) + 1e-9).astype(int)
        members = [[int(s) for s in sizes[of_class == i]][::-1] for i in range(len(bounds))]
        for j in np.argsort(-repeats):
            need = int(repeats[j])
            while need > 0:
                chosen: list[int] = []
                for i in shapes[j][1:]:
                    s = next((s for s in members[i] if left.get(s, 0) > chosen.count(s)), None)
                    if s is None:
                        break
                    chosen.append(s)
                # the first document of the pattern closes the gap as tightly as there is a size for it
                gap = capacity - sum(chosen)
                at = int(np.searchsorted(sizes, gap, side="right")) - 1
                while at >= 0 and left[int(sizes[at])] <= chosen.count(int(sizes[at])):
                    at -= 1
                s = int(sizes[at]) if at >= 0 else None
                if len(chosen) < len(shapes[j]) - 1 or s is None or gap - s > capacity * SLACK:
                    break
                chosen.append(s)
                n = min(need, *(left[s] // chosen.count(s) for s in chosen))
                for s in chosen:
                    left[s] -= n
                runs.append((n, chosen))
                need -= n
    # residuals: longest first into the tightest gap, else into new containers
    gaps: list[tuple[int, int]] = []  # (gap, run number), sorted
    content = [list(c) for _, c in runs]
    number = [n for n, _ in runs]
    for k, c in enumerate(content):
        gap = capacity - sum(c)
        if gap:
            gaps.append((gap, k))
    gaps.sort()
    for s in sorted(left, reverse=True):
        c = left[s]
        while c > 0:
            at = bisect_left(gaps, (s, -1))
            if at == len(gaps):
                break
            gap, k = gaps.pop(at)
            each = min(gap // s, c)
            n = min(number[k], c // each)
            if n < number[k]:  # the rest of the run keeps its gap
                content.append(list(content[k]))
                number.append(number[k] - n)
                insort(gaps, (gap, len(content) - 1))
                number[k] = n
            content[k] += [s] * each
            c -= n * each
            if gap - each * s:
                insort(gaps, (gap - each * s, k))
        if c > 0:
            each = capacity // s
            for n, m in ((c // each, each), (1 if c % each else 0, c % each)):
                if n:
                    content.append([s] * m)
                    number.append(n)
                    if capacity - m * s:
                        insort(gaps, (capacity - m * s, len(content) - 1))
    return [(n, c) for n, c in zip(number, content, strict=True) if n]


def slots(runs: list[tuple[int, list[int]]]) -> pd.DataFrame:
    """Where the documents of a size go by rank: ``size, start, each, bin`` - from rank ``start`` on, ``each`` to a container from ``bin`` on."""
    rows, start, first = [], {}, 0
    for n, sizes in runs:
        for s in sorted(set(sizes)):
            each = sizes.count(s)
            at = start.get(s, 0)
            rows.append((s, at, each, first))
            start[s] = at + n * each
        first += n
    return pd.DataFrame(rows, columns=["size", "start", "each", "bin"], dtype=np.int64).sort_values(["size", "start"], ignore_index=True)


PACKED = "container string, bin long, doc_id long, piece long, tokens long"


def pack(documents: DataFrame, specs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``container, bin, doc_id, piece, tokens``: one row per piece of a document for each container kind.

    ``specs`` (``container, capacity``) is a table of settings and is read to the driver;
    kinds without a positive capacity are left out.
    """
    spark = documents.sparkSession
    kinds = [(r["container"], int(r["capacity"])) for r in specs.where("capacity > 0 and container is not null").distinct().orderBy("container").collect()]
    if not kinds:
        return spark.createDataFrame([], PACKED)
    docs = materialize(sized(documents, path).where("tokens > 0").select("doc_id", "tokens").withColumn("part", F.spark_partition_id()))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("container"), F.lit(c).cast("long").alias("capacity")) for n, c in kinds]))
    pieces = (
        docs.select("*", each.alias("k"))
        .select("doc_id", "tokens", "part", "k.*")
        .withColumn("full", F.when(F.col("tokens") > F.col("capacity"), F.call_function("div", F.col("tokens"), F.col("capacity"))).otherwise(F.lit(0)))
        .withColumn("size", F.col("tokens") - F.col("full") * F.col("capacity"))
    )
    # at most one row per container kind and size: bounded by the capacities
    counts = pieces.groupBy("container", "size").agg(F.count(F.lit(1)).alias("n")).collect()
    plans = {}
    bins = {}
    for name, capacity in kinds:
        runs = plan({r["size"]: r["n"] for r in counts if r["container"] == name and r["size"] > 0}, capacity)
        plans[name] = slots(runs)
        bins[name] = sum(n for n, _ in runs)
    local = Window.partitionBy("container", "size", "part").orderBy("doc_id")
    per_part = pieces.groupBy("container", "size", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("container", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = pieces.where("size > 0").withColumn("rank", F.row_number().over(local) - 1).join(offsets, ["container", "size", "part"]).withColumn("rank", F.col("rank") + F.col("offset"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = {k: (v["size"].to_numpy() * 2**40 + v["start"].to_numpy(), v["start"].to_numpy(), v["each"].to_numpy(), v["bin"].to_numpy()) for k, v in plans.items()}
        for f in frames:
            out = np.zeros(len(f), np.int64)
            names, rank, size = f["container"].to_numpy(), f["rank"].to_numpy(), f["size"].to_numpy()
            for name in set(names):
                here = names == name
                key, start, each_, first = table[name]
                at = np.searchsorted(key, size[here] * 2**40 + rank[here], side="right") - 1
                out[here] = first[at] + (rank[here] - start[at]) // each_[at]
            yield pd.DataFrame({"container": f["container"], "bin": out, "doc_id": f["doc_id"], "piece": f["full"], "tokens": size})

    rests = ranked.select("container", "size", "rank", "doc_id", "full").mapInPandas(place, PACKED)
    # full containers of documents above the capacity are numbered after the plan's
    large = pieces.where("full > 0")
    inside = Window.partitionBy("container", "part").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    parts = large.groupBy("container", "part").agg(F.sum("full").alias("n"))
    shift = parts.withColumn("shift", F.coalesce(F.sum("n").over(Window.partitionBy("container").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    base = F.create_map(*[F.lit(x) for n, b in bins.items() for x in (n, b)])
    whole = (
        large.withColumn("at", F.coalesce(F.sum("full").over(inside), F.lit(0)))
        .join(shift, ["container", "part"])
        .select("container", "doc_id", "capacity", "at", "shift", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece"))
        .select("container", (base[F.col("container")] + F.col("at") + F.col("shift") + F.col("piece")).cast("long").alias("bin"), "doc_id", "piece", F.col("capacity").alias("tokens"))
    )
    return rests.unionByName(whole)


def fill_rates(documents: DataFrame, specs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``container, capacity, n_pieces, n_bins, tokens, fill_rate`` per container kind; kinds without a piece give no row."""
    per_bin = pack(documents, specs, path).groupBy("container", "bin").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    total = per_bin.groupBy("container").agg(F.sum("n").alias("n_pieces"), F.count(F.lit(1)).alias("n_bins"), F.sum("tokens").alias("tokens"))
    return total.join(specs.select("container", F.col("capacity").cast("long")).distinct(), "container").select(
        "container", "capacity", "n_pieces", "n_bins", "tokens", (F.col("tokens") / (F.col("n_bins") * F.col("capacity"))).alias("fill_rate")
    )
