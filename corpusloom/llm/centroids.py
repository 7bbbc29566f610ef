"""Centroid clustering over Hilbert-ordered blocks with zone maps.

Vectors become integers, are sorted along a Hilbert curve through all their
dimensions and cut into blocks; each block carries the least and greatest
value of every component (its box).  In a round, the distances of a block's
box to the centroids bound those of its vectors: a centroid whose least
possible distance is over the greatest possible one to some other centroid can
be nearest to none of them.  The block is compared exactly with what is left.

Sums, counts and distances are exact integers, so results do not depend on how
the vectors are dealt.  Tasks return one row for each cluster and component;
only centroids (``k`` times ``DIM`` numbers) pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import stash

DIM = 64
SCALE = 256
#: Vectors in a block; bits of the curve for each component.
BLOCK, BITS = 256, 4
#: Greater integers are taken as this, so that distances fit into 64 bits.
LARGEST = 1 << 27
_MOST = (1 << 63) - 1


def integers(vector: str | Column = "embedding", dim: int = DIM) -> Column:
    """``floor(256 x)`` of each component; null unless there are ``dim``, all of them finite."""
    value = (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>")
    sound = (F.size(value) == dim) & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    bounded = F.transform(value, lambda x: F.greatest(F.least(F.floor(F.lit(SCALE) * x), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    return F.when(F.coalesce(sound, F.lit(False)), bounded)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def hilbert_keys(values: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int = BITS) -> list[bytes]:
    """Places of integer vectors on a Hilbert curve through the box from ``low`` to ``high``, as bytes in the curve's order."""
    cells = (values - low) * (1 << bits) // np.maximum(high - low + 1, 1)
    axes = np.ascontiguousarray(np.clip(cells, 0, (1 << bits) - 1).T.astype(np.uint8))
    first = axes[0]
    for shift in range(bits - 1, 0, -1):  # undo the turns and reflections of each level
        low_bits = np.uint8((1 << shift) - 1)
        for axis in axes:
            turned = (axis >> shift & 1).astype(bool)
            swap = np.where(turned, np.uint8(0), (first ^ axis) & low_bits)
            first ^= np.where(turned, low_bits, swap)
            if axis is not first:
                axis ^= swap
    axes = np.bitwise_xor.accumulate(axes, axis=0)  # Gray code
    flips = np.zeros(axes.shape[1], np.uint8)
    for shift in range(bits - 1, 0, -1):
        flips ^= np.where(axes[-1] >> shift & 1, np.uint8((1 << shift) - 1), np.uint8(0))
    axes ^= flips
    planes = np.stack([axes >> shift & 1 for shift in range(bits - 1, -1, -1)])  # bit by bit, all axes
    packed = np.packbits(planes.reshape(-1, axes.shape[1]).T, axis=1)
    return [row.tobytes() for row in packed]


def _extremes(rows: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _matrix(batch["v"], dim)
            if len(values):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(values.min(axis=0).astype(np.int64)), pa.array(values.max(axis=0).astype(np.int64))], ["at", "low", "high"])

    found = rows.select("v").mapInArrow(run, "at int, low long, high long").groupBy("at").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    low, high = np.zeros(dim, np.int64), np.zeros(dim, np.int64)
    for r in found:
        low[r["at"]], high[r["at"]] = r["low"], r["high"]
    return low, high


def blocks(vectors: DataFrame, dim: int = DIM, block: int = BLOCK) -> DataFrame:
    """``ids, flat, low, high``: blocks of neighbours on the curve, their vectors one after the other, and their boxes.

    Equal vectors have equal keys; their ids, and row numbers where ids repeat,
    let the range partitioning split them.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integers(dim=dim).alias("v")).where("v is not null")
    low, high = _extremes(rows, dim)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = hilbert_keys(_matrix(batch["v"], dim).astype(np.int64), low, high) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch["row"], batch["vec_id"], batch["v"]], ["key", "row", "vec_id", "v"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, n = _matrix(batch["v"], dim), batch.num_rows
            starts = range(0, n, block)
            ends = [*range(block, n, block), n] if n else []
            offsets = pa.array([0, *ends], pa.int32())
            boxes = [(values[a:b].min(axis=0), values[a:b].max(axis=0)) for a, b in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays([
                pa.ListArray.from_arrays(offsets, batch["vec_id"]),
                pa.array([values[a:b].ravel() for a, b in zip(starts, ends)], pa.list_(pa.int32())),
                pa.array([b[0] for b in boxes], pa.list_(pa.int32())), pa.array([b[1] for b in boxes], pa.list_(pa.int32())),
            ], ["ids", "flat", "low", "high"])

    ordered = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(keyed, "key binary, row long, vec_id long, v array<int>")
    ordered = ordered.repartitionByRange("key", "vec_id", "row").sortWithinPartitions("key", "vec_id", "row").select("vec_id", "v")
    return stash(ordered.mapInArrow(cut, "ids array<long>, flat array<int>, low array<int>, high array<int>"), "blocks")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be nearest to a point of the box, ascending."""
    least = np.maximum(np.maximum(low - centroids, centroids - high), 0)
    most = np.maximum(np.abs(centroids - low), np.abs(centroids - high))
    return np.flatnonzero((least * least).sum(axis=1) <= (most * most).sum(axis=1).min())


def nearest(values: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row its nearest centroid (ties: the smaller number) and the squared distance; exact."""
    largest = max(int(np.abs(values).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if values.shape[1] * (2 * largest) ** 2 < 1 << 53:  # then doubles are exact, whatever the order of the sums
        x, c = values.astype(np.float64), centroids.astype(np.float64)
        apart = ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    else:
        apart = np.stack([((values - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    best = apart.argmin(axis=1)
    return best, apart[np.arange(len(values)), best]


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``values, cluster, distance`` of each block of a batch."""
    dim = centroids.shape[1]
    for flat, low, high in zip(batch["flat"], batch["low"], batch["high"]):
        values = flat.values.to_numpy().reshape(-1, dim).astype(np.int64)
        able = candidates(low.values.to_numpy().astype(np.int64), high.values.to_numpy().astype(np.int64), centroids)
        best, distance = nearest(values, centroids[able])
        yield values, able[best], distance


def _total(values: np.ndarray) -> int:
    """An exact sum of numbers of up to 63 bits."""
    return (int((values >> 31).sum()) << 31) + int((values & ((1 << 31) - 1)).sum())


def totals(table: DataFrame, centroids: np.ndarray) -> dict[int, list[int]]:
    """For each cluster that has vectors the sums of their components, their number and their distances."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [[0] * (dim + 2) for _ in range(k)]
        for batch in batches:
            for values, cluster, distance in _assigned(batch, centroids):
                for c in np.unique(cluster).tolist():
                    own = cluster == c
                    added = [*values[own].sum(axis=0).tolist(), int(own.sum()), _total(distance[own])]
                    sums[c] = [a + b for a, b in zip(sums[c], added)]
        rows = [(c, at, value) for c in range(k) if sums[c][dim] for at, value in enumerate(sums[c])]
        columns = list(zip(*rows)) or [(), (), ()]
        kinds = (pa.int32(), pa.int32(), pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["cluster", "at", "value"])

    parts = table.select("flat", "low", "high").mapInArrow(run, "cluster int, at int, value decimal(38,0)")
    found: dict[int, list[int]] = {}
    for r in parts.groupBy("cluster", "at").agg(F.sum("value").alias("value")).collect():  # at most k (dim + 2) rows
        found.setdefault(r["cluster"], [0] * (dim + 2))[r["at"]] = int(r["value"])
    return found


def fit(table: DataFrame, centroids: np.ndarray, rounds: int, each: Callable[[int, np.ndarray], None] | None = None) -> np.ndarray:
    """Centroids after ``rounds`` of exact means, rounded down; clusters without vectors keep theirs."""
    for i in range(rounds):
        centroids = centroids.copy()
        for c, sums in totals(table, centroids.copy()).items():
            centroids[c] = [s // sums[-2] for s in sums[:-2]]
        if each:
            each(i, centroids)
    return centroids


def starts(vectors: DataFrame, k: int, prefix: str = "2:", dim: int = DIM) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``prefix`` and id, in that order; ties (equal ids) by their components."""
    rows = vectors.select(integers(dim=dim).alias("v"), F.sha2(F.concat(F.lit(prefix), F.coalesce(F.col("vec_id").cast("long").cast("string"), F.lit(""))), 256).alias("h"))
    first = rows.where("v is not null").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in first], np.int64).reshape(-1, dim)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = DIM, block: int = BLOCK) -> DataFrame:
    """One row for each sound row of ``vectors``: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    Vectors without exactly ``dim`` components, or with null or non-finite ones,
    get no row.  With fewer than ``k`` vectors each one starts a centroid.  Null
    ids hash as empty strings; rows with equal ids are vectors of their own.
    Components beyond 2^19 count as 2^19, and sums beyond 63 bits as the
    greatest long.  Other columns are not read; an empty table gives an empty result.
    """
    table = blocks(vectors, dim, block)
    centroids = fit(table, starts(vectors, k, dim=dim), rounds)
    inertia = {c: sums[-1] for c, sums in totals(table, centroids).items()} if len(centroids) else {}
    every = min(sum(inertia.values()), _MOST)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            best, apart = (np.concatenate(part) for part in list(zip(*_assigned(batch, centroids)))[1:])
            own = pa.array([min(inertia.get(c, 0), _MOST) for c in range(len(names))], pa.int64())
            columns = [batch["ids"].flatten(), pa.array(best.astype(np.int32)), pa.array(apart), own.take(pa.array(best)), pa.array(np.full(len(best), every, np.int64)), pa.array(names).take(pa.array(best))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return table.mapInArrow(run, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def pruning(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``blocks, compared, possible`` of a table of blocks: how many centroids their boxes leave of how many."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [len(candidates(a.values.to_numpy().astype(np.int64), b.values.to_numpy().astype(np.int64), centroids)) for a, b in zip(batch["low"], batch["high"])]
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64())], ["left"])

    return table.select("low", "high").mapInArrow(run, "left long").agg(F.count(F.lit(1)).alias("blocks"), F.sum("left").alias("compared"), (F.count(F.lit(1)) * k).alias("possible"))
