"""Embedding near-duplicates: spherical k-means cells, blocked cosine products inside them.

Equal vectors of a label become one class first.  Centroids are fitted for each
label on a bounded sample; every class has a home cell, the nearest, and is a
guest in each other cell whose border is so near that a partner may live
behind it.  The rule is exact: a partner within the threshold is never missed.
Cells are cut into blocks of about ``BLOCK`` vectors and each pair of blocks is
one group, whose task returns one row for each class that has links there:
how many vectors it is linked with, and a hub that its links lead to.  So a
group of n near copies makes about n rows, not n squared.

A class is written once, with the list of its cells; its vector, as it was
given, is only repeated on the way to the blocks, and tasks make the unit
vectors.  So what a task holds is bounded by a slice of rows or two blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import components, stash

#: Bound of the sample that centroids are fitted on.
SAMPLE = 20_000
#: Vectors in a cell, as aimed at; and sampled vectors for a centroid, at least.
CELL, SAMPLED = 4096, 32
BLOCK = 4096
#: Rows that are assigned at once, and rows of a block that are compared at once with all of another.
SLICE, STRIP = 1024, 512
ROUNDS = 10


def _units(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    """Unit vectors of rows whose vectors have one length."""
    vectors = pa.compute.list_flatten(rows["embedding"]).to_numpy().astype(float).reshape(rows.num_rows, -1)
    vectors /= rows["top"].to_numpy()[:, None]  # so that squares neither overflow nor vanish
    vectors /= rows["norm"].to_numpy()[:, None]
    return vectors


def spherical_kmeans(units: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """``k`` unit centroids (fewer if there are fewer different ones) of unit vectors."""
    rng = np.random.default_rng(seed)
    centroids = units[rng.choice(len(units), size=min(k, len(units)), replace=False)]
    for _ in range(rounds):
        home = (units @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, units)
        norms = np.linalg.norm(sums, axis=1)
        centroids = np.where(norms[:, None] > 1e-12, sums / np.maximum(norms, 1e-12)[:, None], centroids)
    return np.unique(centroids, axis=0)


def fit_cells(classes: DataFrame, sample: int = SAMPLE) -> dict:
    """Centroids by (label, dimension); at most ``sample`` classes are fetched for it."""
    sizes = {(r["label"], r["dim"]): r["n"] for r in classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).limit(sample // SAMPLED).collect()}
    rows = classes.orderBy(F.xxhash64("class"), "class").limit(sample).select("label", "dim", "embedding", "top", "norm").toArrow()
    cells = {}
    for key in sorted(set(zip(rows["label"].to_pylist(), rows["dim"].to_pylist()))):
        part = rows.filter(_of(rows, key))
        k = min(math.ceil(sizes.get(key, 0) / CELL), part.num_rows // SAMPLED)
        if k > 1:
            cells[key] = spherical_kmeans(_units(part), k)
    return cells


def _of(rows: pa.Table | pa.RecordBatch, key: tuple[int, int]) -> pa.Array:
    return pa.compute.and_(pa.compute.equal(rows["label"], key[0]), pa.compute.equal(rows["dim"], key[1]))


def _assign(batches: Iterator[pa.RecordBatch], cells: dict, reach: float) -> Iterator[pa.RecordBatch]:
    """The rows with each class's home and the list of its guest cells, a slice at a time."""
    borders = {key: reach * np.sqrt(np.maximum(2 - 2 * centroids @ centroids.T, 1e-12)) for key, centroids in cells.items()}
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            batch = whole.slice(at, SLICE)
            home = np.zeros(batch.num_rows, np.int32)
            rows, guests = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for key in set(zip(batch["label"].to_pylist(), batch["dim"].to_pylist())) & cells.keys():
                own = np.flatnonzero(_of(batch, key).to_numpy(zero_copy_only=False))
                near = _units(batch.take(pa.array(own))) @ cells[key].T
                best = near.argmax(axis=1)
                visits = near.max(axis=1)[:, None] - near <= borders[key][best]
                visits[np.arange(len(own)), best] = False
                home[own] = best
                r, cell = np.nonzero(visits)
                rows.append(own[r])
                guests.append(cell)
            places = np.concatenate(rows)
            ends = np.cumsum(np.bincount(places, minlength=batch.num_rows))
            listed = pa.array(np.concatenate(guests)[np.argsort(places, kind="stable")], pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), listed)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), lists], [*batch.schema.names, "home", "guests"])


def _strips(linked: np.ndarray, function) -> np.ndarray:
    """One value for each row of ``linked``, some rows at a time."""
    return np.concatenate([function(linked[at : at + STRIP]) for at in range(0, len(linked), STRIP)] or [np.zeros(0, np.int64)])


def _compare(left: pa.Table, right: pa.Table, threshold: float, how: str) -> pa.Table:
    """Links between two blocks: one row (class, links, hub) for each class that has any."""
    a, b = _units(left), _units(right)
    (ia, ca), (ib, cb) = ((side["class"].to_numpy(), side["copies"].to_numpy()) for side in (left, right))
    linked = np.empty((len(a), len(b)), bool)
    for at in range(0, len(a), STRIP):
        np.greater_equal(a[at : at + STRIP] @ b.T, threshold, out=linked[at : at + STRIP])
    if how == "same":
        linked = np.triu(linked, 1)
    elif how == "guests":  # each pair where its smaller class is the guest
        linked &= ib[None, :] < ia[:, None]
    rows, columns = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    linked = linked[np.ix_(rows, columns)]
    ia, ib = ia[rows], ib[columns]
    up, down = ia.copy(), ib.copy()
    far = np.iinfo(np.int64).max
    while len(rows):
        new_up = np.minimum(up, _strips(linked, lambda part: np.where(part, down[None, :], far).min(axis=1)))
        new_down = np.minimum(down, _strips(linked.T, lambda part: np.where(part, new_up[None, :], far).min(axis=1)))
        if (new_up == up).all() and (new_down == down).all():
            break
        up, down = new_up, new_down
    links = _strips(linked, lambda part: part @ cb[columns]), _strips(linked.T, lambda part: part @ ca[rows])
    return pa.table({"class": np.concatenate((ia, ib)), "links": np.concatenate(links).astype(np.int64), "hub": np.concatenate((up, down))})


def near_links(classes: DataFrame, threshold: float, cells: dict) -> DataFrame:
    """``class, links, hub`` from every pair of blocks; sum the links of a class, unite it with its hubs."""
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    vector = ["class", "copies", "embedding", "top", "norm"]
    read = classes.select("label", "dim", *vector)
    where = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in read.schema.fields) + ", home int, guests array<int>"
    placed = stash(read.mapInArrow(lambda b: _assign(b, cells, reach), where), "cells")
    every = F.concat(F.array(F.struct(F.col("home").alias("cell"), F.lit(True).alias("home"))), F.transform("guests", lambda c: F.struct(c.alias("cell"), F.lit(False).alias("home"))))
    key = ["label", "dim", "cell"]
    counts = placed.select("label", "dim", F.inline(every)).groupBy(*key).agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("guests"))
    counts = stash(counts.select(*key, F.ceil(F.col("homes") / BLOCK).cast("int").alias("hb"), F.ceil(F.col("guests") / BLOCK).cast("int").alias("gb")).where("hb > 0"), "blocks")
    rows = placed.select("label", "dim", *vector, F.inline(every)).join(counts, key).withColumn("block", F.pmod(F.xxhash64("class"), F.when(F.col("home"), F.col("hb")).otherwise(F.col("gb"))).cast("int"))

    def span(first, last):
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    def sent(blocks, i, j, kind, left):
        return F.transform(blocks, lambda x: F.struct(i(x).alias("i"), j(x).alias("j"), F.lit(kind).alias("kind"), F.lit(left).alias("left")))

    own = lambda x: F.col("block")
    other = lambda x: x
    zero, one = F.lit(0), F.lit(1)
    homes = F.concat(
        sent(span(F.col("block"), F.col("hb") - one), own, other, "homes", True),
        sent(span(zero, F.col("block") - one), other, own, "homes", False),
        sent(span(zero, F.col("gb") - one), own, other, "guests", True),
    )
    guests = sent(span(zero, F.col("hb") - one), other, own, "guests", False)
    dealt = rows.select(*key, *vector, F.inline(F.when(F.col("home"), homes).otherwise(guests)))

    def run(group: pa.Table) -> pa.Table:
        left, right = group.filter(group["left"]), group.filter(pa.compute.invert(group["left"]))
        kind, i, j = (group[c][0].as_py() for c in ("kind", "i", "j"))
        if kind == "homes" and i == j:
            return _compare(left, left, threshold, "same")
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("class", "links", "hub")})
        return _compare(left, right, threshold, kind)

    return dealt.groupBy(*key, "kind", "i", "j").applyInArrow(run, "class long, links long, hub long")


def embedding_groups(vectors: DataFrame, threshold: float = 0.93, sample: int = SAMPLE) -> DataFrame:
    """One row for each row of ``vectors``: ``vec_id, n_links, component_id, kept``.

    Vectors are compared when their labels are equal and not null and their
    lengths are equal; null and zero vectors and those with null or non-finite
    components link with nothing.  Equal vectors link like any others.  Other
    columns are not read; an empty table gives an empty result.
    """
    value = F.col("embedding").cast("array<double>")
    sound = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.coalesce(sound, F.lit(False)), F.col("label").cast("long")).alias("label"), (F.col("embedding") if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else value).alias("embedding"))
    fit = rows.where("label is not null").groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("low"))
    top = F.array_max(F.transform(value, F.abs))  # so that squares neither overflow nor vanish
    scaled = F.transform(value, lambda x: x / F.col("top"))
    fit = fit.withColumn("top", top).withColumn("scaled", scaled).withColumn("norm", F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda s, x: s + x * x)))
    fit = fit.select("label", "embedding", "copies", "low", F.size("embedding").alias("dim"), "top", "norm")
    classes = stash(fit.withColumn("class", F.monotonically_increasing_id()), "classes")
    links = stash(near_links(classes, threshold, fit_cells(classes, sample)), "links")
    groups = components(links.select(F.col("class").alias("a"), F.col("hub").alias("b")), "vectors").withColumnRenamed("node", "class")
    counts = links.groupBy("class").agg(F.sum("links").alias("links"))
    known = classes.select("class", "low", "copies", "label", "embedding").join(groups, "class", "left").join(counts, "class", "left")
    known = stash(known.withColumn("component", F.coalesce("component", "class")), "known")
    lows = stash(known.groupBy("component").agg(F.min("low").alias("component_id")), "lows")
    known = stash(known.join(lows, "component").select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "named")
    lone = rows.where("label is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = rows.where("label is not null").join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id").unionByName(lone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
