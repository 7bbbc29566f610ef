"""SimHash near-duplicates with pigeonring candidate filtering.

Fingerprints are made in Arrow batches.  Candidate pairs come from one
equi-join on 32 bits: of four 16-bit segments on a ring, a pair within three
bits has one segment from which every chain of l segments differs by at most
3 l / 4 bits in total (pigeonring), so that segment is equal and the next one
differs by one bit at most.  One side carries the key, the other its 17
variants; longer chains and the full distance are checked inside the join.
Each document makes a fixed number of rows whatever the input's size.

Texts that share four fifths of their shingles lie up to ten bits apart and
more, many of them too far for a ring of 64 bits.  ``keep_unlike`` takes the
ring's pairs as candidates and, beside them, those that share a band of minima
of the shingles' hashes, drops those whose fingerprints are far apart, and
compares the shingles of the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import components, discard, scratch, stash

SEGMENTS = 4
BITS = 64 // SEGMENTS
SEED = 42
_CHUNK = 1 << 16
#: Minima in a band, and bands: a pair of similarity 0.8 shares no band in one case of 1,400.
MINIMA, BANDS = 6, 24
#: Groups of one band up to this size are compared pair by pair.
GROUP = 16
#: Sets and bytes of a block in which members of larger groups are compared.
ROWS, BYTES = 512, 8 << 20
#: Fingerprints further apart (five standard deviations at similarity 0.8) are of texts that are less alike; from so many shingles on.
FAR, MANY = 24, 64
_FACTORS = np.array([xxhash.xxh64_intdigest(b"%d" % i, SEED) | 1 for i in range(MINIMA * BANDS)], dtype=np.uint64)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Hashes of the word n-grams of one text, repeats included; of fewer words one of all, of none none."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, "<u8")
    line = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) < words:
        hashes = [digest(line, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]
    return np.array(hashes, dtype="<u8")


def _votes(values: np.ndarray) -> int:
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(values), _CHUNK):
        ones += np.unpackbits(values[i : i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash of one text, signed; 0 for null, empty or blank texts."""
    return _votes(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id, mark, fp`` for each row of ``docs``; ``mark`` tells texts of one ``doc_id`` apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py(), words) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["mark"], pa.array(values, pa.int64())], ["doc_id", "mark", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text").mapInArrow(run, "doc_id long, mark long, fp long")


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, BITS * (i % SEGMENTS)).bitwiseAND(F.lit((1 << BITS) - 1).cast("long"))


def _mask(first: int, length: int) -> int:
    bits = 0
    for i in range(first, first + length):
        bits |= ((1 << BITS) - 1) << (BITS * (i % SEGMENTS))
    return bits - (1 << 64) if bits >> 63 else bits


def near_pairs(prints: DataFrame, distance: int = 3) -> DataFrame:
    """All pairs ``a < b`` of the distinct ``prints.fp`` that differ by ``distance`` (3 at most) bits or less; a pair may come more than once."""
    if not 0 <= distance < SEGMENTS:
        raise ValueError("the ring of four segments serves distances of 0 to 3")
    fp = F.col("fp")

    def key(i: int, near: Column) -> Column:
        return (F.lit(i << 2 * BITS).cast("long").bitwiseOR(F.shiftleft(_segment(fp, i), BITS)).bitwiseOR(near)).alias("key")

    own = F.array(*[F.struct(F.lit(i).alias("at"), key(i, _segment(fp, i + 1))) for i in range(SEGMENTS)])
    flips = [0, *(1 << b for b in range(BITS))] if 2 * distance >= SEGMENTS else [0]
    others = F.array(*[key(i, _segment(fp, i + 1).bitwiseXOR(F.lit(f).cast("long"))) for i in range(SEGMENTS) for f in flips])
    left = prints.select(fp.alias("a"), F.inline(own))
    right = prints.select(fp.alias("b"), F.explode(others).alias("key"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    chain = F.lit(True)
    for i in range(SEGMENTS):
        chain = F.when(F.col("at") == i, F.bit_count(differ.bitwiseAND(F.lit(_mask(i, 3)).cast("long"))) <= 3 * distance // SEGMENTS).otherwise(chain)
    # Spark takes keyed sides for as small as the fingerprints, and would broadcast up to 68 rows of each through the driver
    return left.hint("merge").join(right, (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & chain & (F.bit_count(differ) <= distance)).select("a", "b")


def _linked(rows: DataFrame, pairs: DataFrame, prints: DataFrame) -> DataFrame:
    groups = components(pairs, "near")
    known = prints.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", "first", F.coalesce("component", "fp").alias("component"))
    known = stash(known, "known")
    lows = stash(known.groupBy("component").agg(F.min("low").alias("component_id"), F.min("first").alias("first")), "lows")
    named = stash(known.select("fp", "component").join(lows, "component").select("fp", "component_id", "first"), "named")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark"))
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", kept.alias("kept"), "mark")


def _prints(rows: DataFrame, *more: str) -> DataFrame:
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("first")
    return stash(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), first, *[F.min(c).alias(c) for c in more]), "prints")


def _linked_by_bits(docs: DataFrame, words: int, distance: int) -> DataFrame:
    rows = stash(fingerprints(docs, words), "fingerprints")
    prints = _prints(rows)
    return _linked(rows, near_pairs(prints.select("fp"), distance), prints)


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, fingerprint, component_id, kept``.

    Null, empty and blank texts have fingerprint zero and are linked like any
    other.  ``component_id`` is the smallest ``doc_id`` reachable by links;
    ``kept`` marks its row (the least text hash of rows that share an id; rows
    without id come last).  Other columns are not read; empty tables give empty
    results.
    """
    return _linked_by_bits(docs, words, distance).drop("mark")


def keep_one(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of near-duplicates, with all their columns."""
    with scratch(docs.sparkSession) as keep:
        kept = keep(_kept_marks(_linked_by_bits(docs, words, distance)))
    return _kept(docs, kept)


def _kept_marks(linked: DataFrame) -> DataFrame:
    return stash(linked.where("kept").select(F.col("doc_id").alias("kept_id"), F.col("mark").alias("kept_mark")), "kept")


def _kept(docs: DataFrame, kept: DataFrame) -> DataFrame:
    once = kept.distinct()
    out = docs.join(once, docs["doc_id"].eqNullSafe(once["kept_id"]) & (F.xxhash64(docs["text"]) == once["kept_mark"]), "left_semi")
    repeated = not kept.groupBy("kept_id", "kept_mark").count().where("count > 1").isEmpty()
    return out.dropDuplicates(["doc_id", "text"]) if repeated else out


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, mark, fp, bits, n, bands``: a hash of the set of shingles, its SimHash and size, and a key for each band of minima."""

    def sketch(text: str | None) -> tuple[int, int, int, list[int]]:
        values = shingle_hashes(text, words)
        own = np.unique(values)
        if not len(own):
            return 0, 0, 0, []
        low = np.full(MINIMA * BANDS, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(own), 1024):
            low = np.minimum(low, (own[i : i + 1024, None] * _FACTORS).min(axis=0))
        bands = [xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(low.reshape(BANDS, MINIMA))]
        signed = np.array([xxhash.xxh64_intdigest(own.tobytes(), SEED), *bands], "<u8").view("<i8").tolist()
        return signed[0], _votes(values), len(own), signed[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, bits, n, bands = zip(*(sketch(t.as_py()) for t in batch["text"])) if batch.num_rows else ((), (), (), ())
            columns = [pa.array(fp, pa.int64()), pa.array(bits, pa.int64()), pa.array(n, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["mark"], *columns], ["doc_id", "mark", "fp", "bits", "n", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text").mapInArrow(run, "doc_id long, mark long, fp long, bits long, n long, bands array<long>")


def _candidates(groups: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of ``groups(key, node, n, low)``: all of a small group, of a larger one those with its least node."""
    small = groups.where(F.col("n") <= GROUP).select("key", "node")
    near = small.join(small.withColumnRenamed("node", "b"), "key").where(F.col("node") < F.col("b")).select(F.col("node").alias("a"), "b")
    return near.unionByName(groups.where((F.col("n") > GROUP) & (F.col("node") != F.col("low"))).select(F.col("low").alias("a"), F.col("node").alias("b")))


def _ring_candidates(prints: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of ``prints(fp, bits, n)`` by the pigeonring: one set of shingles stands for each fingerprint, and others of the same one meet it."""
    sets = prints.where("n > 0").select("fp", "bits")
    heads = stash(sets.groupBy("bits").agg(F.min("fp").alias("head")), "heads")
    of = lambda side: heads.select(F.col("bits").alias(side), F.col("head").alias(f"head_{side}"))
    ring = near_pairs(heads.select(F.col("bits").alias("fp"))).distinct().join(of("a"), "a").join(of("b"), "b")
    apart = ring.select(F.least("head_a", "head_b").alias("a"), F.greatest("head_a", "head_b").alias("b"))
    return apart.unionByName(sets.join(heads, "bits").where("fp <> head").select(F.col("head").alias("a"), F.col("fp").alias("b")))


def _alike(pairs: DataFrame, docs: DataFrame, prints: DataFrame, words: int, similarity: float) -> DataFrame:
    """The ``pairs`` whose sets of shingles have a Jaccard similarity of ``similarity`` at least."""
    of = lambda side: prints.select(F.col("fp").alias(side), F.col("bits").alias(f"bits_{side}"), F.col("n").alias(f"n_{side}"))
    sizes = F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-9
    close = (F.least("n_a", "n_b") < MANY) | (F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b"))) <= FAR)
    pairs = stash(pairs.join(of("a"), "a").join(of("b"), "b").where(sizes & close).select("a", "b"), "candidates")
    texts = stash(_texts(docs, prints, pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()), "texts")
    both = pairs.join(texts.select(F.col("fp").alias("a"), F.col("text").alias("first")), "a").join(texts.select(F.col("fp").alias("b"), F.col("text").alias("second")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right = []
            for x, y in zip(batch["first"], batch["second"]):
                x, y = (np.unique(shingle_hashes(t.as_py(), words)) for t in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                right.append(shared >= similarity * (len(x) + len(y) - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(right, pa.bool_()))

    alike = stash(both.select("a", "b", "first", "second").mapInArrow(run, "a long, b long"), "alike")
    discard(pairs, texts)
    return alike


def _texts(docs: DataFrame, prints: DataFrame, needed: DataFrame) -> DataFrame:
    """``fp, text`` of the ``needed`` sets of shingles, one text for each."""
    marks = prints.join(needed, "fp").select("fp", F.col("first.doc_id").alias("id"), F.col("first.mark").alias("of"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").join(marks, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("of")))
    return texts.select("fp", "text").dropDuplicates(["fp"])


def linked_sets(left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places ``i, j`` of the sets (ascending hashes) whose Jaccard similarity is ``similarity`` at least; exact."""
    flat, sizes = np.concatenate(right), np.array([len(s) for s in right])
    vocabulary, number = np.unique(flat, return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    marked, i, j = np.zeros(len(vocabulary) + 1, np.int64), [], []
    for at, own in enumerate(left):
        places = np.searchsorted(vocabulary, own)
        places = places[(vocabulary[np.minimum(places, len(vocabulary) - 1)] == own)]
        marked[places] = 1
        shared = np.add.reduceat(marked[number], starts)
        marked[places] = 0
        hits = np.flatnonzero(shared >= similarity * (len(own) + sizes - shared) - 1e-9)
        i.append(np.full(len(hits), at))
        j.append(hits)
    return np.concatenate(i), np.concatenate(j)


def hubs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between nodes as one link for each node: to the least node that it is connected with here."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while True:
        lower = least.copy()
        np.minimum.at(lower, i, least[j])
        np.minimum.at(lower, j, least[i])
        lower = lower[lower]
        if (lower == least).all():
            break
        least = lower
    other = least != np.arange(len(nodes))
    return nodes[least[other]], nodes[other]


def links_in_groups(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links ``a, b`` that connect what is linked inside groups of any size: ``members(key, node, probe)``, ``sets(node, hashes)``.

    A group's probes are compared with all its members, block by block, exactly
    and inside tasks.  Of the links of two blocks one for each node leaves the
    task, so groups of near copies make no pairs.  Blocks hold ``ROWS`` sets and
    ``BYTES`` of hashes, or one longer set.
    """
    rows = stash(members.join(sets, "node"), "members")

    def blocks(which: Column) -> Column:
        size = F.sum(F.when(which, F.octet_length("hashes")))
        return F.greatest(F.ceil(F.count_if(which) / ROWS), F.ceil(size / BYTES), F.lit(1)).cast("int")

    sizes = stash(rows.groupBy("key").agg(blocks(F.col("probe")).alias("probes"), blocks(F.lit(True)).alias("all")), "sizes")
    dealt = rows.join(sizes, "key").withColumn("h", F.xxhash64("node"))
    span = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = F.pmod("h", F.col("all")).cast("int")
    as_member = F.transform(span("probes"), lambda i: F.struct(i.alias("i"), own.alias("j"), F.lit(False).alias("asks")))
    as_probe = F.transform(span("all"), lambda j: F.struct(F.pmod("h", F.col("probes")).cast("int").alias("i"), j.alias("j"), F.lit(True).alias("asks")))
    sent = dealt.select("key", "node", "hashes", F.inline(F.when(F.col("probe"), F.concat(as_member, as_probe)).otherwise(as_member)))

    def run(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy(zero_copy_only=False)
        nodes = table["node"].to_numpy()
        hashes = [np.frombuffer(h, "<u8") for h in table["hashes"].to_pylist()]
        left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
        if not len(left) or not len(right):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        i, j = linked_sets([hashes[k] for k in left], [hashes[k] for k in right], similarity)
        a, b = hubs(nodes[left[i]], nodes[right[j]])
        return pa.table({"a": a, "b": b})

    return sent.groupBy("key", "i", "j").applyInArrow(run, "a long, b long").distinct()


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """``node, hashes``: the ascending hashes of a text's distinct shingles, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [np.unique(shingle_hashes(t.as_py(), words)).tobytes() for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["fp"], pa.array(hashes, pa.binary())], ["node", "hashes"])

    return texts.mapInArrow(run, "node long, hashes binary")


def similar_pairs(docs: DataFrame, rows: DataFrame, prints: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links ``a, b`` between the distinct ``prints.fp``; those of one class so far may be left out.

    Candidates come from the pigeonring over fingerprints and from bands of minima.
    Groups of a band with over ``GROUP`` members are compared with their least
    member first.  What that does not join to it asks all other members of its
    group then, so that no pair of two classes is left out.
    """
    keys = stash(rows.select(F.explode("bands").alias("key"), F.col("fp").alias("node")).distinct(), "bands")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"))
    groups = stash(keys.join(sizes.where("n > 1"), "key"), "groups")
    discard(keys)
    links = _alike(_candidates(groups).unionByName(_ring_candidates(prints)).distinct(), docs, prints, words, similarity)
    large = groups.where(F.col("n") > GROUP).select("key", "node", "low")
    if large.isEmpty():
        return links
    classes = components(links, "so-far")
    of_low = classes.select(F.col("node").alias("low"), F.col("component").alias("low_class"))
    asked = large.join(classes, "node", "left").join(of_low, "low", "left")
    asked = stash(asked.select("key", "node", (F.coalesce("component", "node") != F.coalesce("low_class", "low")).alias("probe")), "asked")
    open_keys = stash(asked.where("probe").select("key").distinct(), "open")
    members = stash(asked.join(open_keys, "key", "left_semi"), "open-members")
    sets = stash(_sets(_texts(docs, prints, members.select(F.col("node").alias("fp")).distinct()), words), "sets")
    return links.unionByName(stash(links_in_groups(members, sets, similarity), "more-links"))


def keep_unlike(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group linked by Jaccard similarities of word shingles, with all their columns."""
    with scratch(docs.sparkSession) as keep:
        rows = stash(sketches(docs, words), "sketches")
        prints = _prints(rows, "bits", "n")
        kept = keep(_kept_marks(_linked(rows, similar_pairs(docs, rows, prints, words, similarity), prints)))
    return _kept(docs, kept)
