"""Removal of long strings that occur twice, by sparse suffix sorting.

Every window of ``length`` bytes contains an anchor: the ``GRAM``-byte string
with the smallest hash in it (winnowing), so equal windows have equal anchors
at equal offsets.  Only anchors are shuffled, about one for 77 bytes:

1. Where the whole surroundings of an anchor (every window that contains it)
   occur twice, all of them go.  Copies inside a task are met before the
   shuffle, so that a passage that a third of all documents share makes one
   row a task.
2. Where an anchor occurs twice in different surroundings (the ends of a
   repeated passage), the strings to its right and to its left are sorted by
   deep-shallow sorting and the neighbours' common prefixes tell how far the
   repeat reaches.  Anchors with more than ``GROUP``
   surroundings are not gathered: their windows are counted by key instead.
3. The spans meet the texts again by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import deep_shallow
from corpusloom.llm.common import scratch, stash

LENGTH = 200
GRAM = 48
#: Anchors that a task holds to meet copies before the shuffle.
HELD = 1 << 20
#: Most surroundings of one anchor that a task sorts; more are counted by window.
GROUP = 50_000
#: Up to this many surroundings are compared in pairs after the sort.
PAIRED = 32
#: An anchor of over ``GROUP`` rows and this share of all rows is never gathered (100,000 of them at most).
HOT = 1e-5
#: The columns that tell rows of one ``doc_id`` apart, and that hold what goes.
MARK = "corpusloom_mark"
SPANS = "corpusloom_spans"
_CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) of each ``width`` adjacent values, in linear time."""
    n = len(values) - width + 1
    size = -(-len(values) // width) * width
    fill = np.iinfo(np.uint64).max if best is np.minimum else 0
    padded = np.full(size, fill, np.uint64)
    padded[: len(values)] = values
    table = padded.reshape(-1, width)
    ahead = best.accumulate(table, axis=1).ravel()
    behind = best.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[:n], ahead[width - 1 : width - 1 + n])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _anchors(data: np.ndarray, ends: np.ndarray, length: int, powers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors in adjacent texts and the hashes of their grams; ``ends`` are the texts' ends."""
    width = length - GRAM + 1
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    sums = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[0][: len(data)], dtype=np.uint64)))
    grams = (sums[GRAM:] - sums[:-GRAM]) * powers[1][: len(data) - GRAM + 1]
    del sums
    grams = (grams ^ (grams >> np.uint64(29))) * _MIX
    grams ^= grams >> np.uint64(32)
    lows = _sliding(grams, width, np.minimum)  # by the window's start
    valid = np.ones(len(lows), bool)
    for end in ends[np.searchsorted(ends, 1) :]:  # windows over the end of a text
        valid[max(0, end - length + 1) : end] = False
    lows[~valid] = 0
    padded = np.concatenate((np.zeros(width - 1, np.uint64), lows, np.zeros(width - 1, np.uint64)))
    chosen = np.flatnonzero((grams == _sliding(padded, width, np.maximum)) & (grams != 0))
    return chosen, grams[chosen]


def _find(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Anchors of one partition, ``HELD`` at a time: one row for each gram and surroundings, and bare rows for what repeats them here."""
    side, parts = length - GRAM, []
    powers = _powers(_CHUNK + 1)

    def flush(ids, marks, texts):
        data = np.frombuffer(b"".join(texts), np.uint8)
        local = powers if len(data) < len(powers[0]) else _powers(len(data) + 1)
        ends = np.cumsum([len(t) for t in texts])
        at, keys = _anchors(data, ends, length, local)
        if len(at):
            doc = np.searchsorted(ends, at, side="right")
            pos = at - (ends[doc] - np.array([len(t) for t in texts])[doc])
            sizes = np.array([len(t) for t in texts])[doc]
            left, right = np.minimum(pos, side), np.minimum(sizes - pos - GRAM, side)
            whole = data.tobytes()
            digest = xxhash.xxh3_64_intdigest
            around = np.fromiter((digest(whole[a - x : a + GRAM + y], x) for a, x, y in zip(at.tolist(), left.tolist(), right.tolist())), np.uint64, len(at))
            half, short = -(-side // 2), xxhash.xxh32_intdigest
            before = [short(whole[a - half : a + GRAM]) if x >= half else 0 for a, x in zip(at.tolist(), left.tolist())]
            after = [short(whole[a : a + GRAM + half]) if y >= half else 0 for a, y in zip(at.tolist(), right.tolist())]
            halves = np.array([before, after], np.uint32).view(np.int32)
            parts.append((keys.view(np.int64), around.view(np.int64), halves[0], halves[1], np.array(ids, object)[doc], np.array(marks, np.int64)[doc], pos.astype(np.int32), left.astype(np.int16), right.astype(np.int16)))

    def found() -> Iterator[pa.RecordBatch]:
        keys, around, before, after, docs, marks, pos, left, right = (np.concatenate(c) for c in zip(*parts))
        parts.clear()
        order = np.lexsort((around, keys))
        keys, around = keys[order], around[order]
        new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (around[1:] != around[:-1])))
        count = np.diff(np.concatenate((np.flatnonzero(new), [len(new)])))
        new_key = np.concatenate(([True], keys[1:] != keys[:-1]))
        here = np.diff(np.concatenate((np.flatnonzero(new_key), [len(new_key)])))[np.cumsum(new_key) - 1]
        n = np.zeros(len(new), np.int32)
        n[new] = np.minimum(count, 2)
        half, left, right = -(-side // 2), left[order], right[order]
        columns = [
            pa.array(keys), pa.array(around), pa.array(before[order], mask=left < half), pa.array(after[order], mask=right < half), pa.array(docs[order], pa.int64(), from_pandas=True), pa.array(marks[order]), pa.array(pos[order]), pa.array(left), pa.array(right),
            pa.array(n), pa.array(np.where(new_key & (here > max(1, len(new) * HOT / 2)), here, 0).astype(np.int32)),
        ]
        yield from pa.Table.from_arrays(columns, names=_FOUND_NAMES).to_batches(max_chunksize=100_000)

    held, size = ([], [], []), 0
    for batch in batches:
        for doc_id, mark, text in zip(batch["doc_id"].to_pylist(), batch["mark"].to_pylist(), batch["text"]):
            raw = text.as_buffer()
            raw = raw.to_pybytes() if raw is not None else b""
            if len(raw) < length:
                continue
            for column, value in zip(held, (doc_id, mark, raw)):
                column.append(value)
            size += len(raw)
            if size >= _CHUNK // 2:
                flush(*held)
                held, size = ([], [], []), 0
        if sum(len(p[0]) for p in parts) >= HELD:
            yield from found()
    if size:
        flush(*held)
    if parts:
        yield from found()


_FOUND = "key long, around long, before int, after int, doc_id long, mark long, pos int, left short, right short, n int, heavy int"
_FOUND_NAMES = [c.split()[0] for c in _FOUND.split(", ")]


def _reach(strings: list[bytes], lefts: list[bytes], side: int) -> tuple[list[int], list[int]]:
    """For each of a group's surroundings how far its windows that occur twice reach to the left and right; -1: none does.

    ``strings`` start behind the anchor's gram, ``lefts`` are what stands before it, reversed.
    """
    n = len(strings)
    sorts = []
    for texts in (strings, lefts):
        order = deep_shallow.sort(texts)
        sorts.append((np.array(order), np.array(deep_shallow.neighbours(texts, order), np.int16)))
    if n > PAIRED:
        return _reach_by_offset(*sorts, side)
    tables = []
    for order, steps in sorts:
        shared = np.zeros((n, n), np.int16)
        for i in range(n - 1):
            run = np.minimum.accumulate(steps[i + 1 :])
            shared[order[i], order[i + 1 :]] = run
            shared[order[i + 1 :], order[i]] = run
        tables.append(shared)
    right, left = tables
    fits = left + right >= side
    np.fill_diagonal(fits, False)
    return np.where(fits, left, -1).max(axis=1).tolist(), np.where(fits, right, -1).max(axis=1).tolist()


def _reach_by_offset(right: tuple[np.ndarray, np.ndarray], left: tuple[np.ndarray, np.ndarray], side: int) -> tuple[list[int], list[int]]:
    """The same for large groups, without pairs: the sorts' common prefixes class the strings at each offset of the window."""
    n = len(right[0])
    reach_left, reach_right = np.full(n, -1), np.full(n, -1)

    def classes(sort: tuple[np.ndarray, np.ndarray], depth: int) -> np.ndarray:
        order, steps = sort
        out = np.empty(n, np.int64)
        out[order] = np.cumsum(steps < depth)
        return out

    for offset in range(side + 1):
        both = classes(left, offset) * (n + 1) + classes(right, side - offset)
        _, which, count = np.unique(both, return_inverse=True, return_counts=True)
        twice = count[which] > 1
        reach_left[twice] = offset
        reach_right[twice & (reach_right < 0)] = side - offset
    return reach_left.tolist(), reach_right.tolist()


_AROUND = "key long, doc_id long, mark long, pos int, gram binary, before binary, after binary"
_SPAN = "doc_id long, mark long, start int, end int"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _sort_groups(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Spans from the groups of anchors; rows come sorted by key."""
    side, out = length - GRAM, []
    group: dict[bytes, dict] = {}  # by gram: equal hashes of different grams part here
    key = None

    def settle() -> None:
        for rows in group.values():
            if len(rows) > 1:
                left, right = _reach([v[1] for v in rows.values()], [v[0][::-1] for v in rows.values()], side)
                out.extend((doc_id, mark, pos - a, pos + GRAM + b) for (doc_id, mark, pos), a, b in zip(rows, left, right) if a >= 0)
        group.clear()

    for batch in batches:
        for k, doc_id, mark, pos, gram, before, after in zip(*(c.to_pylist() for c in batch.columns)):
            if k != key:
                settle()
                key = k
            group.setdefault(gram, {})[doc_id, mark, pos] = (before, after)
        if out:
            yield _batch(out, _SPAN)
            out = []
    settle()
    if out:
        yield _batch(out, _SPAN)


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each wanted anchor and what stands before and after it."""
    for batch in batches:
        rows = []
        wanted = batch["wanted"]
        inside, ends = wanted.flatten(), np.cumsum(pa.compute.list_value_length(wanted).to_numpy(zero_copy_only=False)).tolist()
        keys, poses, lefts, rights = (inside.field(n).to_pylist() for n in ("key", "pos", "left", "right"))
        start = 0
        for doc_id, mark, text, end in zip(batch["doc_id"].to_pylist(), batch["mark"].to_pylist(), batch["text"], ends):
            raw = text.as_buffer().to_pybytes()
            for i in range(start, end):
                pos = poses[i]
                rows.append((keys[i], doc_id, mark, pos, raw[pos : pos + GRAM], raw[pos - lefts[i] : pos], raw[pos + GRAM : pos + GRAM + rights[i]]))
            start = end
        yield _batch(rows, _AROUND)


_WINDOW = "doc_id long, mark long, start int, window binary"


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Every window around an anchor as a 128-bit value, for groups too large to gather."""
    side, digest = length - GRAM, xxhash.xxh3_128_digest
    for batch in batches:
        rows = []
        for _, doc_id, mark, pos, gram, before, after in zip(*(c.to_pylist() for c in batch.columns)):
            text, left = before + gram + after, len(before)
            rows += [(doc_id, mark, pos - o, digest(text[left - o : left - o + length])) for o in range(max(0, side - len(after)), left + 1)]
            if len(rows) > 100_000:
                yield _batch(rows, _WINDOW)
                rows = []
        yield _batch(rows, _WINDOW)


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Spans ``doc_id, mark, start, end`` (bytes) of strings of ``length`` bytes that start elsewhere too; they may overlap.

    ``docs`` has ``doc_id``, ``text`` (not null) and ``MARK``; other columns are not read.
    """
    docs = docs.select("doc_id", "text", MARK)
    found = stash(docs.select("doc_id", F.col(MARK).alias("mark"), "text").mapInArrow(lambda b: _find(b, length), _FOUND), "anchors")
    total = found.count()
    hot = found.where("heavy > 0").groupBy("key").agg(F.sum("heavy").alias("rows")).where(F.col("rows") >= max(GROUP, total * HOT)).select("key", F.lit(True).alias("hot"))
    anchors = found.where("n > 0").join(F.broadcast(hot), "key", "left")
    cold, warm = anchors.where("hot is null"), anchors.where("hot")
    by_key, by_both = Window.partitionBy("key"), Window.partitionBy("key", "around")
    cold = cold.withColumns({"lo": F.min("around").over(by_key), "hi": F.max("around").over(by_key)})
    cold = cold.withColumns({"n": F.sum("n").over(by_both), "nth": F.row_number().over(by_both.orderBy("doc_id", "mark", "pos"))})
    cold = cold.where("n > 1 or lo <> hi")
    # surroundings of hot anchors are counted by partial sums
    pairs = warm.groupBy("key", "around").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "mark", "pos", "left", "right", "before", "after")).alias("one"))
    pairs = stash(pairs, "hot-pairs")
    warm_full = warm.drop("n").join(pairs.where("n > 1").select("key", "around"), ["key", "around"], "left_semi")
    kept = stash(cold.select("key", "doc_id", "mark", "pos", "left", "right", "before", "after", "n", "nth", F.col("lo").eqNullSafe(F.col("hi")).alias("alone")), "cold")
    full = F.col("pos") - F.col("left"), F.col("pos") + GRAM + F.col("right")
    whole = [
        rows.select("doc_id", "mark", full[0].cast("int").alias("start"), full[1].cast("int").alias("end"))
        for rows in (found.where("n <> 1"), kept.where("n > 1"), warm_full)
    ]
    # ends of repeats: each surroundings once, of anchors that have several and one of them only once; a window that
    # occurs twice has half of what surrounds the anchor on one side, so these halves must occur twice
    ends = kept.where("nth = 1 and not alone").withColumn("single", F.min("n").over(by_key)).where("single = 1")
    ends = ends.select("key", "doc_id", "mark", "pos", "left", "right", "before", "after").unionByName(pairs.select("key", "one.*"))
    for side in ("before", "after"):  # joining counts instead writes a third more to disk
        ends = ends.withColumn(f"n_{side}", F.when(F.col(side).isNotNull(), F.count(F.lit(1)).over(Window.partitionBy("key", side))))
    ends = ends.where("n_before > 1 or n_after > 1").withColumn("many", F.count(F.lit(1)).over(by_key) > GROUP)
    ends = stash(ends.select("key", "doc_id", "mark", "pos", "left", "right", "many"), "ends")
    out = _around(docs, ends.where("not many")).repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: _sort_groups(b, length), _SPAN)
    many = ends.where("many")
    if not many.isEmpty():
        windows = stash(_around(docs, many).mapInArrow(lambda b: _windows(b, length), _WINDOW).distinct(), "windows")
        twice = stash(windows.groupBy("window").count().where("count > 1").select("window"), "twice")
        out = out.unionByName(windows.join(twice, "window", "left_semi").select("doc_id", "mark", "start", (F.col("start") + length).alias("end")))
    for more in whole:
        out = out.unionByName(more)
    return out


def _around(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """The bytes of anchors and what stands around them, from the texts."""
    wanted = anchors.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("key", "pos", "left", "right")).alias("wanted"))
    near = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["doc_id"]) & (docs[MARK] == wanted["mark"])).select(docs["doc_id"], "mark", "text", "wanted")
    return near.mapInArrow(_surroundings, _AROUND)


def _rest(raw: bytes, spans: list[dict] | None) -> tuple[bytes, int]:
    """The bytes outside the spans and the number of maximal runs that go."""
    runs: list[list[int]] = []
    for start, end in sorted((x["start"], x["end"]) for x in spans or ()):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    edges = [0, *(e for run in runs for e in run), len(raw)]
    return (b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])) if runs else raw), len(runs)


def _bytes(text: pa.StringScalar) -> bytes:
    raw = text.as_buffer()
    return raw.to_pybytes() if raw is not None else b""


def _cut(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    for batch in batches:
        rows = []
        for doc_id, text, spans in zip(batch["doc_id"].to_pylist(), batch["text"], batch[SPANS].to_pylist()):
            raw = _bytes(text)
            rest, runs = _rest(raw, spans)
            rows.append((doc_id, len(raw), len(raw) - len(rest), runs, hashlib.sha256(rest).hexdigest(), rest if texts else None))
        columns = list(zip(*rows)) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def _replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rest = [_rest(_bytes(text), spans)[0].decode(errors="ignore") for text, spans in zip(batch["text"], batch[SPANS].to_pylist())]
        names = [n for n in batch.schema.names if n not in (SPANS, MARK)]
        yield pa.RecordBatch.from_arrays([pa.array(rest, pa.string()) if n == "text" else batch[n] for n in names], names)


def _with_spans(docs: DataFrame, length: int) -> DataFrame:
    """``docs``, whose texts are not null, with the columns ``SPANS`` and ``MARK``."""
    rows = docs.withColumn(MARK, F.xxhash64("text"))
    with scratch(docs.sparkSession) as keep:
        spans = keep(stash(repeated_spans(rows, length), "spans"))
    spans = spans.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "end")).alias(SPANS)).select(F.col("doc_id").alias(f"{SPANS}_id"), F.col("mark").alias(f"{SPANS}_mark"), SPANS)
    return rows.join(spans, F.col("doc_id").eqNullSafe(F.col(f"{SPANS}_id")) & (F.col(MARK) == F.col(f"{SPANS}_mark")), "left").drop(f"{SPANS}_id", f"{SPANS}_mark")


def remove_repeats(docs: DataFrame, length: int = LENGTH, texts: bool = True) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, with ``texts``, ``kept_bytes``.

    Every byte goes that a string of ``length`` bytes covers which also starts
    anywhere else, in the same text or another; null counts as empty.  Repeated
    rows (even of one ``doc_id``, null included) are occurrences of their own.
    Other columns are not read.
    """
    joined = _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), length)
    out = joined.mapInArrow(lambda b: _cut(b, texts), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")
    return out if texts else out.drop("kept_bytes")


def strip_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeats gone from ``text``; all rows and columns stay, ``n_chars`` is counted anew.

    What is left of a character that a repeat cuts goes with it.
    """
    plain = {"text": F.coalesce("text", F.lit("")), "doc_id": F.col("doc_id").cast("long")}
    joined = _with_spans(docs.select(*[plain[c].alias(c) if c in plain else F.col(c) for c in docs.columns]), length)
    out = joined.mapInArrow(_replace, joined.drop(SPANS, MARK).schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
