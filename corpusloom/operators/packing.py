"""Splitting texts that are too large, merging small ones, and what fits into a limited number of files."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import SPACE, byte_count, col, natural_key, word_count
from corpusloom.operators.chunks import CHUNK, NTH, chunked, listed, schema_of
from corpusloom.session import stash

JOINER = "\n\n"
#: Items of a group that a task packs at once.
ITEMS = 1 << 16
CUT_IN_SENTENCE, TOKEN_OVER_LIMIT = "cut_in_sentence", "token_over_limit"
#: Units from coarse to fine: pattern to split at and what joins them again.
LEVELS = ((r"\n\n", "\n\n"), (r"\n", "\n"), (r"(?<=[.!?…])\s+", " "), (None, " "))


def fits(words: str | Column, size: str | Column, max_words: int, max_bytes: int) -> Column:
    return (col(words) <= max_words) & (col(size) <= max_bytes)


def _pieces(text: str, small: Callable[[str], bool], notes: dict[str, None]) -> Iterator[tuple[str, str, bool]]:
    """The coarsest pieces of a text that are small enough, in order: (piece, what joins it to the one before, whether it begins a part).

    A unit that is too large gives way to its own units, the first of which
    begins a part; what no level can cut stays whole.
    """
    waiting = [(text, "", False, 0)]
    while waiting:
        piece, joiner, begins, level = waiting.pop()
        if small(piece):
            yield piece, joiner, begins
            continue
        for finer, (pattern, between) in enumerate(LEVELS[level:], level + 1):
            units = piece.split() if pattern is None else list(filter(None, re.split(pattern, piece)))
            if len(units) > 1:
                if pattern is None:
                    notes[CUT_IN_SENTENCE] = None
                waiting += [(u, between, False, finer) for u in units[:0:-1]] + [(units[0], joiner, True, finer)]
                break
        else:
            notes[TOKEN_OVER_LIMIT] = None
            yield piece, joiner, True


def split_text(text: str, max_words: int, max_bytes: int) -> tuple[list[str], list[str]]:
    """Parts within the limits and warnings; boundaries are as coarse as can be, and parts are filled in one pass."""
    notes: dict[str, None] = {}
    parts: list[list[str]] = []
    words = size = 0
    for piece, joiner, begins in _pieces(text, lambda t: len(t.split()) <= max_words and len(t.encode()) <= max_bytes, notes):
        n, b = len(piece.split()), len(piece.encode())
        if parts and not begins and words + n <= max_words and size + len(joiner) + b <= max_bytes:
            parts[-1] += [joiner, piece]
            words, size = words + n, size + len(joiner) + b
        else:
            parts.append([piece])
            words, size = n, b
    return ["".join(part) for part in parts], list(notes)


def split(docs: DataFrame, max_words: int, max_bytes: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, part_no, part_count, text, warnings`` of every text; only those over a limit reach Python."""
    sized = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    ok = fits(word_count("text"), byte_count("text"), max_words, max_bytes)
    whole = sized.where(ok).select(key, F.lit(1).alias("part_no"), F.lit(1).alias("part_count"), "text", F.array().cast("array<string>").alias("warnings"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, numbers, counts, texts, notes = [], [], [], [], []
            for i, value in enumerate(batch["text"]):
                parts, warnings = split_text(value.as_py(), max_words, max_bytes)
                keys += [i] * len(parts)
                numbers += range(1, len(parts) + 1)
                counts += [len(parts)] * len(parts)
                texts += parts
                notes += [warnings] + [[]] * (len(parts) - 1)
            yield pa.RecordBatch.from_arrays([batch[key].take(pa.array(keys, pa.int64())), pa.array(numbers, pa.int32()), pa.array(counts, pa.int32()), pa.array(texts, pa.string()), pa.array(notes, pa.list_(pa.string()))], [key, "part_no", "part_count", "text", "warnings"])

    kind = docs.schema[key].dataType.simpleString()
    large = sized.where(~ok).mapInArrow(run, f"{key} {kind}, part_no int, part_count int, text string, warnings array<string>")
    return whole.unionByName(large)


def next_fit(items: DataFrame, group: str, order: list[str], max_words: int, max_bytes: int, joiner_bytes: int = len(JOINER), chunk: int = ITEMS) -> DataFrame:
    """``items`` (with ``n_words``, ``n_bytes``) and ``bin``: only the last bin of a group is ever open.

    ``order`` is unique within a group.  The rule is sequential, but what a
    chunk of ``chunk`` items makes of an open bin depends only on where its own
    first bin begins, and most beginnings lead to the same last bin.  So each
    chunk tells for ranges of beginnings how it ends, these short tables are
    followed through a group's chunks in order, and the chunks then number
    their items from what they were handed.  No task reads a group.
    """
    names, caps = items.columns, (max_words, max_bytes + joiner_bytes)
    rows = chunked(items, group, order, chunk, "items")
    whole = listed(rows, group, words=F.sum("n_words"), size=F.sum(F.col("n_bytes") + joiner_bytes))
    before = Window.partitionBy("of").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumns({c: F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("words", "size")}).withColumn("chunks", F.count(F.lit(1)).over(Window.partitionBy("of")))
    whole = stash(whole, "chunks")
    several = whole.where("chunks > 1")
    if several.isEmpty():
        handed = whole.select("chunk", F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("long").alias("open_words"), F.lit(None).cast("long").alias("open_size"), F.lit(0).cast("long").alias("bin"))
    else:
        sizes = rows.select(F.col(CHUNK), F.col(NTH), "n_words", "n_bytes").join(several.select(F.col("chunk").alias(CHUNK)), CHUNK, "left_semi")
        tables = sizes.groupBy(CHUNK).cogroup(several.groupBy("chunk")).applyInArrow(lambda a, b: _outcomes(a, b, caps, joiner_bytes), "chunk long, no int, fits_words long, fits_size long, to_words long, to_size long, bins long")
        tables = tables.join(several.select("chunk", "of"), "chunk").repartition("of").sortWithinPartitions("of", "chunk", "no")
        entries = tables.select("of", "chunk", "fits_words", "fits_size", "to_words", "to_size", "bins").mapInArrow(lambda b: _followed(b, caps), "chunk long, open_words long, open_size long, bin long")
        handed = whole.select("chunk", "words", "size").join(stash(entries, "entries"), "chunk", "left").fillna({"bin": 0})
    return rows.groupBy(CHUNK).cogroup(handed.groupBy("chunk")).applyInArrow(lambda a, b: _binned(a, b, caps, joiner_bytes, names), f"{schema_of(items)}, bin int")


def _sums(items: pa.Table, start: pa.Table, joiner: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of words and of bytes (each item with a joiner) up to and with each item, from the group's beginning; one place ahead."""
    sums = []
    for column, first, more in (("n_words", "words", 0), ("n_bytes", "size", joiner)):
        own = items[column].to_numpy().astype(np.int64) + more
        sums.append(np.concatenate(([0], np.cumsum(own))) + start[first][0].as_py())
    return sums[0], sums[1]


def _beginnings(words: np.ndarray, size: np.ndarray, caps: tuple[int, int], bases_words: np.ndarray, bases_size: np.ndarray) -> np.ndarray:
    """The first item that does not fit into a bin whose items begin behind these sums."""
    return np.minimum(np.searchsorted(words[1:], bases_words + caps[0], side="right"), np.searchsorted(size[1:], bases_size + caps[1], side="right"))


def _outcomes(items: pa.Table, start: pa.Table, caps: tuple[int, int], joiner: int) -> pa.Table:
    """For ranges of the item that begins a chunk's first bin: what must fit to get there, where its last bin begins, and how many begin.

    A range begins where the items before it fit; without a bin of its own the
    chunk hands on the bin that it was handed (``to_words`` null).
    """
    words, size = _sums(items.sort_by(NTH), start, joiner)
    n = len(words) - 1
    after = np.maximum(_beginnings(words, size, caps, words[:-1], size[:-1]), np.arange(n) + 1)
    last, bins = np.arange(n + 1), np.ones(n + 1, np.int64)
    last[n], bins[n] = n, 0
    for i, j in zip(range(n - 1, -1, -1), after[::-1].tolist()):
        if j < n:
            last[i], bins[i] = last[j], bins[j] + 1
    most = int(_beginnings(words, size, caps, words[:1], size[:1])[0])
    new = np.flatnonzero(np.concatenate(([True], (last[1 : most + 1] != last[:most]) | (bins[1 : most + 1] != bins[:most]))))
    ends = last[new]
    handed_on = pa.array(ends == n)
    to = [pa.compute.if_else(handed_on, pa.scalar(None, pa.int64()), pa.array(s[np.minimum(ends, n)])) for s in (words, size)]
    columns = [pa.array(np.full(len(new), start["chunk"][0].as_py())), pa.array(np.arange(len(new), dtype=np.int32)), pa.array(words[new]), pa.array(size[new]), *to, pa.array(bins[new])]
    return pa.Table.from_arrays(columns, ["chunk", "no", "fits_words", "fits_size", "to_words", "to_size", "bins"])


def _followed(batches: Iterator[pa.RecordBatch], caps: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """What each chunk of a group is handed: where its open bin begins and that bin's number; rows come in order."""
    group: object = CHUNK  # no group yet
    chunk, handed, number, then = None, None, 0, None
    for batch in batches:
        out = []
        for of, at, *row in zip(*(batch[c].to_pylist() for c in ("of", "chunk", "fits_words", "fits_size", "to_words", "to_size", "bins"))):
            if at != chunk:
                if then is not None and of == group:
                    handed, number = (handed if then[0] is None else then[:2]), number + then[2]
                elif then is None or of != group:
                    handed, number = None, 0
                group, chunk, then = of, at, None
                out.append((at, *(handed or (None, None)), number))
            if then is None or (handed is not None and row[0] <= handed[0] + caps[0] and row[1] <= handed[1] + caps[1]):
                then = row[2], row[3], row[4]
        columns = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["chunk", "open_words", "open_size", "bin"])


def _binned(items: pa.Table, start: pa.Table, caps: tuple[int, int], joiner: int, names: list[str]) -> pa.Table:
    """The items of a chunk with the numbers of their bins."""
    items = items.sort_by(NTH)
    words, size = _sums(items, start, joiner)
    n, number, at = len(words) - 1, start["bin"][0].as_py(), 0
    after = np.maximum(_beginnings(words, size, caps, words[:-1], size[:-1]), np.arange(n) + 1).tolist()
    if start["open_words"][0].as_py() is not None:
        at = int(_beginnings(words, size, caps, start["open_words"].to_numpy(), start["open_size"].to_numpy())[0])
    begins = np.zeros(n, np.int32)
    while at < n:
        begins[at] = 1
        at = after[at]
    return pa.Table.from_arrays([*(items[c] for c in names), pa.array(np.cumsum(begins, dtype=np.int32) + np.int32(number))], [*names, "bin"])


def plan(docs: DataFrame, max_words: int, max_bytes: int, key: str = "doc_id", group: str = "source", text: str = "text", space: str = SPACE) -> DataFrame:
    """``file_id, key, group, is_group, bin, part_no, part_count, n_words, n_bytes``: what goes into which file.

    Ungrouped (null or blank) and oversized sources become files of their own,
    in parts if need be, before a group's merged files; the rest of a group is
    merged by next fit in the order of ``key``.  ``space`` parts the words of
    what is merged.
    """
    named = docs.select(key, F.nullif(F.trim(group), F.lit("")).alias("group"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sized = named.select(key, "group", "text", word_count("text", space).alias("n_words"), byte_count("text").alias("n_bytes"))
    alone = F.col("group").isNull() | ~fits("n_words", "n_bytes", max_words, max_bytes)
    parts = split(sized.where(alone).select(key, "text"), max_words, max_bytes, key, "text").join(sized.where(alone).select(key, "group"), key)
    single = parts.select(
        F.concat(F.lit("single-"), F.col(key).cast("string"), F.lit("-"), F.col("part_no").cast("string")).alias("file_id"), key, "group", F.lit(False).alias("is_group"), F.lit(0).alias("bin"),
        "part_no", "part_count", word_count("text").alias("n_words"), byte_count("text").alias("n_bytes"),
    )
    merged = next_fit(sized.where(~alone).select(key, "group", "n_words", "n_bytes"), "group", [key], max_words, max_bytes)
    counts = merged.groupBy("group").agg(F.max("bin").alias("part_count"))
    merged = merged.join(counts, "group").select(
        F.concat(F.lit("group-"), F.col("group"), F.lit("-"), F.col("bin").cast("string")).alias("file_id"), key, "group", F.lit(True).alias("is_group"), "bin",
        F.col("bin").alias("part_no"), "part_count", "n_words", "n_bytes",
    )
    return single.unionByName(merged)


def plan_in_order(items: DataFrame, group: str, name: str, max_words: int, max_bytes: int) -> DataFrame:
    """Scans and image documents: by natural order of names, unsplit, without joiners."""
    return next_fit(items.withColumn("natural", natural_key(name)), group, ["natural", name], max_words, max_bytes, 0).drop("natural")


def plan_images(images: DataFrame, max_words: int, max_bytes: int, key: str = "doc_id", group: str = "source", name: str = "name", scans: bool = False) -> DataFrame:
    """``key, group, bin`` of images with ``n_words``, ``text_bytes`` and ``image_bytes``: next fit of words and of all bytes, without joiners.

    Scans go in the natural order of names, other images in that of keys.
    Images without a group share ``Images 1``; one that is too large alone
    has a file of its own.
    """
    rows = images.select(key, F.coalesce(F.nullif(F.trim(group), F.lit("")), F.lit("Images 1")).alias("group"), name, "n_words", (F.coalesce("text_bytes", F.lit(0)) + F.coalesce("image_bytes", F.lit(0))).cast("long").alias("n_bytes"))
    packed = plan_in_order(rows, "group", name, max_words, max_bytes) if scans else next_fit(rows, "group", [key], max_words, max_bytes, 0)
    return packed.select(key, "group", "bin")


def plan_kinds(sources: DataFrame, max_words: int, max_bytes: int, key: str = "doc_id", group: str = "source", text: str = "text", kind: str = "kind") -> DataFrame:
    """``plan`` with a route for each kind: music is never grouped, images go to ``plan_images``; adds ``route``."""
    to = route(kind)
    texts = plan(sources.where(to != "images").withColumn(group, F.when(to != "music", F.col(group))), max_words, max_bytes, key, group, text)
    texts = texts.join(sources.select(key, to.alias("route")), key)
    found = [c for c in ("text_bytes", "image_bytes") if c in sources.columns]
    images = sources.where(to == "images").select(
        key, group, F.col(key).cast("string").alias("name"), word_count(F.coalesce(F.col(text), F.lit(""))).alias("n_words"), F.lit(None).cast("long").alias("text_bytes") if "text_bytes" not in found else F.col("text_bytes"),
        F.lit(0).cast("long").alias("image_bytes") if "image_bytes" not in found else F.col("image_bytes"), byte_count(F.coalesce(F.col(text), F.lit(""))).alias("own_bytes"),
    ).withColumn("text_bytes", F.coalesce("text_bytes", "own_bytes"))
    binned = plan_images(images, max_words, max_bytes, key, group).join(images.select(key, "n_words", (F.col("text_bytes") + F.col("image_bytes")).cast("long").alias("n_bytes")), key)
    counts = binned.groupBy("group").agg(F.max("bin").alias("part_count"))
    pictures = binned.join(counts, "group").select(
        F.concat(F.lit("images-"), F.col("group"), F.lit("-"), F.col("bin").cast("string")).alias("file_id"), key, "group", F.lit(True).alias("is_group"), "bin", F.col("bin").alias("part_no"), "part_count", "n_words", "n_bytes", F.lit("images").alias("route"),
    )
    return texts.select(*pictures.columns).unionByName(pictures)


def route(kind: str | Column) -> Column:
    """Where sources of a kind are packed: ``images``, ``music`` (always files of their own) or ``texts``."""
    return F.when(col(kind) == "image", "images").when(col(kind) == "music", "music").otherwise("texts")


def admit(sources: DataFrame, limit: int, key: str = "doc_id", group: str = "source") -> DataFrame:
    """``sources`` with ``slot`` and ``admitted``: a file slot for each group or ungrouped source, by first appearance.

    If there is a column ``kind``, music is a file of its own whatever its
    group; if there is a column ``status``, sources that are ``skipped``,
    ``error`` or ``duplicate`` take no slot and have no verdict.  Groups are met
    by partial minima, so only one row a group is ranked.
    """
    named = F.nullif(F.trim(group), F.lit(""))
    if "kind" in sources.columns:
        named = F.when(route("kind") != "music", named)
    slot = F.coalesce(F.concat(F.lit("g:"), named), F.concat(F.lit("s:"), F.col(key).cast("string")))
    if "status" in sources.columns:
        slot = F.when(~F.col("status").isin("skipped", "error", "duplicate"), slot)
    rows = sources.withColumn("slot_key", slot)
    first = rows.where("slot_key is not null").groupBy("slot_key").agg(F.min(key).alias("first"))
    ahead = first.orderBy("first", "slot_key").limit(limit)
    taken = ahead.select("slot_key", F.row_number().over(Window.orderBy("first", "slot_key")).alias("slot"))  # ``limit`` rows
    out = rows.join(F.broadcast(taken) if limit <= 100_000 else taken, "slot_key", "left")
    return out.withColumn("admitted", F.when(F.col("slot_key").isNotNull(), F.col("slot").isNotNull())).drop("slot_key")


def within_remaining(parts: DataFrame, remaining: int, key: str = "file_no") -> DataFrame:
    """Sources ``(key, part_count)`` in order: one whose parts exceed what is left is skipped whole and takes nothing.

    What is left is one of ``remaining + 1`` states.  Each range of keys tells
    what it makes of every state, the ranges' tables are composed in order, and
    the ranges then run once from the state that they begin with.
    """
    ranged = stash(parts.select(key, "part_count").repartitionByRange(key).withColumn("range", F.spark_partition_id()), "ranges")

    def table(group: pa.Table) -> pa.Table:
        left = np.arange(remaining + 1)
        for n in group.sort_by(key)["part_count"].to_pylist():
            left = np.where(left >= n, left - n, left)
        return pa.table({"range": group["range"].slice(0, 1), "left": pa.array([left.tolist()], pa.list_(pa.int64()))})

    tables = ranged.groupBy("range").applyInArrow(table, "range int, left array<long>").orderBy("range").collect()
    starts, left = {}, remaining
    for row in tables:
        starts[row["range"]], left = left, row["left"][left]

    def judge(group: pa.Table) -> pa.Table:
        group, out = group.sort_by(key), []
        left = starts[group["range"][0].as_py()]
        for n in group["part_count"].to_pylist():
            out.append(n <= left)
            left -= n if n <= left else 0
        return pa.table({key: group[key], "part_count": group["part_count"], "fits": pa.array(out, pa.bool_())})

    kinds = ", ".join(f"{c} {parts.schema[c].dataType.simpleString()}" for c in (key, "part_count"))
    return ranged.groupBy("range").applyInArrow(judge, f"{kinds}, fits boolean")


def used_slots(files: DataFrame) -> DataFrame:
    """One row ``used_slots``: distinct stems of text files (a Markdown twin does not count) and documents."""
    stem = F.regexp_replace("path", "[.][^.]*$", "")
    kind = F.when(F.col("format") == "pdf", "pdf").otherwise("text")
    return files.select(stem.alias("stem"), kind.alias("kind")).distinct().agg(F.count(F.lit(1)).alias("used_slots"))


def groups_to_repack(sources: DataFrame, key: str = "source_id") -> DataFrame:
    """Members of groups that have both packed and waiting sources: they are packed anew."""
    mixed = sources.where("group is not null").groupBy("group").agg(F.count_if(F.col("status") == "packed").alias("packed"), F.count_if(F.col("status") == "normalised").alias("waiting"))
    return sources.join(mixed.where("packed > 0 and waiting > 0").select("group"), "group", "left_semi")


def default_image_group(images: DataFrame, prefix: str = "Images") -> DataFrame:
    """Images without a group get one new group, numbered after the greatest such number."""
    number = F.regexp_extract("group", f"^{prefix} (\\d+)$", 1)
    last = images.agg(F.max(number.try_cast("int")).alias("last"))
    named = images.join(F.broadcast(last))
    return named.withColumn("group", F.coalesce(F.nullif(F.trim("group"), F.lit("")), F.concat(F.lit(f"{prefix} "), (F.coalesce("last", F.lit(0)) + 1).cast("string")))).drop("last")
