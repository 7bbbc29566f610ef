"""Packing of token ids into sequences by bounded-space best fit.

Each partition keeps a fixed number of open windows.  What is left of a
document after its full sequences goes to the window it fits best; when none
fits, the fullest is topped up with the document's head and leaves.  The
windows that are open at a partition's end are merged by groups of partitions,
and the last ids of a group become sequences of powers of two, which need no
padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import tokenizers
from corpusloom.llm.common import stash

CAPACITY = 1024
#: Open windows in each partition, and partitions whose leftovers meet.
WINDOWS, TOGETHER = 32, 64
#: A gap of fewer ids is padded rather than filled with a snippet.
SNIPPET = 8
END = 0

_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", "ids"]
_TYPES = [pa.int64()] * 7 + [pa.int32(), pa.binary()]
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int, ids binary"


class Windows:
    """Open windows; pieces are (doc_id, start, ids, doc_tokens)."""

    def __init__(self, capacity: int, most: int, emit: Callable[[list], None]):
        self.capacity, self.most, self.emit = capacity, most, emit
        self.open: list[list] = []
        self.gaps: list[int] = []

    def add(self, doc_id, start: int, ids: np.ndarray, total: int) -> None:
        """Places all of one piece, cutting it where it must be."""
        while len(ids) >= self.capacity:
            self.emit([(doc_id, start, ids[: self.capacity], total)])
            start, ids = start + self.capacity, ids[self.capacity :]
        while len(ids):
            size = len(ids)
            best = min((i for i, gap in enumerate(self.gaps) if gap >= size), key=self.gaps.__getitem__, default=-1)
            if best < 0 and len(self.open) < self.most:
                self.open.append([])
                self.gaps.append(self.capacity)
                best = len(self.open) - 1
            if best >= 0:
                self.open[best].append((doc_id, start, ids, total))
                self.gaps[best] -= size
                if not self.gaps[best]:
                    self._close(best)
                return
            fullest = min(range(len(self.gaps)), key=self.gaps.__getitem__)
            gap = self.gaps[fullest]
            if gap >= SNIPPET:
                self.open[fullest].append((doc_id, start, ids[:gap], total))
                start, ids = start + gap, ids[gap:]
            self._close(fullest)

    def _close(self, i: int) -> None:
        self.emit(self.open[i])
        for column in (self.open, self.gaps):
            column[i] = column[-1]
            column.pop()


def _rows(window: list, sequence: int | None, bucket: int | None, keep: bool) -> Iterator[tuple]:
    offset = 0
    for doc_id, start, ids, total in window:
        raw = ids.astype("<u4").tobytes()
        yield doc_id, start, len(ids), zlib.crc32(raw), total, sequence, offset, bucket, raw if keep else None
        offset += len(ids)


def _pack(batches: Iterator[pa.RecordBatch], path: str, capacity: int, windows: int, keep: bool) -> Iterator[pa.RecordBatch]:
    at, out, sequence = TaskContext.get().partitionId(), [], [0]

    def emit(window: list) -> None:
        out.extend(_rows(window, (at << 32) + sequence[0], None, keep))
        sequence[0] += 1

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * len(_NAMES)
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES)
        out.clear()
        return batch

    space = Windows(capacity, windows, emit)
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
            ids = np.append(tokenizers.encode(path, text.as_py() or ""), np.uint32(END))
            space.add(doc_id, 0, ids, len(ids))
        yield flush()
    for window in space.open:
        out.extend(_rows(window, None, at // TOGETHER, True))
    yield flush()


def _merge(rows: pd.DataFrame, capacity: int, windows: int, keep: bool) -> pd.DataFrame:
    """The leftovers of a group of partitions, longest first; the last ids end in powers of two."""
    base, out, sequence = (1 << 61) + (int(rows["bucket"].iloc[0]) << 32), [], [0]

    def emit(window: list) -> None:
        out.extend(_rows(window, base + sequence[0], None, keep))
        sequence[0] += 1

    space = Windows(capacity, windows, emit)
    rows = rows.sort_values(["length", "doc_id", "start"], ascending=[False, True, True])
    for doc_id, start, raw, total in zip(rows["doc_id"], rows["start"], rows["ids"], rows["doc_tokens"]):
        space.add(None if pd.isna(doc_id) else int(doc_id), int(start), np.frombuffer(raw, "<u4"), int(total))
    rest = [piece for window in space.open for piece in window]
    left = sum(len(piece[2]) for piece in rest)
    while left:
        room = capacity if left >= capacity else 1 << (left.bit_length() - 1)
        window, left = [], left - room
        while room:
            doc_id, start, ids, total = rest.pop(0)
            window.append((doc_id, start, ids[:room], total))
            if len(ids) > room:
                rest.insert(0, (doc_id, start + room, ids[room:], total))
            room -= min(room, len(ids))
        emit(window)
    frame = pd.DataFrame(out, columns=_NAMES)
    return frame.astype({"doc_id": "Int64", "bucket": "Int32"})


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, windows: int = WINDOWS, ids: bool = True) -> DataFrame:
    """Pieces ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, with ``ids``, their ids as little-endian binary.

    A document is its ids and one id 0 at the end; null texts count as empty,
    so each row makes a piece at least.  Rows with equal or null ``doc_id`` are
    documents of their own.  Sequences hold at most ``capacity`` ids; they are
    padded to it unless their length is a power of two.  Names of the
    vocabulary's added tokens in a text become their ids.  Other columns are
    not read.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packed = stash(rows.mapInArrow(lambda b: _pack(b, path, capacity, windows, ids), _SCHEMA), "packed")
    merged = packed.where("bucket is not null").groupBy("bucket").applyInPandas(lambda rows: _merge(rows, capacity, windows, ids), _SCHEMA)
    columns = _NAMES[:-2] + (["ids"] if ids else [])
    return packed.where("bucket is null").select(*columns).unionByName(merged.select(*columns))
