"""Alignment of two tokenizers' tokens over the same bytes.

1. Tasks encode each text with both tokenizers and place the tokens by bytes.
   In a batch of texts, whose offsets follow each other so that they name the
   document too, ``merge_asof`` finds for each token start the other side's
   token that covers it; both directions together give all overlaps.  Ends that
   both sides have cut the tokens into groups; overlaps with equal ends are links.
2. Pairs of linked ids are counted by chunks of documents, then over the corpus,
   by partial sums; a pair's count and whether it is its B id's highest go back
   to the chunks, whose documents are summed up there.

A row for each link would shuffle several times the input.  So a chunk sends
each of its different pairs once, whatever the number of its links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import tokenizers
from corpusloom.llm.common import stash

#: Characters of text in a chunk, and bytes of text that one merge takes (a longer document has one of its own).
CHUNK, MERGED = 16 << 20, 1 << 20


@lru_cache(maxsize=4)
def _bytes_of_ranks(path: str) -> list[bytes]:
    ranks = tokenizers.ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for raw, rank in ranks.items():
        table[rank] = raw
    return table


@lru_cache(maxsize=4)
def _pieces(path: str) -> tuple[sentencepiece.SentencePieceProcessor, list[bytes]]:
    """The encoder of a piece model, and the bytes of each of its pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    spell = lambda i: bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    return model, [spell(i) for i in range(model.get_piece_size())]


@lru_cache(maxsize=8)
def _sizes(path: str, pieces: bool) -> np.ndarray:
    return np.array([len(b) for b in (_pieces(path)[1] if pieces else _bytes_of_ranks(path))], np.int64)


def tokens(text: str | None, path_a: str, path_b: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of space and text by A, and of text by B, which adds the space; none where the bytes of one side differ from the text's."""
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    if not text:
        return none
    model, spelled = _pieces(path_b)
    own, b = (" " + text).encode(), model.encode(text)
    if b"".join(map(spelled.__getitem__, b)) != own:
        return none
    a = tokenizers.encode_plain(path_a, " " + text).astype(np.int64)
    if int(_sizes(path_a, False)[a].sum()) != len(own):  # its tokens are bytes of the text in order, so lengths tell
        return none
    return a, np.array(b, np.int64)


@lru_cache(maxsize=2)
def _spelled(size_a: int, size_b: int) -> np.ndarray:
    """Each id of A with a comma and with a bar behind it, then those of B with a comma and with a semicolon."""
    return np.array([f"{i}{end}".encode() for size, ends in ((size_a, ",|"), (size_b, ",;")) for i in range(size) for end in ends], object)


def _placed(ids: list[np.ndarray], sizes: np.ndarray) -> pd.DataFrame:
    """Tokens of documents that follow each other: ``start, end`` in bytes, which name the document too, ``doc``, ``id``."""
    every = np.concatenate(ids)
    ends = np.cumsum(sizes[every])
    return pd.DataFrame({"start": ends - sizes[every], "end": ends, "doc": np.repeat(np.arange(len(ids)), [len(i) for i in ids]), "id": every}, copy=False)


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of tokens (row numbers of A and B) whose bytes overlap.

    Each token start is covered by one token of the other side: either A's
    token starts inside B's, or B's inside A's; the second direction leaves out
    what starts together.  Documents follow each other on both sides with equal
    lengths, so no token is covered by one of another document.
    """
    left = pd.DataFrame({"start": a["start"], "at_a": np.arange(len(a))}, copy=False)
    right = pd.DataFrame({"start": b["start"], "at_b": np.arange(len(b))}, copy=False)
    inside_b = pd.merge_asof(left, right, on="start")
    inside_a = pd.merge_asof(right, left, on="start", allow_exact_matches=False)
    strictly = ~np.isin(right["start"].to_numpy(), left["start"].to_numpy(), assume_unique=True)
    inside_a = inside_a[strictly]
    return np.concatenate((inside_b["at_a"], inside_a["at_a"])).astype(np.int64), np.concatenate((inside_b["at_b"], inside_a["at_b"])).astype(np.int64)


def align(ids_a: list[np.ndarray], ids_b: list[np.ndarray], sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame]:
    """Tokens of both sides with their ``group``, numbered through, and whether they are its ``last``; and the links ``doc, a, b`` (ids)."""
    a, b = _placed(ids_a, sizes_a), _placed(ids_b, sizes_b)
    at_a, at_b = overlaps(a, b)
    together = a["end"].to_numpy()[at_a] == b["end"].to_numpy()[at_b]
    at_a, at_b = np.sort(at_a[together]), np.sort(at_b[together])  # ends ascend on both sides
    for side, at in ((a, at_a), (b, at_b)):
        last = np.zeros(len(side), np.int64)
        last[at] = 1
        side["last"], side["group"] = last, np.cumsum(last) - last
    links = pd.DataFrame({"doc": a["doc"].to_numpy()[at_a], "a": a["id"].to_numpy()[at_a], "b": b["id"].to_numpy()[at_b]}, copy=False)
    return a, b, links


def written(a: pd.DataFrame, b: pd.DataFrame, documents: int, sizes: tuple[int, int]) -> list[bytes]:
    """Each document's groups as ``a1,a2|b1;a3|b2,b3``."""
    codes = np.concatenate((2 * a["id"].to_numpy() + a["last"].to_numpy(), 2 * (sizes[0] + b["id"].to_numpy()) + b["last"].to_numpy()))
    order = np.argsort(np.concatenate((2 * a["group"].to_numpy(), 2 * b["group"].to_numpy() + 1)), kind="stable")
    parts = _spelled(*sizes)[codes[order]].tolist()
    ends = np.cumsum(np.bincount(a["doc"], minlength=documents) + np.bincount(b["doc"], minlength=documents)).tolist()
    return [b"".join(parts[i:j])[:-1] for i, j in zip([0, *ends[:-1]], ends)]


_CHUNKS = "chunk long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<int>, times array<int>, names array<long>, counts array<long>, groups string"
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string())
_NAMES = [c.split()[0] for c in _CHUNKS.split(", ")]


def _chunks(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str, keep: bool) -> Iterator[pa.RecordBatch]:
    """A row for each document, its pairs by their number in the chunk, and one with the chunk's pairs and their counts (its ``names``)."""
    task, sizes = TaskContext.get().partitionId(), (_sizes(path_a, False), _sizes(path_b, True))
    chunk, size, waiting, bytes_waiting = task << 24, 0, [], 0
    numbers: dict[int, int] = {}
    counts: list[int] = []

    def documents() -> list[tuple]:
        nonlocal waiting, bytes_waiting
        a, b, links = align([d[1] for d in waiting], [d[2] for d in waiting], *sizes)
        lines = written(a, b, len(waiting), (len(sizes[0]), len(sizes[1])))
        names, local = np.unique(links["a"].to_numpy() << 32 | links["b"].to_numpy(), return_inverse=True)
        chunk_wide = np.array([numbers.setdefault(n, len(numbers)) for n in names.tolist()], np.int64)
        counts.extend([0] * (len(numbers) - len(counts)))
        for n, more in zip(chunk_wide.tolist(), np.bincount(local, minlength=len(names)).tolist()):
            counts[n] += more
        ends = np.cumsum(np.bincount(links["doc"], minlength=len(waiting))).tolist()
        rows = []
        for (doc_id, ids_a, ids_b), line, i, j in zip(waiting, lines, [0, *ends[:-1]], ends):
            own, times = np.unique(chunk_wide[local[i:j]], return_counts=True) if j > i else ([], [])  # a group has one link
            rows.append((chunk, doc_id, len(ids_a), len(ids_b), j - i, hashlib.sha256(line).hexdigest() if j > i else "", own, times, None, None, line.decode() if keep else None))
        waiting, bytes_waiting = [], 0
        return rows

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], _NAMES)

    def flush() -> pa.RecordBatch:
        rows = documents() if waiting else []
        rows.append((chunk, None, None, None, None, None, None, None, list(numbers), list(counts), None))
        numbers.clear()
        counts.clear()
        return batch_of(rows)

    for batch in batches:
        for doc_id, value in zip(batch["doc_id"].to_pylist(), batch["text"]):
            text = value.as_py()
            a, b = tokens(text, path_a, path_b)
            waiting.append((doc_id, a, b))
            size += len(text or "")
            bytes_waiting += int(sizes[0][a].sum()) + 64
            if size >= CHUNK:
                yield flush()
                chunk, size = chunk + 1, 0
            elif bytes_waiting >= MERGED:
                yield batch_of(documents())
    if waiting or numbers:
        yield flush()


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"


def _summed(documents: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of one chunk with the corpus-wide counts of their pairs."""
    number = answers["number"].to_numpy()
    count, best = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
    count[number], best[number] = answers["n"].to_numpy(), answers["best"].to_numpy(zero_copy_only=False)
    rows = []
    for own, times in zip(documents["pairs"], documents["times"]):
        own, times = own.values.to_numpy(), times.values.to_numpy().astype(np.int64)
        rows.append((int(times.sum()), int((times * best[own]).sum()), int((times * count[own]).sum())))
    links, n_best, total = zip(*rows)
    columns = [documents[c] for c in ("doc_id", "n_a", "n_b", "n_groups")] + [pa.array(links), pa.array(n_best), pa.array(total)] + [documents["groups_sha256"], documents["groups"]]
    return pa.Table.from_arrays(columns, [c.split()[0] for c in _RESULT.split(", ")])


def pair_counts(chunks: DataFrame) -> DataFrame:
    """``name, n, best`` of each pair of ids that is linked somewhere: its count, and whether none of its B id's is higher.

    The highest counts are one row for each B id, so at most the vocabulary's size.
    """
    pairs = chunks.where("names is not null").select(F.explode(F.arrays_zip("names", "counts")).alias("p")).select(F.col("p.names").alias("name"), F.col("p.counts").alias("n"))
    counts = stash(pairs.groupBy("name").agg(F.sum("n").alias("n")), "pairs")
    b = F.col("name").bitwiseAND(F.lit(0xFFFFFFFF))
    highest = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return counts.withColumn("b", b).join(F.broadcast(highest), "b").select("name", "n", (F.col("n") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, groups: bool = True) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` and, with ``groups``, the groups.

    ``path_a`` is a byte-level BPE (JSON or ranks), ``path_b`` a piece model;
    names of special tokens in a text are ordinary text.  Groups are written
    ``a1,a2|b1;a3|b2,b3``.  Null and empty texts, and texts whose bytes one side
    does not give back, have no tokens: zeros, and an empty string.  Rows with
    equal or null ids are documents of their own.  Other columns are not read.
    """
    path_a, path_b = path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = stash(rows.mapInArrow(lambda batches: _chunks(batches, path_a, path_b, groups), _CHUNKS), "chunks")
    known = stash(pair_counts(chunks), "known")
    asked = chunks.where("names is not null").select("chunk", F.posexplode("names").alias("number", "name"))
    answers = asked.join(known, "name").select(F.col("chunk").alias("of_chunk"), "number", "n", "best")
    documents = chunks.where("names is null").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times", "groups")
    out = documents.groupBy("chunk").cogroup(answers.groupBy("of_chunk")).applyInArrow(_summed, _RESULT)
    return out if groups else out.drop("groups")
