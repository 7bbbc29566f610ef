"""Byte-level BPE: every distinct word of the corpus is encoded once.

1. Tasks split texts into pre-tokens and number the distinct ones of a chunk of
   documents by frequency; documents become numbers, with their positions kept.
2. The chunks' words are dealt by word over all tasks.  There each distinct word
   is encoded once, whatever number of chunks it came from.
3. The ids go back to the chunks, where the documents are reassembled by
   position.  Decoding looks each word's ids up in the table of token bytes.

A row for each pre-token would shuffle some eight times the input's size.  So
words travel in sorted blocks, a block for each chunk and word bucket, and the
numbered documents are written once, bucketed by chunk, and never shuffled.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import tokenizers
from corpusloom.llm.common import shared_dir, stash

#: Characters of text in a chunk, and pre-tokens after which a long document is cut from the next.
CHUNK = 16 << 20
#: Word buckets, at most: a chunk makes so many blocks whatever the input's size.  A bucket's blocks stream through its task.
BUCKETS = 4096


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _planes(values: np.ndarray) -> bytes:
    """uint32 values, compressed by byte planes."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unplaned(raw: bytes) -> np.ndarray:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(data.reshape(4, -1).T).view("<u4").ravel() if len(data) else np.empty(0, np.uint32)


def _blocks(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """A row with the documents of each chunk (bucket -1), and one for each of its word buckets."""
    pattern, task = tokenizers.pretoken_pattern(), TaskContext.get().partitionId()
    compress = zstandard.ZstdCompressor(level=3).compress
    numbers, docs, size, chunks = _Numbers(), [], 0, 0

    def flush() -> pa.RecordBatch:
        chunk = (task << 24) + chunks
        counts = np.zeros(len(numbers), np.int64)
        for _, words in docs:
            counts += np.bincount(words, minlength=len(numbers))
        rank = np.empty(len(numbers), np.uint32)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(numbers), dtype=np.uint32)
        every = np.concatenate([rank[w] for _, w in docs]) if docs else np.empty(0, np.uint32)
        rows = [(chunk, -1, [d for d, _ in docs], _planes(np.array([len(w) for _, w in docs], np.uint32)), _planes(every))]
        dealt: dict[int, list[str]] = {}
        for word in sorted(numbers):
            dealt.setdefault(zlib.crc32(word.encode()) % buckets, []).append(word)
        for bucket, words in dealt.items():
            parts = [w.encode() for w in words]
            ranks = np.concatenate((np.array([len(p) for p in parts], np.uint32), rank[[numbers[w] for w in words]]))
            rows.append((chunk, bucket, None, _planes(ranks), compress(b"".join(parts))))
        columns = zip(*rows)
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["chunk", "bucket", "docs", "sizes", "body"])

    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
            words = pattern.findall(text.as_py() or "")
            docs.append((doc_id, np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))))
            size += len(text.as_py() or "")
            if size >= CHUNK:
                yield flush()
                numbers, docs, size, chunks = _Numbers(), [], 0, chunks + 1
    if docs:
        yield flush()


def _encode_bucket(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """The ids of one bucket's words, block by block as they stream in; each distinct word is encoded once."""
    known: dict[bytes, list[int]] = {}
    coder = tokenizers.byte_bpe(path)
    decompress = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        chunks, heads, bodies = [], [], []
        for chunk, sizes, body in zip(batch["chunk"], batch["sizes"], batch["body"]):
            lengths, ranks = np.split(_unplaned(sizes.as_py()), 2)
            words, at, found = decompress(body.as_py()), 0, []
            for n in lengths.tolist():
                word = words[at : at + n]
                at += n
                ids = known.get(word)
                if ids is None:
                    ids = known[word] = coder._encode_single_piece(word)
                found.append(ids)
            counts = np.array([len(i) for i in found], np.uint32)
            chunks.append(chunk.as_py())
            heads.append(_planes(np.concatenate((np.array([len(ranks)], np.uint32), ranks, counts))))
            bodies.append(_planes(np.array([i for ids in found for i in ids], np.uint32)))
        columns = [pa.array(chunks, pa.int64()), pa.array(heads, pa.binary()), pa.array(bodies, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["chunk", "ranks", "ids"])


_ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>"


def _reassemble(documents: pa.Table, answers: pa.Table, path: str, keep: bool) -> pa.Table:
    """The documents of one chunk from their numbers and the ids of its words."""
    token_bytes = {rank: raw for raw, rank in tokenizers.ranks(path).items()}
    blocks = [(_unplaned(r), _unplaned(i)) for r, i in zip(answers["ranks"].to_pylist(), answers["ids"].to_pylist())]
    size = sum(int(head[0]) for head, _ in blocks)
    texts, decoded, counts = [b""] * size, [b""] * size, np.zeros(size, np.int64)
    ids_of: list[list[int]] = [[]] * size
    for head, flat in blocks:
        n = int(head[0])
        at, values = 0, flat.tolist()
        counts[head[1 : n + 1]] = head[n + 1 :]
        for rank, many in zip(head[1 : n + 1].tolist(), head[n + 1 :].tolist()):
            ids = values[at : at + many]
            at += many
            texts[rank] = ",".join(map(str, ids)).encode()
            decoded[rank] = b"".join(map(token_bytes.__getitem__, ids))
            if keep:
                ids_of[rank] = ids
    rows = []
    for docs, sizes, body in zip(documents["docs"].to_pylist(), documents["sizes"].to_pylist(), documents["body"].to_pylist()):
        numbers, ends = _unplaned(body), np.cumsum(_unplaned(sizes).astype(np.int64))
        for doc_id, a, b in zip(docs, np.concatenate(([0], ends[:-1])).tolist(), ends.tolist()):
            words = numbers[a:b]
            order = words.tolist()
            rows.append((
                doc_id, int(counts[words].sum()), hashlib.sha256(b",".join(map(texts.__getitem__, order))).hexdigest(),
                hashlib.sha256(b"".join(map(decoded.__getitem__, order))).hexdigest(), [i for w in order for i in ids_of[w]] if keep else None,
            ))
    columns = list(zip(*rows)) or [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()))
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])


def encode(docs: DataFrame, path: str | None = None, ids: bool = True) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, with ``ids``, the ids.

    ``path`` is a rank file or a byte-level BPE in JSON; special tokens' names
    are ordinary text.  ``ids_sha256`` is of the decimal ids joined by commas,
    ``decoded_sha256`` of the bytes the ids stand for.  Null texts count as
    empty: no tokens.  Rows with equal or null ids are documents of their own.
    Other columns are not read.
    """
    spark, path = docs.sparkSession, path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = rows.rdd.getNumPartitions()
    buckets = min(BUCKETS, max(32, parts))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _encode_bucket(batches, path)

    blocks = rows.mapInArrow(lambda b: _blocks(b, buckets), "chunk long, bucket int, docs array<long>, sizes binary, body binary")
    numbered = _bucketed(blocks, max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    words = numbered.where("bucket >= 0").select("bucket", "chunk", "sizes", "body")
    answers = words.groupBy("bucket").applyInArrow(encoded, "chunk long, ranks binary, ids binary")
    documents = numbered.where("bucket < 0").select("chunk", "docs", "sizes", "body")
    out = documents.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda a, b: _reassemble(a, b, path, ids), _ENCODED)
    return out if ids else out.drop("ids")


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed by chunk, so that the documents need no shuffle."""
    spark, name = df.sparkSession, f"corpusloom_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", f"{shared_dir(spark)}/stash/{name}").bucketBy(buckets, "chunk").saveAsTable(name)
    return spark.table(name)


def token_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The table ``(id, bytes)`` of a vocabulary."""
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return docs.sparkSession.createDataFrame([(rank, raw) for raw, rank in tokenizers.ranks(path).items()], "id int, bytes binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, decoded`` (binary) from rows ``doc_id, ids``, by a join with the table of token bytes.

    The table has a row for each token of the vocabulary, so it may be
    broadcast.  Unknown ids decode to nothing; null ids count as none.
    """
    rows = stash(encoded.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")), "ids")
    tokens = rows.select("row", F.posexplode("ids").alias("pos", "id")).join(F.broadcast(token_table(encoded, path)), "id")
    texts = tokens.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "bytes"))).alias("all"))
    joined = F.aggregate("all", F.lit(b""), lambda s, x: F.concat(s, x["bytes"]))
    return rows.join(texts, "row", "left").select("doc_id", F.coalesce(joined, F.lit(b"")).alias("decoded"))
