"""A sink that writes each row as a text file of its own, in two phases.

Tasks write into a folder of their own beside the target and tell the driver
what they wrote; only when all tasks are done are the files moved to their
places and listed in ``LISTING``.  A write that fails, or is lost with its
executors, puts no file in its place; what tasks were still writing when it
failed may stay in a ``_writing-`` folder, which readers skip.  Paths are those that Arrow's file
systems open (a folder that all executors share, or a store's address).
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "corpusloom_files"
#: The list of what was written, beside the files; no file may have its name.
LISTING = "written_files.json"
#: Files in a batch at most: a batch is in a worker's memory whole.
FILES = 32
_NAME = re.compile(r"[^/\x00]+(?:/[^/\x00]+)*")


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: (name, bytes, sha256) of each file, in its folder."""

    folder: str
    files: list[tuple[str, int, str]]


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path else "file://" + path)


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, name: str, body: str):
        self.path, self.name, self.body = path.rstrip("/"), name, body
        self.aside = f"{self.path}/_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        folder, files = f"{self.aside}/{uuid.uuid4().hex}", []
        store, at = _open(folder)
        store.create_dir(at, recursive=True)
        for batch in iterator:
            for name, body in zip(batch[self.name], batch[self.body]):  # one body at a time leaves Arrow
                name, body = name.as_py(), body.as_py()
                if not name or name == LISTING or not _NAME.fullmatch(name) or any(p in (".", "..") or p.startswith("_") for p in name.split("/")):
                    raise ValueError(f"no name for a file: {name!r}")
                raw = (body or "").encode()
                place = f"{at}/{len(files)}"
                with store.open_output_stream(place) as out:
                    out.write(raw)
                files.append((name, len(raw), hashlib.sha256(raw).hexdigest()))
        return Written(folder, files)

    def commit(self, messages: list[Written | None]) -> None:
        told = [m for m in messages if m is not None]
        names = [name for m in told for name, _, _ in m.files]
        if len(set(names)) != len(names):
            self._clear()
            raise ValueError("two rows have one name")
        store, at = _open(self.path)
        for m in told:
            _, folder = _open(m.folder)
            for i, (name, _, _) in enumerate(m.files):
                store.create_dir(f"{at}/{name}".rpartition("/")[0], recursive=True)
                store.move(f"{folder}/{i}", f"{at}/{name}")
        listed = [{"file": name, "n_bytes": size, "checksum": digest} for m in told for name, size, digest in m.files]
        with store.open_output_stream(f"{at}/{LISTING}") as out:
            out.write("\n".join(json.dumps(x) for x in sorted(listed, key=lambda x: x["file"])).encode())
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, at = _open(self.aside)
        if store.get_file_info(at).type != pa.fs.FileType.NotFound:
            store.delete_dir(at)


class TextFiles(DataSource):
    """``df.write.format("corpusloom_files").mode("append").save(path)`` of rows with a name and a body (options ``name`` and ``body``)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        name, body = self.options.get("name", "file"), self.options.get("body", "body")
        for column in (name, body):
            if column not in schema.fieldNames() or schema[column].dataType.simpleString() != "string":
                raise ValueError(f"no text in a column {column}")
        if overwrite:
            raise ValueError("files are added; choose a new folder or mode append")
        return Writer(self.options["path"], name, body)


def write_text_files(files: DataFrame, path: str, name: str = "file_id", body: str = "body") -> DataFrame:
    """Writes one file for each row and returns ``file, n_bytes, checksum`` of all, as the tasks told it.

    Names are unique; a name or body that is missing, or two equal names, end
    the write without a trace.
    """
    spark: SparkSession = files.sparkSession
    spark.dataSource.register(TextFiles)
    rows, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(rows, FILES)
    try:
        files.select(name, body).write.format(FORMAT).option("name", name).option("body", body).mode("append").save(path)
    finally:
        spark.conf.set(rows, before)
    return spark.read.schema("file string, n_bytes long, checksum string").json(f"{path}/{LISTING}")
