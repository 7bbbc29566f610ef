"""Tables that survive torn writes, and plans that are repacked as sources arrive."""

from __future__ import annotations

import json
import re

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions.text import byte_count, word_count
from corpusloom.operators import packing
from corpusloom.session import discard, stash


class Snapshots:
    """Versions of one table under ``path``: the pointer file ``CURRENT`` names the one that counts.

    A version is written whole, then described (its files, their sizes, its
    rows), then pointed to.  A reader takes the version that the pointer names if
    its description and all its files are there, else the one before, and so on;
    a write that was torn at any step is never read.  All goes through the
    session's file systems.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 3):
        if keep < 2:
            raise ValueError("keep two versions at least: one to fall back to")
        self.spark, self.path, self.most = spark, path, keep
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._files = root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _read(self, *parts: str) -> str | None:
        """A small file; none if it is not there or was torn (a file system that sums its blocks says so)."""
        at = self._at(*parts)
        if not self._files.exists(at):
            return None
        stream = self._files.open(at)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() == "ChecksumException":
                return None
            raise
        finally:
            stream.close()

    def _write(self, text: str, *parts: str) -> None:
        """Replaces a small file: written aside, then renamed."""
        aside, at = self._at(*parts[:-1], parts[-1] + ".new"), self._at(*parts)
        stream = self._files.create(aside, True)
        stream.write(bytearray(text, "utf-8"))
        stream.close()
        self._files.delete(at, False)
        if not self._files.rename(aside, at):
            raise OSError(f"could not write {at}")

    def _sizes(self, version: str) -> dict[str, int]:
        found = self._files.listStatus(self._at(version)) if self._files.exists(self._at(version)) else []
        return {f.getPath().getName(): f.getLen() for f in found if re.match("[^_.]", f.getPath().getName())}

    def versions(self) -> list[str]:
        """Names of all versions, whole or torn, newest first."""
        found = self._files.listStatus(self._at()) if self._files.exists(self._at()) else []
        return sorted((n for n in (f.getPath().getName() for f in found) if re.fullmatch(r"v-\d{10}", n)), reverse=True)

    def _whole(self, version: str) -> bool:
        told = self._read(version, "_described")
        try:
            return told is not None and json.loads(told)["files"] == self._sizes(version)
        except (ValueError, KeyError, TypeError):
            return False

    def current(self) -> str | None:
        """The version that readers take: the pointed one, or the newest whole one before it; without a pointer the newest whole one."""
        pointed = (self._read("CURRENT") or "").strip()
        names = self.versions()
        before = [n for n in names if n <= pointed] if re.fullmatch(r"v-\d{10}", pointed) else names
        return next((n for n in before if self._whole(n)), None)

    def read(self) -> DataFrame | None:
        """The table as the current version has it; none before the first write."""
        version = self.current()
        if version is None:
            return None
        told = json.loads(self._read(version, "_described"))
        return self.spark.read.schema(told["schema"]).parquet(f"{self.path}/{version}")

    def write(self, table: DataFrame) -> str:
        """Writes ``table`` as the next version and points to it; ``table`` may read the current one."""
        last = max((int(n[2:]) for n in self.versions()), default=0)
        version = f"v-{last + 1:010d}"
        table.write.parquet(f"{self.path}/{version}")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
        self._write(json.dumps({"files": self._sizes(version), "schema": schema}), version, "_described")
        self._write(version, "CURRENT")
        for old in [n for n in self.versions() if n <= version][self.most :]:
            self._files.delete(self._at(old), True)
        return version


def repack(batch: DataFrame, number: int, sources_path: str, plan_path: str, max_words: int, max_bytes: int, key: str = "doc_id", group: str = "source", text: str = "text") -> None:
    """Adds the sources of a batch and packs the groups that they belong to anew; all other groups' files stay as they are.

    ``sources_path`` has a part for each batch and group (null or blank: none),
    ``plan_path`` one for what a group merges and, for what is packed alone, one
    for each batch and group.  Only touched parts are read and replaced, so a
    batch that is run again does no harm, and the plan equals one made of all
    sources at once.  Keys are unique over all batches.
    """
    spark = batch.sparkSession
    named = F.coalesce(F.nullif(F.trim(F.col(group)), F.lit("")), F.lit(""))
    rows = batch.select(key, F.col(group), F.coalesce(F.col(text), F.lit("")).alias(text))
    sized = rows.withColumns({"n_words": word_count(text), "n_bytes": byte_count(text), "of": F.sha2(named, 256), "batch": F.lit(number).cast("long")})
    _replace(sized, sources_path, "batch", "of")
    every = spark.read.schema(sized.schema).parquet(sources_path)
    new = F.col("batch") == number
    # the groups' parts are pruned by this join where the batch has few of them
    touched = every.where(new).select("of").distinct()
    merged = packing.fits("n_words", "n_bytes", max_words, max_bytes) & (named != "")
    again = stash(every.where(new | merged).join(touched, "of", "left_semi"), "touched")
    planned = packing.plan(again.select(key, group, text), max_words, max_bytes, key, group, text).join(again.select(key, "of", "batch"), key)
    columns = "file_id", key, "group", "is_group", "bin", "part_no", "part_count", "n_words", "n_bytes"
    lot = F.when(F.col("is_group"), F.lit(-1).cast("long")).otherwise(F.col("batch"))
    _replace(planned.select(*columns, "of", lot.alias("lot")), plan_path, "of", "lot")
    discard(again)


def _replace(rows: DataFrame, path: str, *parts: str) -> None:
    """Replaces the parts that ``rows`` has; one task writes a part."""
    rows.repartition(*parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def stream_repack(stream: DataFrame, sources_path: str, plan_path: str, checkpoint: str, max_words: int, max_bytes: int, key: str = "doc_id", group: str = "source", text: str = "text") -> StreamingQuery:
    """``repack`` for each micro-batch of what is there now."""
    return (
        stream.writeStream.foreachBatch(lambda batch, number: repack(batch, number, sources_path, plan_path, max_words, max_bytes, key, group, text))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
