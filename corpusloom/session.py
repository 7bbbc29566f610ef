"""Sessions: settings of a local one, and how the package reaches the executors."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()
#: Folders of the tables that ``stash`` has written in the innermost ``scratch`` of this thread.
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="corpusloom-")) / "corpusloom.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(_PACKAGE.rglob("*.py")):
            archive.write(path, Path(_PACKAGE.name) / path.relative_to(_PACKAGE))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def local_session(name: str = "corpusloom", cores: str = "*", **settings: str) -> SparkSession:
    """A session on this machine, for tests and trials."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    for key, value in (defaults | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a local session without ``spark.checkpoint.dir`` (tests) gets a
    temporary folder; a cluster without the setting is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    The files survive lost executors and stay until they are discarded, the
    ``scratch`` they were written in ends, or the folder is cleared.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if (own := _scratch.get()) is not None:
        own.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stashed_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``stash`` returned and that nothing will read again."""
    for table in tables:
        _delete(table.sparkSession, table.stashed_at)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """The tables that ``stash`` writes inside go at the end, but for those handed to what this yields.

    What a result still reads must be kept: lazy results are written and kept,
    or rest on kept tables alone.  Scratches nest: kept tables belong to the outer one.
    """
    outer, own, kept = _scratch.get(), [], set()
    token = _scratch.set(own)

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table.stashed_at)
        return table

    try:
        yield keep
    finally:
        _scratch.reset(token)
        for path in own:
            if path not in kept:
                _delete(spark, path)
            elif outer is not None:
                outer.append(path)


def forget(spark: SparkSession) -> None:
    """Lets Spark clear the shuffle files of plans that are gone."""
    gc.collect()
    spark._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores at least: a table in a file or two would otherwise be read by as many tasks.  Large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
