"""The event log: what each phase wrote, counted by the pass that writes it."""

from __future__ import annotations

import time
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import stash

SCHEMA = "run string, nth int, phase string, at timestamp, seconds double, n_rows long, counts map<string,long>, error string"


class Log:
    """Events of one run, one row a phase; counts are observed while a phase's table is written, so nothing is read twice."""

    def __init__(self, spark: SparkSession, run: str | None = None):
        self.spark, self.run = spark, run or uuid.uuid4().hex
        self._rows: list[tuple] = []

    def written(self, table: DataFrame, phase: str, **counts: Column) -> DataFrame:
        """``table``, written as ``stash`` writes it, with an event: its rows and the given aggregates (whole numbers).

        A phase that fails leaves an event with its error, and the error goes on.
        """
        seen = Observation(f"{phase}-{uuid.uuid4().hex}")
        named = [F.count(F.lit(1)).alias("n_rows"), *[F.coalesce(c.cast("long"), F.lit(0)).alias(n) for n, c in counts.items()]]
        began, at = time.monotonic(), datetime.now(timezone.utc)
        try:
            out = stash(table.observe(seen, *named), phase)
        except Exception as e:
            self._rows.append((self.run, len(self._rows) + 1, phase, at, time.monotonic() - began, None, None, str(e).partition("\n")[0]))
            raise
        found = seen.get
        self._rows.append((self.run, len(self._rows) + 1, phase, at, time.monotonic() - began, found.pop("n_rows"), found, None))
        return out

    def events(self) -> DataFrame:
        """A row for each phase so far; they are few."""
        return self.spark.createDataFrame(self._rows, SCHEMA)

    def append(self, path: str) -> None:
        """Adds the events to the log of all runs."""
        self.events().coalesce(1).write.mode("append").parquet(path)


def phases(log: DataFrame) -> DataFrame:
    """``phase, runs, failed, n_rows, seconds``: what all runs of a log wrote, by phase."""
    return log.groupBy("phase").agg(F.count_distinct("run").alias("runs"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.sum("n_rows").alias("n_rows"), F.sum("seconds").alias("seconds"))
