"""Ordered groups cut into chunks, so that sequential rules need no task that reads a group."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import stash

#: The columns that hold a row's chunk and its place in it.
CHUNK, NTH = "corpusloom_chunk", "corpusloom_nth"


def chunked(rows: DataFrame, group: str, order: list[str], size: int, name: str = "chunks") -> DataFrame:
    """``rows`` with ``CHUNK`` and ``NTH``, written: in order, chunks hold up to ``size`` rows of one group and their numbers ascend.

    Ranges of a sort deal the rows, so a group of any size is spread.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, last = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            numbers, places = [], []
            for g in batch[group].to_pylist():
                if held and (g != last or held == size):
                    number, held = number + 1, 0
                numbers.append(number)
                places.append(held)
                last, held = g, held + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64()), pa.array(places, pa.int32())], [*batch.schema.names, CHUNK, NTH])

    ordered = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    return stash(ordered.mapInArrow(run, f"{schema_of(rows)}, {CHUNK} long, {NTH} int"), name)


def schema_of(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)


def listed(rows: DataFrame, group: str, **sums) -> DataFrame:
    """``chunk, of`` (its group) and the given aggregates of each chunk of a chunked table."""
    return rows.groupBy(F.col(CHUNK).alias("chunk")).agg(F.min(group).alias("of"), *[c.alias(n) for n, c in sums.items()])
