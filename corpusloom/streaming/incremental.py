"""Incremental runs: resuming, new against settled sources, operations, event windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions.text import content_hash, cosmetic_key
from corpusloom.session import stash


def pending(inputs: DataFrame, settled: DataFrame, key: str = "source_id") -> DataFrame:
    """Inputs that no earlier run settled."""
    return inputs.join(settled.select(key), key, "left_anti")


def settle_batch(new: DataFrame, base: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, cosmetic_key, status, main_id`` of a batch: new sources always lose against the base.

    The first new one of equal keys is kept if the base has none.  ``base`` has
    ``cosmetic_key, main_id``, one row for each key.
    """
    return settle_keys(stash(new.select(key, cosmetic_key(F.coalesce(text, F.lit(""))).alias("cosmetic_key")), "batch"), base, key)


def settle_keys(rows: DataFrame, base: DataFrame, key: str = "doc_id") -> DataFrame:
    """What ``settle_batch`` returns, of a written table ``key, cosmetic_key``; null keys equal each other and none of the base.

    Keys meet the base once each; sources then meet their key's row alone, in a
    join that adaptive execution can split where a key is hot.
    """
    first = rows.groupBy("cosmetic_key").agg(F.min(key).alias("first"))
    known = base.select("cosmetic_key", F.col("main_id").alias("settled"))
    heads = first.join(known, "cosmetic_key", "left").withColumnRenamed("cosmetic_key", "of")
    out = rows.join(heads, F.col("cosmetic_key").eqNullSafe(F.col("of")))
    main = F.coalesce("settled", "first")
    kept = F.col("settled").isNull() & (F.col(key) == F.col("first"))
    return out.select(key, "cosmetic_key", F.when(kept, "kept").otherwise("duplicate").alias("status"), F.when(~kept, main).alias("main_id"))


def stream_settle(stream: DataFrame, decisions_path: str, checkpoint: str, key: str = "doc_id", text: str = "text") -> StreamingQuery:
    """Settles each micro-batch against all earlier ones; decisions are a table, so a batch that is run again replaces its part."""
    spark = stream.sparkSession

    def run(batch: DataFrame, number: int) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(decisions_path)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            earlier = spark.read.parquet(decisions_path).where(F.col("batch") != number)
            base = earlier.where("status = 'kept'").select("cosmetic_key", F.col(key).alias("main_id"))
        else:  # the first batch
            base = batch.limit(0).select(F.lit("").alias("cosmetic_key"), F.col(key).alias("main_id"))
        settle_batch(batch, base, key, text).write.mode("overwrite").parquet(f"{decisions_path}/batch={number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_exact(stream: DataFrame, text: str = "text") -> DataFrame:
    """The first row of each distinct text of a stream; its state is one hash for each text."""
    return stream.withColumn("content_hash", content_hash(F.coalesce(text, F.lit("")))).dropDuplicates(["content_hash"])


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now into a table in memory, for tests and small results."""
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """``start, event_type, n, total`` of each window; works on tables and, with a watermark, on streams."""
    rows = events.withWatermark("ts", late) if late else events
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """``user_id, start, n`` of each user's sessions."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def fold_operations(operations: DataFrame, key: str = "source_id") -> DataFrame:
    """The last operation (verify, delete, replace, refetch) on each source, by time then number."""
    return operations.groupBy(key).agg(F.max_by(F.struct("op", "value", "at"), F.struct("at", "no")).alias("last")).select(key, "last.op", "last.value", "last.at")


def apply_operations(sources: DataFrame, operations: DataFrame, key: str = "source_id") -> DataFrame:
    """Sources after the last operation on each: deleted ones go, refetched ones wait, replaced ones have new text."""
    out = sources.join(fold_operations(operations, key), key, "left").where("coalesce(op, '') <> 'delete'")
    return out.withColumns({
        "verified": F.coalesce(F.col("op") == "verify", F.lit(False)) | F.coalesce("verified", F.lit(False)), "text": F.when(F.col("op") == "replace", F.col("value")).otherwise(F.col("text")),
        "status": F.when(F.col("op") == "refetch", "pending").when(F.col("op") == "replace", "extracted").otherwise(F.col("status")),
    }).drop("op", "value", "at")


def missing_outputs(sources: DataFrame, outputs: DataFrame, listing: DataFrame) -> DataFrame:
    """Sources whose output file is gone are skipped, and say so."""
    gone = outputs.join(listing.select("path"), "path", "left_anti").select("source_id").distinct().withColumn("gone", F.lit(True))
    out = sources.join(gone, "source_id", "left")
    return out.withColumn("status", F.when(F.col("gone"), "skipped").otherwise(F.col("status"))).withColumn("reason", F.when(F.col("gone"), "output_deleted").otherwise(F.col("reason"))).drop("gone")


def touched_groups(batch: DataFrame, sources: DataFrame, group: str = "group") -> DataFrame:
    """All sources of the groups that a batch adds to: these are packed anew."""
    return sources.join(batch.where(f"`{group}` is not null").select(group).distinct(), group, "left_semi")


def queue_order(requests: DataFrame) -> DataFrame:
    """Requests ``(project, at, ...)`` in the order of work: projects by their first request, each drained before the next."""
    firsts = requests.groupBy("project").agg(F.min("at").alias("first"))
    return requests.join(firsts, "project").orderBy("first", "project", "at").drop("first")


def on_progress(spark, report: Callable[[str, int], None]) -> None:
    """Calls ``report(name, rows)`` after each micro-batch."""
    from pyspark.sql.streaming import StreamingQueryListener

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            report(event.progress.name or str(event.progress.id), event.progress.numInputRows)

        def onQueryIdle(self, event):
            pass

        def onQueryTerminated(self, event):
            pass

    spark.streams.addListener(Listener())
