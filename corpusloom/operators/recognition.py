"""Decisions around recognised text and music; the engines themselves are plugged in as extractors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def page_text(words: DataFrame, key: str = "page_id") -> DataFrame:
    """``key, text, confidence, n_words`` from recognised words ``(key, block, par, line, word, text, conf)``.

    Lines become lines, blocks paragraphs; confidence is the mean of words that
    have one (not negative).
    """
    good = words.where("conf >= 0 and trim(text) <> ''")
    lines = good.groupBy(key, "block", "par", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda w: w["text"]), " ").alias("text"), F.sum("conf").alias("conf"), F.count(F.lit(1)).alias("n")
    )
    parts = lines.groupBy(key, "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("par", "line", "text"))), lambda x: x["text"]), "\n").alias("text"), F.sum("conf").alias("conf"), F.sum("n").alias("n"))
    return parts.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n\n").alias("text"), (F.sum("conf") / F.sum("n")).alias("confidence"), F.sum("n").alias("n_words")
    )


def best_attempt(attempts: DataFrame, key: str = "page_id") -> DataFrame:
    """Of several readings ``(key, attempt, text, confidence, n_words)`` the one with the greatest sum of confidence; ties: the first."""
    weight = F.struct((F.coalesce("confidence", F.lit(0.0)) * F.col("n_words")).alias("sum"), (-F.col("attempt")).alias("first"))
    return attempts.groupBy(key).agg(F.max_by(F.struct("attempt", "text", "confidence", "n_words"), weight).alias("best")).select(key, "best.*")


def needs_retry(confidence, threshold: float = 75.0):
    """Whether a page is read again, rotated or prepared."""
    return F.coalesce(confidence, F.lit(0.0)) < threshold


def collapse_runs(items: DataFrame, key: str = "source_id") -> DataFrame:
    """``key, first, last, value, times``: runs of equal adjacent values of ``(key, pos, value)``."""
    order = Window.partitionBy(key).orderBy("pos")
    new = F.when(F.row_number().over(order) == 1, 1).when(F.col("value").eqNullSafe(F.lag("value").over(order)), 0).otherwise(1)
    runs = items.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    return runs.groupBy(key, "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.min("value").alias("value"), F.count(F.lit(1)).alias("times")).drop("run")


def without_running_heads(lines: DataFrame, key: str = "doc_id", heads: int = 2) -> DataFrame:
    """Page lines ``(key, page, line, text)`` without what every page begins with (two lines at most) or numbers at its end.

    A single page keeps everything.
    """
    page = Window.partitionBy(key, "page")
    rows = lines.withColumn("last", F.max("line").over(page)).withColumn("first", F.min("line").over(page)).withColumn("at", F.col("line") - F.col("first"))
    pages = rows.groupBy(key).agg(F.countDistinct("page").alias("pages"))
    same = rows.where(F.col("at") < heads).groupBy(key, "at").agg(F.countDistinct("page").alias("on"), F.min("text").alias("a"), F.max("text").alias("b")).where("a = b").select(key, "at", "on")
    # the second line goes only with the first
    led = same.groupBy(key).agg(F.min("at").alias("least"))
    same = same.join(led.where("least = 0").select(key), key, "left_semi")
    numbers = rows.where("line = last").groupBy(key).agg(F.count_if(F.trim("text").rlike(r"^\W*\d+\W*$")).alias("numbered"))
    out = rows.join(pages, key).join(same, [key, "at"], "left").join(numbers, key)
    head = F.coalesce(F.col("on") == F.col("pages"), F.lit(False))
    foot = (F.col("line") == F.col("last")) & (F.col("numbered") == F.col("pages"))
    return out.where((F.col("pages") < 2) | ~(head | foot)).select(key, "page", "line", "text")


def is_scan(text, least: int = 20):
    """Whether a document has so little text that it must be recognised."""
    return F.length(F.trim(F.coalesce(text, F.lit("")))) < least


def describe_image(name, fmt, width, height, meta, words):
    """A description of an image from its name, size, metadata map and recognised words."""
    size = F.concat(F.upper(fmt), F.lit(", "), width.cast("string"), F.lit(" x "), height.cast("string"), F.lit(" px"))
    facts = F.array_join(F.transform(F.map_entries(F.coalesce(meta, F.create_map().cast("map<string,string>"))), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
    title = F.trim(F.regexp_replace(F.regexp_replace(name, "[.][^.]*$", ""), "[_-]+", " "))
    return F.concat_ws(". ", F.nullif(title, F.lit("")), size, F.nullif(facts, F.lit("")), F.when(words > 0, F.concat(F.lit("Text on the image: "), words.cast("string"), F.lit(" words"))))
