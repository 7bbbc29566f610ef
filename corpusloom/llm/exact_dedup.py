"""Exact deduplication by deterministic block naming.

Texts are cut into blocks of ``BLOCK`` bytes.  Blocks are sorted and ranked
into integer names; adjacent names are then paired and the pairs named in the
same way, level by level, until each document has one name.  Equal names mean
equal texts, whatever any hash does: hashes only deal blocks to tasks, and
where one hash stands for several blocks these are told apart by their bytes.

Blocks are cut and written once.  Copies meet before the shuffle, in partial
aggregation, so that no group of copies meets in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import ascii_lower, discard, scratch, stash

BLOCK = 4096
ROW = "corpusloom_row"
#: What deals blocks to tasks; any function gives the same groups.
block_hash = F.xxhash64


def integer_names(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: the rank-preserving integer of its ``keys`` (not null) among all rows."""
    table = df.select(*keys).distinct().repartitionByRange(*keys).sortWithinPartitions(*keys)
    table = stash(table.withColumn("name", F.monotonically_increasing_id()), name)
    return df.join(table, keys)


def _blocks(rows: DataFrame) -> DataFrame:
    row = rows.select(F.col(ROW).alias("row"), "doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("text"))
    row = row.select("row", "doc_id", F.sha2("text", 256).alias("text_sha256"), F.col("text").cast("binary").alias("bytes"))
    row = row.withColumn("last", F.greatest(F.ceil(F.octet_length("bytes") / BLOCK), F.lit(1)).cast("int") - 1)
    cut = F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.substring("bytes", i * BLOCK + 1, F.lit(BLOCK)))
    only_first = lambda c: F.when(F.col("pos") == 0, F.col(c)).alias(c)
    blocks = row.select("row", "doc_id", "text_sha256", "last", F.posexplode(cut).alias("pos", "block"))
    return blocks.select("row", "pos", "last", only_first("doc_id"), only_first("text_sha256"), block_hash("block").alias("h"), "block")


def name_documents(rows: DataFrame) -> DataFrame:
    """``row, doc_id, text_sha256, level, name``: rows have equal (level, name) if and only if their texts are equal.

    ``rows`` has ``ROW``, ``doc_id`` and ``text``.
    """
    blocks = stash(_blocks(rows), "blocks")
    several = blocks.select("h", "block").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    several = stash(several, "several")
    if several.isEmpty():
        level = blocks.drop("block").withColumn("rank", F.lit(1))
    else:
        few = blocks.select("h", "block").join(several, "h", "left_semi").distinct()
        few = stash(few.withColumn("rank", F.row_number().over(Window.partitionBy("h").orderBy("block"))), "few")
        level = blocks.join(few, ["h", "block"], "left").drop("block").withColumn("rank", F.coalesce("rank", F.lit(1)))
    first = _named(level, ["h", "rank"], 0)
    discard(blocks)
    return _pair_up(first)


def _named(level: DataFrame, keys: list[str], depth: int) -> DataFrame:
    return stash(integer_names(level, keys, "names").select("row", "pos", "last", "doc_id", "text_sha256", "name"), f"level-{depth}")


def _pair_up(level: DataFrame) -> DataFrame:
    """Names pairs of adjacent names until every document has one; ``last`` is the position of its last name."""
    done, depth = [], 0
    while True:
        done.append(level.where("last = 0").select("row", "doc_id", "text_sha256", F.lit(depth).alias("level"), "name"))
        more = level.where("last > 0")
        if more.isEmpty():
            return reduce(DataFrame.unionByName, done)
        pairs = more.groupBy("row", F.shiftright("pos", 1).alias("up")).agg(
            F.max(F.shiftright("last", 1)).alias("last"), F.max("doc_id").alias("doc_id"), F.max("text_sha256").alias("text_sha256"),
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
        )
        depth += 1
        level = _named(stash(pairs.withColumnRenamed("up", "pos"), "pairs"), ["left", "right"], depth)


def _groups(rows: DataFrame) -> DataFrame:
    named = stash(name_documents(rows), "named")
    groups = named.groupBy("level", "name").agg(F.max(F.struct("doc_id", (-F.col("row")).alias("of"))).alias("best"), F.count(F.lit(1)).alias("group_size"))
    groups = stash(groups, "groups")
    return named.join(groups, ["level", "name"]).select(
        "row", "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == -F.col("best.of")).alias("kept"), "text_sha256",
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal if they are identical after lower-casing A-Z; null counts
    as empty.  The row with the largest ``doc_id`` of a group stays (null ids
    come last; of repeated ids one row stays).  Other columns are not read.
    """
    return _groups(docs.select(F.monotonically_increasing_id().alias(ROW), "doc_id", "text")).drop("row")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, with all their columns.

    Rows of equal id and text, of which one stays, are the same to this; what
    their other columns hold decides nothing.
    """
    mark = F.xxhash64("text")
    with scratch(docs.sparkSession) as keep:
        found = _groups(docs.select(F.monotonically_increasing_id().alias(ROW), F.struct("doc_id", mark.alias("mark")).alias("doc_id"), "text"))
        # a written table has a known size: Spark broadcasts it only where it is small
        best = keep(stash(found.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id.*", "kept"), "kept"))
    once = best.where("kept").select(F.col("doc_id").alias("kept_id"), F.col("mark").alias("kept_mark"))
    out = docs.join(once, docs["doc_id"].eqNullSafe(once["kept_id"]) & (F.xxhash64(docs["text"]) == once["kept_mark"]), "left_semi")
    return out if best.where("not kept").isEmpty() else out.dropDuplicates(["doc_id", "text"])
