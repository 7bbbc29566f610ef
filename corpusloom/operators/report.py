"""Reports, manifests and lists of what needs a look: aggregates over sources, outputs and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import stash

STATUSES = "pending fetched extracted normalised duplicate packed skipped error".split()


def status_counts(sources: DataFrame) -> DataFrame:
    return sources.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def status_row(sources: DataFrame) -> DataFrame:
    """One row with a column for each status."""
    return sources.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def distinct_outputs(outputs: DataFrame) -> DataFrame:
    """Outputs once by path; equal paths describe the same file."""
    return outputs.groupBy("path").agg(*[F.min(c).alias(c) for c in outputs.columns if c != "path"])


def metrics(outputs: DataFrame, limit: int) -> DataFrame:
    """One row: files, counts by format, used slots, share of the limit (rounded half to even), words, largest file (the first path of equal ones).

    Of a text and its Markdown twin only the text's words count.
    """
    files = distinct_outputs(outputs).withColumn("stem", F.regexp_replace("path", "[.][^.]*$", "")).withColumn("kind", F.when(F.col("format") == "pdf", "pdf").otherwise("text"))
    per_stem = files.groupBy("stem", "kind").agg(F.coalesce(F.max(F.when(F.col("format") == "txt", F.col("n_words"))), F.max("n_words")).alias("words"))
    slots = per_stem.agg(F.count(F.lit(1)).alias("used_slots"), F.coalesce(F.sum("words"), F.lit(0)).alias("n_words"))
    one = files.agg(
        F.count(F.lit(1)).alias("files"), *[F.count_if(F.col("format") == f).alias(f"files_{f}") for f in ("txt", "md", "pdf")],
        F.min(F.struct((-F.col("n_bytes")).alias("n_bytes"), "path")).alias("top"),
    )
    share = F.when(F.lit(limit) <= 0, 0).otherwise(F.bround(F.col("used_slots") * 100.0 / limit)).cast("long")
    return one.join(F.broadcast(slots)).select("files", "files_txt", "files_md", "files_pdf", "used_slots", share.alias("limit_percent"), "n_words", F.col("top.path").alias("largest_file"), (-F.col("top.n_bytes")).alias("largest_bytes"))


def skipped_in_archives(entries: DataFrame) -> DataFrame:
    """One row ``skipped`` from ``archive, archive_status, status``: entries that were not accepted; an archive that was skipped whole counts once."""
    each = entries.groupBy("archive").agg(F.bool_or(F.col("archive_status") == "skipped").alias("whole"), F.count_if(~(F.col("status").eqNullSafe("accepted")) & F.col("status").isNotNull()).alias("n"))
    return each.agg(F.coalesce(F.sum(F.when(F.col("whole"), 1).otherwise(F.col("n"))), F.lit(0)).cast("long").alias("skipped"))


def not_processed(sources: DataFrame) -> DataFrame:
    return sources.where("status in ('skipped', 'error')").select("source_id", "status", "reason")


def verified(sources: DataFrame) -> DataFrame:
    return sources.where("verified").select("source_id", "verified_at")


#: How a review case is described to the user.
DESCRIPTION = "Możliwy duplikat źródła %s: podobieństwo %.2f, metoda %s."


def possible_duplicates(decisions: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, cases, descriptions``: for each source kept beside another that it may duplicate, its review cases.

    A source has a case for each decision about it, so its list is short
    however many sources resemble one main source.
    """
    described = F.format_string(DESCRIPTION, F.col("main_id").cast("string"), F.col("score").cast("double"), F.col("method"))
    rows = decisions.where("status = 'review'").select(key, F.struct("main_id", described.alias("description")).alias("case"))
    found = rows.groupBy(key).agg(F.array_sort(F.collect_list("case")).alias("all"))
    return found.select(key, F.size("all").alias("cases"), F.transform("all", lambda c: c["description"]).alias("descriptions"))


def possible_duplicate_members(decisions: DataFrame, key: str = "doc_id") -> DataFrame:
    """``main_id, key, score, n``: one row for each review case, with the number of cases that resemble the same source."""
    review = stash(decisions.where("status = 'review'").select("main_id", key, "score"), "review")
    counts = review.groupBy("main_id").agg(F.count(F.lit(1)).alias("n"))
    return review.join(counts, "main_id").select("main_id", key, "score", "n")


def to_check(sources: DataFrame, decisions: DataFrame, key: str = "source_id") -> DataFrame:
    """Sources that need a look and were not verified: suspicious, with warnings, or possible duplicates."""
    review = decisions.where("status = 'review'").select(key, F.lit(True).alias("possible_duplicate"))
    rows = sources.join(review, key, "left")
    need = (F.size(F.coalesce("reasons", F.array().cast("array<string>"))) > 0) | (F.size(F.coalesce("warnings", F.array().cast("array<string>"))) > 0) | F.coalesce("possible_duplicate", F.lit(False))
    return rows.where(need & ~F.coalesce("verified", F.lit(False)))


def weak_scans(scans: DataFrame, warning: float = 75.0) -> DataFrame:
    """Scans under the warning threshold or unreadable, worst first."""
    return scans.where((F.col("confidence") < warning) | F.col("unreadable")).orderBy(F.asc_nulls_first("confidence"), "name")


def manifest(sources: DataFrame, outputs: DataFrame, decisions: DataFrame, key: str = "source_id") -> DataFrame:
    """``section, id, entry``: a JSON entry for each source, output and decision (schema version 4)."""
    entry = lambda df, section, ident: df.select(F.lit(section).alias("section"), F.col(ident).cast("string").alias("id"), F.to_json(F.struct(F.lit(4).alias("schema_version"), *df.columns)).alias("entry"))
    return entry(sources, "sources", key).unionByName(entry(distinct_outputs(outputs), "outputs", "path")).unionByName(entry(decisions, "dedup", key))


def report_lines(numbers: DataFrame, counts: DataFrame) -> list[str]:
    """The report's text from one row of metrics and a few of counts."""
    row = numbers.first().asDict()
    lines = [f"{k.replace('_', ' ')}: {v}" for k, v in row.items()]
    return lines + [f"{r['status']}: {r['n']}" for r in counts.orderBy("status").limit(len(STATUSES)).collect()]
