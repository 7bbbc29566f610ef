"""The whole flow over a table of sources: normalise, score, deduplicate, plan files, render, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.config import Config, from_session
from corpusloom.functions import quality
from corpusloom.functions.text import byte_count, char_count, first_line_title, normalize, source_id, word_count
from corpusloom.operators import dedup, packing, render, report
from corpusloom.plans.audit import Log
from corpusloom.session import stash


def normalized(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with texts in normal form and ``title, n_words, n_chars, n_bytes``.

    The normal form is written once: as an expression it would be evaluated
    anew by everything that reads it.
    """
    rows = stash(docs.withColumn(text, normalize(F.coalesce(text, F.lit("")))), "normalized")
    return rows.withColumns({"title": first_line_title(text), "n_words": word_count(text), "n_chars": char_count(text), "n_bytes": byte_count(text)})


def survivors(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Which documents survive exact and cosmetic deduplication, and why the others do not."""
    rows = normalized(docs.select(key, text), key, text)
    return rows.select(key, "n_words", "n_chars", "n_bytes").join(dedup.exact_and_cosmetic(rows, key, text), key)


def run(docs: DataFrame, config: Config | None = None, key: str = "doc_id", group: str = "source", text: str = "text", log: Log | None = None) -> dict[str, DataFrame]:
    """All tables of a run: sources, decisions, skipped, plan, outputs, metrics, manifest, events.

    Nothing disappears silently: every source has a status and, if it is not
    packed, a reason.  A column ``kind``, if there is one, routes sources (images
    and music are packed by their own rules) and says, with ``format``, whose
    extraction is scored.  Sources alone in their files, whose parts exceed what
    is left of the slots, are skipped whole, in the order of ``key``.
    """
    config, log = config or from_session(docs.sparkSession), log or Log(docs.sparkSession)
    more = [c for c in ("kind", "format") if c in docs.columns]
    rows = normalized(docs.select(key, F.col(group), F.col(text), *more), key, text)
    scored = quality.is_scored("kind", "format" if "format" in more else F.lit(None).cast("string")) if "kind" in more else F.lit(True)
    reasons = F.when(scored, quality.extraction_reasons(text, F.col("title"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumns({"source_id": source_id("text", text), "reasons": reasons, "block_page": scored & quality.is_block_page(text)})
    sources = log.written(rows, "sources", n_words=F.sum("n_words"), empty=F.count_if(F.col("n_words") == 0), block_pages=F.count_if("block_page"), suspicious=F.count_if(F.size("reasons") > 0))
    skipped = sources.where((F.col("n_words") == 0) | F.col("block_page")).select(key, F.when(F.col("n_words") == 0, "empty").otherwise("block_page").alias("reason"))
    usable = sources.where((F.col("n_words") > 0) & ~F.col("block_page"))
    decisions = log.written(dedup.deduplicate(usable.select(key, text), config, key=key, text=text), "decisions", **{s: F.count_if(F.col("status") == s) for s in ("kept", "duplicate", "review")})
    kept = usable.join(decisions.where("status <> 'duplicate'").select(key), key, "left_semi")
    admitted = log.written(packing.admit(kept, config.slots, key, group), "slots", admitted=F.count_if("admitted"))
    planned = packing.plan_kinds(admitted.where("admitted"), config.words_per_file, config.bytes_per_file, key, group, text) if "kind" in more else packing.plan(admitted.where("admitted"), config.words_per_file, config.bytes_per_file, key, group, text)
    # a source in parts takes a slot for each: what groups leave goes to single sources in order
    planned = stash(planned, "planned")
    left = config.slots - planned.where("is_group").select("file_id").distinct().count()
    parts = planned.where("not is_group").groupBy(key).agg(F.count(F.lit(1)).alias("part_count"))
    too_many = stash(packing.within_remaining(parts, max(0, left), key).where("not fits").select(key), "too-many")
    plan = log.written(planned.join(too_many, key, "left_anti"), "plan", n_words=F.sum("n_words"), n_bytes=F.sum("n_bytes"), merged=F.count_if("is_group"))
    skipped = skipped.unionByName(admitted.where("not admitted").select(key, F.lit("no_slot").alias("reason"))).unionByName(too_many.select(key, F.lit("too_many_parts").alias("reason")))
    skipped = log.written(skipped, "skipped")
    outputs = plan.groupBy("file_id").agg(F.sum("n_words").alias("n_words"), F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("sources")).withColumns({"path": F.concat("file_id", F.lit(".txt")), "format": F.lit("txt")})
    status = (
        sources.join(decisions.select(key, F.col("status").alias("decision"), "main_id"), key, "left").join(skipped, key, "left")
        .withColumn("status", F.when(F.col("reason").isNotNull(), "skipped").when(F.col("decision") == "duplicate", "duplicate").otherwise("packed"))
    )
    return {
        "sources": status.drop(text), "decisions": decisions, "skipped": skipped, "plan": plan, "outputs": outputs, "metrics": report.metrics(outputs, config.slots),
        "manifest": report.manifest(status.select(key, "source_id", "title", "n_words", "n_chars", "status", "reason"), outputs, decisions, key),
        "headers": kept.select(key, render.header(title=F.col("title"), type=F.lit(render.TYPES["text"]), source_id=F.col("source_id")).alias("header")),
        "events": log.events(),
    }
