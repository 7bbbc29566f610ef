"""Lists of addresses: tokenising, verdicts, duplicates, addresses inside texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import urls
from corpusloom.functions.text import word_list
from corpusloom.session import stash

#: Marks that end a sentence rather than an address.
SENTENCE_END = ".,;:!?)]}»”'"
#: More addresses than this in a file: none of them is taken.
FILE_LIMIT = 200


def entries(lists: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, line, item, entry``: words of lines with an address, whole other lines; comments and blank lines go."""
    lines = lists.select(F.col(key), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\\R")).alias("line", "raw"))
    lines = lines.withColumn("raw", F.regexp_replace("raw", "(?U)^\\s+|\\s+$", "")).where("raw <> '' and not startswith(raw, '#')")
    words = word_list("raw")
    may = F.contains(F.col("raw"), F.lit("://")) | F.contains(F.lower("raw"), F.lit("www."))  # else no word is an address
    has = F.when(may, F.exists(words, lambda w: urls.verdict(w).isNull())).otherwise(False)
    return lines.select(key, "line", F.posexplode(F.when(has, words).otherwise(F.array(F.col("raw")))).alias("item", "entry"))


def verdicts(rows: DataFrame, url: str = "entry", order: list[str] | None = None, by: list[str] | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``reason``, ``canonical`` and ``verdict`` (accepted, duplicate or rejected).

    Of equal canonical addresses, within ``by`` if given, the first by
    ``order`` is accepted.  First ones are found by partial minima and joined
    back, so that an address on a third of all rows is no single group.
    """
    by, order = by or [], order or [url]
    rows = stash(rows.withColumns({"reason": urls.verdict(url), "canonical": urls.canonical(url, extra)}), "addresses")
    place = F.struct(*order)
    first = rows.where("canonical is not null").groupBy(*by, "canonical").agg(F.min(place).alias("first_place"))
    out = rows.join(first, [*by, "canonical"], "left")
    return out.withColumn("verdict", F.when(F.col("reason").isNotNull(), "rejected").when(place == F.col("first_place"), "accepted").otherwise("duplicate")).drop("first_place")


def collect(lists: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every entry of every list with its verdict."""
    return verdicts(entries(lists, key, text), "entry", ["line", "item"], [key])


def only_addresses(lists: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, only_addresses``: at least one address and nothing rejected."""
    found = collect(lists, key, text).groupBy(key).agg(F.count_if(F.col("verdict") == "accepted").alias("ok"), F.count_if(F.col("verdict") == "rejected").alias("bad"))
    return lists.select(key).distinct().join(found, key, "left").select(key, ((F.coalesce("ok", F.lit(0)) > 0) & (F.coalesce("bad", F.lit(0)) == 0)).alias("only_addresses"))


def addresses_in(text: Column, markdown: bool = False) -> Column:
    """Visible http(s) addresses of a text, without punctuation at their ends; of Markdown, no hidden targets."""
    if markdown:
        text = F.regexp_replace(text, "(?m)^ {0,3}\\[[^\\]]+\\]:[ \\t]*\\S+.*$", "")
        text = F.regexp_replace(text, "!?\\[([^\\]]*)\\]\\([^)]*\\)", "$1")
    found = F.regexp_extract_all(text, F.lit('https?://[^\\s<>"]+'), F.lit(0))
    ends = "".join("\\" + c for c in SENTENCE_END)
    return F.filter(F.transform(found, lambda u: F.regexp_replace(u, f"[{ends}]+$", "")), lambda u: urls.verdict(u).isNull())


def found_addresses(files: DataFrame, key: str = "doc_id", text: str = "text", limit: int = FILE_LIMIT, markdown: bool = False) -> DataFrame:
    """``key, url, canonical, found, over_limit``: distinct addresses of each text; those of a text with too many are marked and not to be used."""
    rows = files.select(key, F.posexplode(addresses_in(F.col(text), markdown)).alias("at", "url")).withColumn("canonical", urls.canonical("url"))
    once = rows.groupBy(key, "canonical").agg(F.min_by("url", "at").alias("url"))
    counts = once.groupBy(key).agg(F.count(F.lit(1)).alias("found"))
    return once.join(counts, key).withColumn("over_limit", F.col("found") > limit)


def merge_found(inputs: DataFrame, found: DataFrame) -> DataFrame:
    """Known inputs ``(canonical, ...)`` with the found addresses that they lack, marked as not explicit."""
    new = found.where("not over_limit").groupBy("canonical").agg(F.min("url").alias("url")).join(inputs.select("canonical"), "canonical", "left_anti")
    return inputs.withColumn("explicit", F.lit(True)).unionByName(new.withColumn("explicit", F.lit(False)), allowMissingColumns=True)


def work_list(sources: DataFrame, settled: DataFrame, key: str = "source_id") -> DataFrame:
    """Distinct sources that are not settled yet."""
    return sources.dropDuplicates([key]).join(settled.select(key), key, "left_anti")


def choose_track(tracks: DataFrame, languages: list[str], translated: bool = False, any_language: bool = True) -> DataFrame:
    """The subtitle track of each video: manual ones by language, automatic ones, translations, then any.

    ``tracks`` has ``video_id, lang, generated, translatable``.
    """
    at = F.array_position(F.array(*map(F.lit, languages)), F.col("lang"))
    rank = (
        F.when((at > 0) & ~F.col("generated"), 1).when((at > 0) & F.col("generated"), 2)
        .when(F.lit(translated) & F.col("translatable"), 3).when(F.lit(any_language), 4)
    )
    first = Window.partitionBy("video_id").orderBy("step", F.when(F.col("step") <= 2, at).otherwise(0), "generated", "lang")
    return tracks.withColumn("step", rank).where("step is not null").withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
