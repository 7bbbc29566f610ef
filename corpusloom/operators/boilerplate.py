"""Removal of page elements that are no article text, from ordered blocks.

``blocks`` has ``doc_id, pos, tag, text, link_chars``.  Rules look at a
document's own neighbouring blocks, so windows are by document and small; the
phrases are fixed values of one language and may be replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import word_count

#: Limits of the rules.
REMOVED_SHARE, LINK_SHARE, LINK_RUN = 0.35, 0.9, 3
AFTER_VIDEO, IN_RUN, CAPTION, NEWSLETTER_BLOCKS, NEWSLETTER_HEAD, AUTHOR, AFTER_NAME, ELEMENT = 140, 160, 130, 5, 25, 100, 60, 180
#: Phrases (Polish).
EXACT = {"reklama": "advert", "zespół redakcyjny": "signature", "zapisz mnie": "newsletter button", "zapisz się": "newsletter button"}
READ_ALSO = ["czytaj także", "czytaj również", "zobacz także", "zobacz również", "przeczytaj także", "przeczytaj też", "polecane", "polecamy"]
NEWSLETTER_ENDS = ["zapisz mnie", "zapisz się", "subskrybuj", "zapisz sie"]
_ROLES = "Dziennikarz|Dziennikarka|Redaktor|Redaktorka|Autor|Autorka|Reporter|Reporterka"
_AGENCIES = "Getty Images|East News|PAP|Forum|Reuters|AP Photo|AFP|NurPhoto|Shutterstock|Newspix|Agencja Gazeta|Fotonews"
PATTERNS = (
    (r"(?iU)^(?:\s*(?:Udostępnij(?: na [^\W\d_]+?)?|Kopiuj link|Skopiuj link))+\s*$", "share buttons"),
    (r"(?iU)^Źródło (?:zdjęć|zdjęcia|wideo|grafiki|artykułu|filmu|ilustracji)\s*:.{0,80}$", "media source"),
    (r"(?iU)^\d[\d\s]*\s+komentarz(?:y|e|a|i)?$|^komentarze(?: \(\d+\))?$", "comment count"),
    (rf"(?iU)^(?:{_ROLES})(?: [\w.\-]+){{0,3}}$", "author note"),
    (rf"(?U)^[^\W\d_]+(?: [^\W\d_\-]+(?:-[^\W\d_]+)?){{0,2}} ?(?:{_ROLES})(?: [\w.\-]+){{0,3}}$", "author note"),
)
_CAPTION = rf"(?iU)(?:/|\bvia\b)\s*(?:[^/]{{0,40}}\s)?(?:{_AGENCIES})\b[^.]{{0,30}}$"
_SENTENCE_END = r'[.!?…:;"”»)\]]$'


def _single(text: Column, low: Column, authors: Column | None) -> Column:
    """The reason to remove a block by itself."""
    rules = [F.when(low == phrase, reason) for phrase, reason in EXACT.items()]
    for pattern, reason in PATTERNS:
        hit = (F.length(text) <= ELEMENT) & text.rlike(pattern)
        rules.append(F.when(hit & (~text.rlike("[.!?]$") if reason == "author note" else F.lit(True)), reason))
    if authors is not None:
        rest = lambda a: F.trim(F.substring(text, F.length(a) + 1, F.lit(10_000)))
        named = F.exists(F.coalesce(authors, F.array().cast("array<string>")), lambda a: low.startswith(F.lower(a)) & (F.length(rest(a)) <= AFTER_NAME) & ~rest(a).rlike("\\.$|[,:;]"))
        rules.append(F.when((F.length(text) <= AUTHOR) & named, "author note"))
    rules.append(F.when((F.length(text) <= CAPTION) & ~text.rlike("[.!?]$") & text.rlike(_CAPTION), "photo caption"))
    return F.coalesce(*rules)


def judge(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """``blocks`` with ``reason`` (null: stays) before the safeguard; the first rule that names a reason wins."""
    order = Window.partitionBy(key).orderBy("pos")
    text, low = F.col("text"), F.lower("text")
    looked_at = F.col("tag").isin("p", "head")
    authors = F.col("authors") if "authors" in blocks.columns else None
    rows = blocks.withColumns({"text": F.coalesce("text", F.lit(""))})
    rows = rows.withColumns({
        "_look": looked_at, "_low": low, "_single": F.when(looked_at & (text != ""), _single(text, low, authors)),
        "_link": looked_at & (text != "") & (F.length(text) <= IN_RUN) & (F.coalesce("link_chars", F.lit(0)) / F.nullif(F.length(text), F.lit(0)) >= LINK_SHARE),
    })
    video = F.col("_look") & (F.col("_low") == "wideo")
    starts = F.col("_look") & F.col("_low").startswith("newsletter")
    ahead = order.rowsBetween(1, NEWSLETTER_BLOCKS)
    closes = F.min(F.when(F.col("_low").isin(NEWSLETTER_ENDS), F.col("pos"))).over(ahead)
    rows = rows.withColumns({
        "_after_video": F.coalesce(F.lag(video).over(order), F.lit(False)) & (F.col("tag") == "p") & (F.length("text") > 0) & (F.length("text") <= AFTER_VIDEO),
        "_news_end": F.when(starts, F.coalesce(closes, F.col("pos"))),
        "_before_news": F.coalesce(F.lead(starts).over(order), F.lit(False)) & (F.length("text") > 0) & (F.length("text") <= NEWSLETTER_HEAD) & (F.upper("text") == F.col("text")) & (F.lower("text") != F.col("text")),
        "_also": F.col("_look") & F.trim(F.regexp_replace("_low", "[:\\s]+$", "")).isin(READ_ALSO),
        "_run": F.count_if(~F.col("_link")).over(order),
    })
    back = order.rowsBetween(-NEWSLETTER_BLOCKS, 0)
    run = Window.partitionBy(key, "_run", "_link")
    reason = F.coalesce(
        "_single", F.when(video, "video"), F.when(F.col("_after_video"), "video title"),
        F.when((F.max("_news_end").over(back) >= F.col("pos")) | F.col("_before_news"), "newsletter"),
    )
    rows = rows.withColumns({"_first": reason, "_in_run": F.when(F.col("_link"), F.count(F.lit(1)).over(run)), "_run_start": F.min("pos").over(run)})
    bio = (F.lag("_first").over(order) == "author note") & F.col("_first").isNull() & (F.col("tag") == "p") & F.col("text").rlike(rf"(?iU)^(?:{_ROLES})\b")
    rows = rows.withColumn("_bio", F.coalesce(bio, F.lit(False)))
    led = F.last(F.when(~F.col("_link"), F.col("_also")), ignorenulls=True).over(order)
    final = F.coalesce(F.col("_first"), F.when(F.col("_bio"), "author biography"), F.when(F.col("_also"), "read also"), F.when(F.col("_link") & led, "read also"), F.when(F.col("_in_run") >= LINK_RUN, "links"))
    return rows.withColumn("reason", final).select(*blocks.columns, "reason")


def filter_blocks(blocks: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Kept blocks (``key, pos, tag, text``; paragraphs that a removed block had cut are one again) and an audit of removals.

    If over 35 % of a document's words would go, nothing goes; the audit then
    has ``applied`` false.
    """
    judged = judge(blocks, key)
    words = judged.groupBy(key).agg(F.sum(F.when(F.col("reason").isNotNull(), word_count("text"))).alias("gone"), F.sum(word_count("text")).alias("all"))
    words = words.select(key, (F.coalesce("gone", F.lit(0)) <= REMOVED_SHARE * F.col("all")).alias("applied"))
    joined = judged.join(words, key)
    audit = joined.where("reason is not null").select(key, "pos", "reason", "text", "applied")
    order = Window.partitionBy(key).orderBy("pos")
    numbered = joined.withColumn("nth", F.row_number().over(order))
    kept = numbered.where("reason is null or not applied")
    gap = (F.col("nth") - F.lag("nth").over(order) > 1)
    cut = gap & (F.col("tag") == "p") & (F.lag("tag").over(order) == "p") & (F.lag("text").over(order) != "") & ~F.lag("text").over(order).rlike(_SENTENCE_END) & F.col("text").rlike("^\\p{Ll}")
    kept = kept.withColumn("cut", F.coalesce(cut, F.lit(False)))
    kept = kept.withColumn("part", F.count_if(~F.col("cut")).over(order))
    whole = kept.groupBy(key, "part").agg(F.min("pos").alias("pos"), F.min_by("tag", "pos").alias("tag"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text"))
    return whole.drop("part"), audit
