"""Quality verdicts as columns: extraction, recognised text, speech, structure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import col, word_count, word_list

#: Phrases of error, login and script-wall pages.
SUSPECT_PHRASES = (
    "włącz javascript", "wlacz javascript", "enable javascript", "javascript is required", "please enable", "strona nie została znaleziona", "nie znaleziono strony",
    "page not found", "404 not found", "access denied", "odmowa dostępu", "dostęp zabroniony", "zaloguj się, aby zobaczyć", "zaloguj się, aby przeczytać",
    "zaloguj się, aby kontynuować", "musisz się zalogować, aby", "dostęp tylko dla zalogowanych", "masz już konto? zaloguj się", "sign in to view", "sign in to continue",
    "log in to continue", "please log in to view", "you must be logged in to view", "already have an account? sign in",
)
#: Characters that count as text besides letters and digits.
TEXT_MARKS = " \n\t.,;:!?()[]{}-–—…„”\"'«»/%°№#&@+=*"
#: Thresholds.
MIN_WORDS, MIN_PARAGRAPHS, REPEATS, EMPTY_SECTIONS, HEADINGS, TIMES_LONGER = 50, 2, 3, 2, 2, 2.0
ODD_SHARE, VOWEL_SHARE, VOWEL_WORDS, CONFIDENCE = 0.25, 0.6, 6, 50.0


def paragraphs(text: str | Column, separator: str = "\n\n") -> Column:
    """Trimmed parts between separators that are not blank."""
    parts = F.transform(F.split(col(text), separator), lambda p: F.regexp_replace(p, "(?U)^\\s+|\\s+$", ""))
    return F.filter(parts, lambda p: p != "")


def suspect_phrase(text: str | Column, phrases=SUSPECT_PHRASES) -> Column:
    """The first phrase of the list that the text contains, in any case; null if none."""
    low = F.lower(col(text))
    return F.coalesce(*[F.when(F.contains(low, F.lit(p)), p) for p in phrases])


def most_repeated(parts: Column) -> Column:
    """How often the most frequent element occurs."""
    sorted_parts = F.array_sort(parts)
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, p: Column) -> Column:
        run = F.when(s["last"].eqNullSafe(p), s["run"] + 1).otherwise(1)
        return F.struct(p.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(sorted_parts, start, step, lambda s: s["best"])


def headings(text: str | Column) -> tuple[Column, Column]:
    """Number of heading lines (``#``) and of headings without content below."""
    lines = F.filter(F.transform(F.split(col(text), "\\R"), lambda p: F.regexp_replace(p, "(?U)^\\s+|\\s+$", "")), lambda p: p != "")
    marks = F.transform(lines, lambda p: p.startswith("#"))
    count = F.size(F.filter(marks, lambda m: m))
    # an index inside a lambda would make the whole array anew for each line
    following = F.concat(F.slice(marks, F.lit(2), F.size(marks)), F.array(F.lit(True)))
    empty = F.size(F.filter(F.zip_with(marks, following, lambda a, b: F.coalesce(a, F.lit(False)) & F.coalesce(b, F.lit(True))), lambda m: m))
    return count, F.when(F.size(marks) == 0, 0).otherwise(empty)


def extraction_reasons(text: str | Column, title: Column, source_html: Column | None = None, comparison: Column | None = None, separator: str = "\n\n") -> Column:
    """Codes of what is suspicious about an extracted text, in a fixed order; empty: nothing."""
    t = F.coalesce(col(text), F.lit(""))
    words, parts = word_count(t), paragraphs(t, separator)
    count, empty = headings(t)
    checks = [
        F.when(words < MIN_WORDS, "few_words"), F.when(F.coalesce(F.trim(title), F.lit("")) == "", "no_title"), F.when(F.size(parts) < MIN_PARAGRAPHS, "no_paragraphs"),
        F.when(suspect_phrase(t).isNotNull(), "phrase"), F.when(most_repeated(parts) >= REPEATS, "repeated"),
        F.when((count >= HEADINGS) & (count > F.size(parts) - count), "headings"), F.when(empty >= EMPTY_SECTIONS, "empty_sections"),
    ]
    if source_html is not None:
        links = F.size(F.split(F.lower(F.coalesce(source_html, F.lit(""))), "<a ")) - 1
        checks.append(F.when((F.coalesce(source_html, F.lit("")) != "") & (links > words), "links"))
    if comparison is not None:
        other = word_count(F.coalesce(comparison, F.lit("")))
        checks.append(F.when((F.coalesce(comparison, F.lit("")) != "") & (other > words * TIMES_LONGER), "comparison"))
    return F.array_compact(F.array(*checks))


def is_block_page(text: str | Column) -> Column:
    """A short text with a suspect phrase: an error or login page rather than content."""
    return suspect_phrase(text).isNotNull() & (word_count(text) < MIN_WORDS)


def recognised_reasons(text: str | Column, confidence: Column | None = None, threshold: float = CONFIDENCE) -> Column:
    """Codes of what is wrong with a recognised (OCR) text: empty, odd_characters, few_vowels, confidence."""
    t = F.coalesce(col(text), F.lit(""))
    solid = F.regexp_replace(t, "(?U)\\s", "")
    escaped = "".join("\\" + c if c in "[]{}()-^\\&" else c for c in TEXT_MARKS if not c.isspace())
    odd = F.length(F.regexp_replace(solid, f"[\\p{{L}}\\p{{N}}{escaped}]", ""))
    share = F.when(F.length(solid) == 0, 1.0).otherwise(odd / F.length(solid))
    lettered = F.filter(word_list(t), lambda w: w.rlike("\\p{L}"))
    voiced = F.size(F.filter(lettered, lambda w: F.lower(w).rlike("[aeiouyąęó]")))
    reasons = F.array_compact(F.array(F.when(share > ODD_SHARE, "odd_characters"), F.when((F.size(lettered) >= VOWEL_WORDS) & (voiced / F.nullif(F.size(lettered), F.lit(0)) < VOWEL_SHARE), "few_vowels")))
    if confidence is not None:
        reasons = F.when((F.size(reasons) == 0) & (confidence < threshold), F.array(F.lit("confidence"))).otherwise(reasons)
    return F.when(F.size(word_list(t)) == 0, F.array(F.lit("empty"))).otherwise(reasons)


def speech_share(speech_s: Column, length_s: Column) -> Column:
    return F.when(length_s > 0, F.least(speech_s / length_s, F.lit(1.0))).otherwise(0.0)


def is_speech(speech_s: Column, length_s: Column, threshold: float = 0.5) -> Column:
    """Whether a recording has enough speech; a threshold of 0 never rejects."""
    return F.lit(threshold <= 0) | (speech_share(speech_s, length_s) >= threshold)


def worth_markdown(blocks: str | Column, confidence: str | Column) -> Column:
    """Two of headings, lists, a regular table and code, of a structure that is at least fairly sure.

    ``blocks`` is an array of structs ``kind, level, content``; cells of tables
    are parted by tabs, rows and list items by line feeds.
    """
    b = col(blocks)
    of = lambda kind: F.filter(b, lambda x: x["kind"] == kind)
    heads = of("heading")
    levels = F.size(F.array_distinct(F.transform(heads, lambda x: x["level"])))
    items = lambda x: F.size(F.filter(F.split(x["content"], "\n"), lambda i: F.trim(i) != ""))
    cells = lambda x: F.array_distinct(F.transform(F.split(x["content"], "\n"), lambda r: F.size(F.split(r, "\t"))))
    signs = [(F.size(heads) >= 3) & (levels >= 2), (F.size(of("list")) >= 2) & F.exists(of("list"), lambda x: items(x) >= 3), F.exists(of("table"), lambda x: F.size(cells(x)) == 1), F.size(of("code")) > 0]
    total = sum((s.cast("int") for s in signs[1:]), signs[0].cast("int"))
    return (total >= 2) & col(confidence).isin("high", "medium")


#: Document formats whose prose has titles and paragraphs.
SCORED_FORMATS = "pdf docx epub html htm xhtml odt rtf doc mhtml mht".split()


def is_scored(kind: str | Column, form: str | Column) -> Column:
    """Whether the quality of a source's extraction is scored: pages and videos always, documents if their format is one of prose."""
    kind, form = (F.col(c) if isinstance(c, str) else c for c in (kind, form))
    return kind.isin("web", "youtube") | (kind == "document") & F.coalesce(F.lower(form).isin(SCORED_FORMATS), F.lit(False))
