"""Column functions on texts: normal form, counts, keys, ids and names."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What normalisation deletes (invisible and control characters), and what it takes for a space.
_DELETED = re.compile("[\u200B\u2060\uFEFF\u00AD\x00-\x08\x0e-\x1f\x7f]")
_SPACES = re.compile("[\t\x0b\x0c\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]")
#: White space as Unicode knows it, and as SQL's patterns do.
SPACE, PLAIN_SPACE = "(?U)\\s", "[\\t\\n\\f\\r ]"
#: What SQL trims: the space and Unicode's other space separators.
SEPARATORS = " \u00A0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202F\u205F\u3000"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normal(text: str, nfc: bool = True) -> str:
    """One text in canonical form; no step takes more than linear time."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = unicodedata.normalize("NFC", text) if nfc else text
    text = _SPACES.sub(" ", _DELETED.sub("", text))
    if "  " in text:  # spaces after a line's first character
        text = re.sub(" (?<=[^ \n] ) +", " ", text)
    if " \n" in text:
        text = "\n".join([line.rstrip(" ") for line in text.split("\n")])
    if "\n\n\n" in text:
        text = re.sub("\n{3,}", "\n\n", text)
    return text.strip(" \n")


@cache
def _apart() -> np.ndarray:
    """Whether each code point is punctuation, a symbol or white space; the last entry is for all beyond."""
    points = map(chr, range(0x20000))
    return np.array([unicodedata.category(c)[0] in "PS" or c == " " or _SPACES.match(c) is not None or c in "\n\r" for c in points] + [False])


#: Bytes of ASCII with punctuation and symbols as spaces.
_ASCII = bytes(32 if i < 128 and unicodedata.category(chr(i))[0] in "PS" else i for i in range(256))


def cosmetic(text: str) -> str:
    """One text's cosmetic form."""
    if text.isascii():  # where bytes split at the same white space
        return b" ".join(text.encode().lower().translate(_ASCII).split()).decode()
    folded = unicodedata.normalize("NFC", text.casefold())
    points = np.frombuffer(folded.encode("utf-32-le"), np.uint32)
    apart = _apart().take(points, mode="clip")
    stays = ~apart
    stays[1:] |= ~apart[:-1]
    return np.where(apart, np.uint32(32), points)[stays].tobytes().decode("utf-32-le").strip(" ")


def _each(function: Callable[[str], str]) -> Callable[[Column], Column]:
    """``function`` of each text, which Python sees in Arrow batches, one at a time; null stays null."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array((None if t is None else function(t) for t in (t.as_py() for t in texts)), pa.string(), size=len(texts))

    return F.arrow_udf(run, StringType())


def normalize(text: str | Column, nfc: bool = True) -> Column:
    """Canonical text: LF, NFC, no invisible or control characters, single spaces inside lines, at most one blank line.

    Indentation keeps its width.  Normalising twice changes nothing.  Null stays null.
    """
    return _each(lambda t: normal(t, nfc))(col(text))


def trimmed(text: str | Column) -> Column:
    """Without space separators at either end; tabs and line ends stay."""
    return F.trim(col(text), F.lit(SEPARATORS))


def word_list(text: str | Column, space: str = SPACE) -> Column:
    """Maximal runs without white space."""
    return F.filter(F.split(col(text), f"{space}+"), lambda w: w != "")


def word_count(text: str | Column, space: str = SPACE) -> Column:
    return F.size(word_list(text, space)).cast("long")


def char_count(text: str | Column) -> Column:
    return F.length(col(text)).cast("long")


def byte_count(text: str | Column) -> Column:
    return F.octet_length(col(text)).cast("long")


def content_hash(text: str | Column) -> Column:
    return F.sha2(col(text), 256)


def cosmetic_form(text: str | Column) -> Column:
    """Case-folded text with punctuation, symbols and white space as single spaces; diacritics stay."""
    return _each(cosmetic)(col(text))


def cosmetic_key(text: str | Column) -> Column:
    """SHA-256 of the cosmetic form."""
    return _each(lambda t: hashlib.sha256(cosmetic(t).encode()).hexdigest())(col(text))


def source_id(kind: str | Column, content: str | Column) -> Column:
    """``kind-`` and 16 hexadecimal digits of the content's SHA-256; a byte-order mark does not count."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(kind, F.lit("-"), F.substring(F.sha2(F.regexp_replace(col(content), "^\\uFEFF", ""), 256), 1, 16))


def input_id(kind: str | Column, value: str | Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(F.lit("in-"), F.substring(F.sha2(F.concat(kind, F.lit("|"), col(value)), 256), 1, 12))


#: Names that a file system reserves.
RESERVED = ["CON", "PRN", "AUX", "NUL", *(f"{d}{i}" for d in ("COM", "LPT") for i in range(1, 10))]


def safe_name(name: str | Column, fallback: str | Column) -> Column:
    """A file name without forbidden characters, 100 long at most; ``fallback`` if nothing is left or it is reserved."""
    t = F.regexp_replace(col(name), '[<>:"/\\\\|?*\\x00-\\x1f]', "_")
    t = F.regexp_replace(F.trim(F.regexp_replace(t, "_{2,}", "_")), "[. ]+$", "")
    t = F.regexp_replace(F.trim(F.substring(t, 1, 100)), "[. ]+$", "")
    return F.when((t == "") | t.isNull() | F.upper(t).isin(RESERVED), col(fallback) if isinstance(fallback, Column) else F.lit(fallback)).otherwise(t)


def title_stem(title: str | Column, most: int = 60) -> Column:
    """Lower-case words joined by underscores, cut at a word's end; a first word that is too long is cut itself."""
    words = F.regexp_extract_all(F.lower(F.coalesce(col(title), F.lit(""))), F.lit("(?U)\\w+"), F.lit(0))
    start = F.struct(F.lit("").alias("stem"), F.lit(True).alias("open"))

    def add(state: Column, word: Column) -> Column:
        longer = F.when(state["stem"] == "", word).otherwise(F.concat(state["stem"], F.lit("_"), word))
        fits = state["open"] & (F.length(longer) <= most)
        return F.struct(F.when(fits, longer).otherwise(state["stem"]).alias("stem"), fits.alias("open"))

    stem = F.aggregate(words, start, add, lambda s: s["stem"])
    stem = F.when((stem == "") & (F.size(words) > 0), F.substring(F.get(words, F.lit(0)), 1, most)).otherwise(stem)
    return F.trim(F.regexp_replace(stem, "_{2,}", "_"), F.lit("_"))


def _tidy(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, "_{2,}", "_"), F.lit("_"))


def output_name(title: str | Column, ident: str | Column) -> Column:
    """Title stem (or the id's kind) and the first 8 characters of the id's hash."""
    ident = col(ident)
    kind = F.regexp_extract(ident, "^(.*)-[^-]*$", 1)
    digest = F.substring(F.trim(F.regexp_extract(ident, "([^-]*)$", 1)), 1, 8)
    stem = safe_name(title_stem(title), F.when(F.trim(kind) == "", "source").otherwise(F.trim(kind)))
    return _tidy(F.concat(stem, F.lit("_"), digest))


def part_name(base: str | Column, number: str | Column, count: str | Column) -> Column:
    number, count = col(number).cast("string"), col(count).cast("string")
    return F.concat(col(base), F.lit("_part_"), F.lpad(number, F.length(count), F.lit("0")), F.lit("_of_"), count)


def group_name(name: str | Column, ids: str | Column) -> Column:
    """Group stem and 8 digits of the hash of its members' sorted ids."""
    digest = F.substring(F.sha2(F.array_join(F.array_sort(col(ids)), "\n"), 256), 1, 8)
    return _tidy(F.concat(safe_name(title_stem(name), "group"), F.lit("_"), digest))


def natural_key(name: str | Column) -> Column:
    """A string in whose order numbers inside names count as numbers."""
    pieces = F.regexp_extract_all(F.lower(col(name)), F.lit("\\d+|\\D+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^\\d"), F.concat(F.lit("0"), F.lpad(F.regexp_replace(p, "^0+(?=\\d)", ""), 24, "0"))).otherwise(F.concat(F.lit("1"), p))), "\x01")


def project_name(base: str | Column) -> Column:
    """The first eight words of a text as a name."""
    words = F.slice(F.regexp_extract_all(F.lower(col(base)), F.lit("(?U)\\w+"), F.lit(0)), 1, 8)
    return safe_name(F.array_join(words, "_"), "project")


def _plural(n: Column, one: str, few: str, many: str) -> Column:
    last, two = n % 10, n % 100
    return F.when(n == 1, one).when(last.between(2, 4) & ~two.between(12, 14), few).otherwise(many)


#: Forms of hour, minute and second for one, few and many (Polish).
HOURS, MINUTES, SECONDS = ("godzina", "godziny", "godzin"), ("minuta", "minuty", "minut"), ("sekunda", "sekundy", "sekund")


def duration_words(seconds: str | Column) -> Column:
    """A duration in words; negative ones give an empty string."""
    s = col(seconds).cast("long")
    hours, minutes, rest = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    part = lambda n, forms: F.concat(n.cast("string"), F.lit(" "), _plural(n, *forms))
    text = F.concat_ws(" ", F.when(hours > 0, part(hours, HOURS)), F.when(minutes > 0, part(minutes, MINUTES)), F.when((rest > 0) | ((hours == 0) & (minutes == 0)), part(rest, SECONDS)))
    return F.when(s < 0, "").otherwise(text)


def timecode(seconds: str | Column, with_hours: str | Column) -> Column:
    """``[mm:ss]`` or ``[h:mm:ss]``."""
    s = F.floor(col(seconds)).cast("long")
    two = lambda n: F.lpad(n.cast("string"), F.greatest(F.length(n.cast("string")), F.lit(2)), F.lit("0"))
    hours, minutes, rest = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    long = F.concat(F.lit("["), hours.cast("string"), F.lit(":"), two(minutes), F.lit(":"), two(rest), F.lit("]"))
    return F.when(col(with_hours), long).otherwise(F.concat(F.lit("["), two(minutes + hours * 60), F.lit(":"), two(rest), F.lit("]")))


def subtitle_seconds(mark: str | Column) -> Column:
    """Seconds of ``[h:]mm:ss[.,]ms``; null for anything else."""
    pattern = "^(?:(\\d+):)?(\\d{1,2}):(\\d{2})[.,](\\d{1,3})$"
    at = lambda i: F.try_to_number(F.nullif(F.regexp_extract(F.trim(col(mark)), pattern, i), F.lit("")), F.lit("99999999")).cast("double")
    millis = F.rpad(F.regexp_extract(F.trim(col(mark)), pattern, 4), 3, "0").try_cast("double")
    return F.when(F.trim(col(mark)).rlike(pattern), F.coalesce(at(1), F.lit(0.0)) * 3600 + at(2) * 60 + at(3) + millis / 1000)


def parse_date(value: str | Column) -> Column:
    """A date from ISO, compact or not, with or without a time, or from four forms in the first ten characters.

    Days and months may have one digit, years have four.
    """
    whole = F.trim(col(value))
    head = F.substring(whole, 1, 10)
    compact = F.when(whole.rlike(r"^\d{8}(?:[T ]\d{2}(?::?\d{2}){0,2}(?:[.,]\d+)?(?:Z|[+-]\d{2}(?::?\d{2})?)?)?$"), F.try_to_date(F.substring(whole, 1, 8), "yyyyMMdd"))
    forms = (("-", "yyyy-M-d"), ("/", "yyyy/M/d"))
    ahead = [F.when(head.rlike(rf"^\d{{4}}{mark}\d{{1,2}}{mark}\d{{1,2}}$"), F.try_to_date(head, f)) for mark, f in forms]
    behind = [F.when(head.rlike(rf"^\d{{1,2}}[{mark}]\d{{1,2}}[{mark}]\d{{4}}$"), F.try_to_date(head, f)) for mark, f in ((".", "d.M.yyyy"), ("/", "d/M/yyyy"))]
    return F.coalesce(compact, *ahead, *behind)


def one_line(text: str | Column) -> Column:
    return F.trim(F.regexp_replace(col(text), "(?U)\\s+", " "))


def shorten(text: str | Column, most: int) -> Column:
    """The text, or its first characters and an ellipsis."""
    t = col(text)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…")))


def first_line_title(text: str | Column, most: int = 80) -> Column:
    """The first line that is not blank, trimmed and cut; null if there is none.  Only line feeds end lines."""
    return F.nullif(F.substring(trimmed(F.regexp_extract(col(text), "(?md)^.*[^\\t\\n\\f\\r ].*$", 0)), 1, most), F.lit(""))


#: How a table's cells write booleans.
TRUE, FALSE = "prawda", "fałsz"


def cell_text(value: str | Column, kind: str, number_format: str | Column | None = None) -> Column:
    """A table cell as text: words for booleans, ISO dates, numbers of 15 significant digits at most.

    Where ``number_format`` (of a spreadsheet's cell) has a percent sign, the number
    is written as per cent.
    """
    v = col(value)
    if kind == "boolean":
        return F.when(v, TRUE).otherwise(F.when(~v, FALSE))
    if kind in ("date", "timestamp"):
        return F.regexp_replace(F.date_format(v, "yyyy-MM-dd HH:mm:ss"), " 00:00:00$", "")
    if kind == "double":
        if number_format is None:
            return _number(v)
        return F.when(F.coalesce(F.contains(col(number_format), F.lit("%")), F.lit(False)), F.concat(_number(v * 100), F.lit("%"))).otherwise(_number(v))
    return v.cast("string")


def _number(v: Column) -> Column:
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    return F.when(whole, F.floor(v).cast("string")).when(v.isNotNull(), F.regexp_replace(F.format_string("%.15g", v), "(\\.\\d*?)0+$", "$1"))


_INLINE_SYNTAX = (
    r"(?U)\\(?=$|\n|[!-/:-@\[-`{-~])|[*`]|(?<![\p{L}\p{N}])_|_(?![\p{L}\p{N}])|<(?=[A-Za-z/!?])|~(?=~)|\](?=\()|&(?=#[0-9]+;|#[xX][0-9a-fA-F]+;|\w+;)"
)
_LINE_SYNTAX = (
    r"(?md)^([^\S\n]{0,3})(?=#{1,6}(?:\s|$)|[-+](?:\s|$)|>|(?:-[ \t]*){3,}$|(?:=+|-+)[ \t]*$|\||\[[^\]\n]+\]:)|^([^\S\n]{0,3}\d{1,9})(?=[.)](?:\s|$))"
)


def escaped_inline(text: str | Column) -> Column:
    """A line, cell or fragment with what Markdown would take for syntax inside a line escaped."""
    return F.regexp_replace(col(text), _INLINE_SYNTAX, r"\\$0")


def escaped_heading(text: str | Column) -> Column:
    """The same for a heading: hash signs at its end are escaped as well."""
    return F.regexp_replace(escaped_inline(text), r"(\s)(#+)[ \t]*$", r"$1\\$2")


def escaped_markdown(text: str | Column) -> Column:
    """Plain text of any lines as Markdown that reads the same: syntax inside and at the start of lines is escaped."""
    return F.regexp_replace(escaped_inline(text), _LINE_SYNTAX, r"$1$2\\")


def fence_length(code: str | Column) -> Column:
    """How many grave accents fence code: more than stand together in it, three at least."""
    lengths = F.transform(F.regexp_extract_all(col(code), F.lit("`+"), F.lit(0)), lambda run: F.length(run))
    return F.greatest(F.lit(3), F.coalesce(F.array_max(lengths), F.lit(0)) + 1)
