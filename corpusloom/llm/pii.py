"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

Four base kinds (email, ip, card, phone) are defined by their pattern and check
alone and always stay.  The others start with a score that says how much their
form tells; a checksum that fits and a word of the subject within ``NEAR``
characters raise it, and spans of ``LEAST`` and over are added unless a base
span or a better one covers part of them.

Patterns never try a run of characters twice, so time is linear in the text,
whatever it holds.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters before and after a span in which its subject's words count, and the least score of an added span.
NEAR, LEAST = 40, 0.5


def luhn(digits: str) -> bool:
    """The check digit of cards: every second digit from the right counts twice."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(letters: str) -> bool:
    """The check of account numbers: the first four characters moved to the end, letters as 10 to 35, remainder 1."""
    own = letters.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _ip(text: str) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in text.split("."))


def _card(text: str) -> bool:
    return len(text) <= 37 and 12 <= len(own := digits_of(text)) <= 19 and luhn(own)


def _phone(text: str) -> bool:
    return 9 <= len(digits_of(text)) <= 15


def _ssn(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _dni(text: str) -> bool:
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(text[:8]) % 23] == text[8]


def _nir(text: str) -> bool:
    own = digits_of(text)
    return 1 <= int(own[3:5]) <= 12 and 97 - int(own[:13]) % 97 == int(own[13:])


def _steuer(text: str) -> bool:
    """A German tax number: check digit by the rule of remainders of 11 and 10, one digit of the first ten repeated."""
    own, product = digits_of(text), 10
    for d in own[:10]:
        product = (int(d) + product) % 10 or 10
        product = product * 2 % 11
    return own[0] != "0" and 8 <= len(set(own[:10])) <= 9 and (11 - product) % 10 == int(own[10])


def _day(text: str) -> bool:
    parts = [int(p) for p in re.split("[./-]", text)]
    year, rest = (parts[0], parts[1:]) if parts[0] > 31 else (parts[2], parts[:2])
    return 1900 <= year <= 2029 and all(1 <= n <= 31 for n in rest) and min(rest) <= 12


@dataclass(frozen=True)
class Kind:
    """A kind of personal data; ``confirmed`` is what a fitting check adds to ``score``, ``words`` what a word nearby does."""

    name: str
    pattern: str
    valid: Callable[[str], bool]
    score: float
    confirmed: float = 0.0
    words: str = ""
    context: float = 0.3
    needs: str = ""


#: In the order of the listing; the patterns of card, ip and phone are as given, with what cannot match otherwise left untried.
BASE = (
    Kind("email", "", lambda text: True, 0.9, 0.0, "mail|email|contact|kontakt|correo|courriel", needs="@"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", _ip, 0.6, 0.0, "ip|address|host|server|login"),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", _card, 0.4, 0.4, "card|visa|mastercard|credit|debit|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", _phone, 0.6, 0.0, "phone|tel|call|mobile|fax|telefon|handy|móvil|téléphone", needs="+"),
)

ADDED = (
    Kind("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b", mod97, 0.1, 0.6, "iban|account|bank|konto|cuenta|compte"),
    Kind("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", _ssn, 0.2, 0.1, "ssn|social security"),
    Kind("dni", r"\b[0-9]{8}[A-Z]\b", _dni, 0.1, 0.3, "dni|nif|identidad|documento"),
    Kind("nir", r"\b[12] ?[0-9]{2} ?[01][0-9] ?[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}\b", _nir, 0.1, 0.3, "nir|insee|sécurité sociale|numéro de sécu"),
    Kind("steuer", r"\b[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{3}\b", _steuer, 0.1, 0.2, "steuer|identifikationsnummer|idnr"),
    Kind("localphone", r"(?:\(0?[0-9]{2,4}\)|\b0?[0-9]{2,4})[ ./-][0-9]{3,4}[ ./-][0-9]{3,4}\b", lambda text: 9 <= len(digits_of(text)) <= 12, 0.2, 0.0, "phone|tel|call|mobile|fax|telefon|handy|móvil|téléphone"),
    Kind("birthday", r"\b(?:[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})\b", _day, 0.2, 0.0, "born|birth|dob|geboren|geburt|nacid[oa]|nacimiento|née?|naissance"),
)

#: Lengths of account numbers by country (fixed values of their registry); of others the whole run counts.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28,
    "IE": 22, "IT": 27, "LT": 20, "LU": 20, "LV": 21, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}

_PATTERNS = {k.name: re.compile(k.pattern, re.ASCII) for k in BASE + ADDED if k.pattern}
_WORDS = {k.name: re.compile(rf"(?<!\w)(?:{k.words})(?!\w)", re.IGNORECASE) for k in BASE + ADDED}
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGIT = re.compile("[0-9]")
_ORDER = {k.name: i for i, k in enumerate(BASE + ADDED)}


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address pattern, found from their at sign, so that long runs without one cost nothing."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        low = domain.end() if domain else at + 1
        at = text.find("@", low)


def _proposed(kind: Kind, text: str) -> Iterator[tuple[int, int]]:
    if kind.name == "email":
        yield from emails(text)
        return
    for m in _PATTERNS[kind.name].finditer(text):
        end = m.end()
        if kind.name == "iban":
            size = IBAN_LENGTHS.get(m[0][:2])
            places = [i for i, c in enumerate(m[0]) if c != " "]
            if size and size < len(places):
                end = m.start() + places[size - 1] + 1
        yield m.start(), end


def _near(kind: Kind, text: str, start: int, end: int) -> bool:
    words = _WORDS[kind.name]
    return bool(words.search(text[max(0, start - NEAR) : start]) or words.search(text[end : end + NEAR]))


def spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """``kind, start, end, score`` of the personal data in a text, by start, then kind as listed; code points, end exclusive."""
    text = text or ""
    digits = _DIGIT.search(text) is not None
    found = []
    for kind in BASE:
        if (digits or kind.name == "email") and kind.needs in text:
            for a, b in _proposed(kind, text):
                if kind.valid(text[a:b]):
                    found.append((kind.name, a, b, min(1.0, kind.score + kind.confirmed + kind.context * _near(kind, text, a, b))))
    taken: list[tuple[int, int]] = []  # disjoint, ascending
    for a, b in sorted((a, b) for _, a, b, _ in found):
        if taken and a < taken[-1][1]:
            taken[-1] = taken[-1][0], max(b, taken[-1][1])
        else:
            taken.append((a, b))
    more = []
    for kind in ADDED if digits else ():
        for a, b in _proposed(kind, text):
            if kind.valid(text[a:b]):
                score = kind.score + kind.confirmed + kind.context * _near(kind, text, a, b)
                if score >= LEAST:
                    more.append((kind.name, a, b, min(1.0, score)))
    for span in sorted(more, key=lambda s: (-s[3], s[1], _ORDER[s[0]])):
        at = bisect_left(taken, (span[2], 0))
        if not at or taken[at - 1][1] <= span[1]:
            taken.insert(at, span[1:3])
            found.append(span)
    return sorted(found, key=lambda s: (s[1], _ORDER[s[0]], s[2]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("value", pa.string())]))


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, found``: the spans of each row of ``docs``, as an array of (kind, start, end, score, value).

    Whole texts are read; null counts as empty.  Rows with equal or null ids
    have rows of their own.  Other columns are not read; an empty table gives an
    empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch["text"]:
                text = value.as_py() or ""
                rows.append([(kind, a, b, round(score, 4), text[a:b]) for kind, a, b, score in spans(text)])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(rows, _SPANS)], ["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, found array<struct<kind:string,start:int,end:int,score:double,value:string>>")


def _is(*names: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"].isin(*names)


def counted(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``: the digest of ``find``."""
    names = [k.name for k in BASE]

    def line(found):
        return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("found", _is(*names))
    counts = [F.size(F.filter("found", _is(name))).cast("long").alias(f"n_{name}") for name in names]
    return find(docs).select("doc_id", *counts, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("found")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of personal data in ``text`` replaced by its kind in brackets; null texts stay null.

    All other columns stay.  Where spans lie over each other, the first one is
    replaced, up to the end of the last.
    """

    def masked(text: str | None) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for kind, a, b, _ in spans(text):
            if a >= at:
                out += [text[at:a], f"[{kind}]"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array([masked(t.as_py()) for t in batch["text"]], pa.string()))

    return docs.mapInArrow(run, docs.schema)
