import unicodedata
from random import Random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make("v").alias("r")).first()["r"]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("a\r\nb\rc", "a\nb\nc"), ("x​­y﻿", "xy"), ("a\x07b\x0bc", "ab c"), ("  \ta   b \n\n\n\nc  ", "a b\n\nc"), ("p\n   q  r", "p\n   q r"), ("é", "é"),
        ("a  b c", "a b c"), ("", ""), (None, None), ("\U0001f468‍\U0001f469", "\U0001f468‍\U0001f469"), ("a\u0085b", "a b"),
    ],
)
def test_normalize(spark, raw, want):
    assert one(spark, raw, T.normalize) == want
    assert one(spark, want, T.normalize) == want


def test_normalize_is_idempotent(spark):
    random = Random(4)
    texts = ["".join(random.choices("ab \t\n\r\u00a0\u200b\u00e9\x07", k=random.randrange(30))) for _ in range(300)] + ["\n \n a", " \u200b a\n\n \n\nb"]
    rows = spark.createDataFrame([(t,) for t in texts], "v string").select(T.normalize("v").alias("a")).select("a", T.normalize("a").alias("b"))
    assert rows.where("a <> b").collect() == []


def test_cosmetic_key(spark):
    form = lambda v: one(spark, v, T.cosmetic_form)
    assert form("Biało-Czerwony!") == form("biało czerwony") != form("białoczerwony")
    assert form("Straße") == form("STRASSE") == "strasse"
    assert form("zamek") != form("żamek")
    assert form("ΣΑΣ") == form("σας")
    for word in ("ﬁn", "İx", "é", "ŉa"):
        assert form(word) == unicodedata.normalize("NFC", word.casefold())


def test_counts_and_ids(spark):
    row = spark.createDataFrame([("żółw  je\n",), (None,), ("",)], "v string").select(T.word_count("v").alias("w"), T.char_count("v").alias("c"), T.byte_count("v").alias("b")).collect()
    assert [tuple(r) for r in row] == [(2, 9, 12), (row[1]["w"], None, None), (0, 0, 0)]
    assert one(spark, "﻿abc", lambda v: T.source_id("text", v)) == "text-" + "ba7816bf8f01cfea"


@pytest.mark.parametrize("title, want", [("Baza wiedzy: AI!", "baza_wiedzy_ai"), ("x" * 70, "x" * 60), ("word " * 30, "_".join(["word"] * 12)), (None, ""), ("_a__b_", "a_b")])
def test_title_stem(spark, title, want):
    assert one(spark, title, T.title_stem) == want


def test_names(spark):
    assert one(spark, 'a<b>:c"... ', lambda v: T.safe_name(v, "f")) == "a_b_c_"
    assert one(spark, "con", lambda v: T.safe_name(v, "f")) == "f"
    assert one(spark, "", lambda v: T.safe_name(v, "f")) == "f"
    assert one(spark, "page-0123456789abcdef", lambda v: T.output_name(F.lit("A title"), v)) == "a_title_01234567"
    assert one(spark, "page-0123456789abcdef", lambda v: T.output_name(F.lit(""), v)) == "page_01234567"
    assert one(spark, 3, lambda v: T.part_name(F.lit("n"), v, F.lit(12)), "int") == "n_part_03_of_12"
    names = [r["v"] for r in spark.createDataFrame([("s10",), ("s2",), ("S1b",), ("s1",)], "v string").orderBy(T.natural_key("v")).collect()]
    assert names == ["s1", "S1b", "s2", "s10"]


@pytest.mark.parametrize("s, want", [(0, "0 sekund"), (1, "1 sekunda"), (62, "1 minuta 2 sekundy"), (3600 * 5 + 60 * 12 + 22, "5 godzin 12 minut 22 sekundy"), (-1, "")])
def test_duration(spark, s, want):
    assert one(spark, s, T.duration_words, "int") == want


def test_times_and_dates(spark):
    assert one(spark, 3725.9, lambda v: T.timecode(v, F.lit(True)), "double") == "[1:02:05]"
    assert one(spark, 3725.0, lambda v: T.timecode(v, F.lit(False)), "double") == "[62:05]"
    assert one(spark, "01:02:03,5", T.subtitle_seconds) == 3723.5
    assert one(spark, "02:03.250", T.subtitle_seconds) == 123.25
    assert one(spark, "nonsense", T.subtitle_seconds) is None
    assert str(one(spark, "03.02.2024 10:00", T.parse_date)) == "2024-02-03"
    assert one(spark, "soon", T.parse_date) is None
    for given, want in (("2024-02-03T10:00:00Z", "2024-02-03"), ("20240203", "2024-02-03"), ("20240203T1015", "2024-02-03"), ("2024-2-3", "2024-02-03"), ("3.2.2024", "2024-02-03"), ("3/2/2024", "2024-02-03"), ("2024/12/31 x", "2024-12-31")):
        assert str(one(spark, given, T.parse_date)) == want
    for given in ("03-02-2024", "31.02.2024", "3.2.24", "2024", "202402033"):
        assert one(spark, given, T.parse_date) is None
    assert one(spark, "abcdef", lambda v: T.shorten(v, 4)) == "abc…"
    assert one(spark, "\n  Title here \nrest", T.first_line_title) == "Title here"
    assert one(spark, 0.1 + 0.2, lambda v: T.cell_text(v, "double"), "double") == "0.3"


@given(st.integers(0, 10**6))
def test_plural_forms_are_known(n):
    assert T.SECONDS[0 if n == 1 else 1 if 2 <= n % 10 <= 4 and not 12 <= n % 100 <= 14 else 2] in T.SECONDS
