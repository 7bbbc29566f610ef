"""Normal form and cosmetic key: one pass of Python over each text, in linear time, by the same rules as before."""

import hashlib
import time
import unicodedata

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.streaming import incremental


def test_long_indentation_takes_linear_time(spark):
    # each space of it began a match of its own before, and each match went back over all of it
    rows = spark.range(1).select(F.concat(F.lit("a\n"), F.repeat(F.lit(" "), 400_000), F.lit("b  c \n"), F.repeat(F.lit(" "), 400_000), F.lit("\nd")).alias("v"))
    began = time.time()
    assert rows.select(F.sha2(T.normalize("v"), 256)).first()[0] == hashlib.sha256(("a\n" + " " * 400_000 + "b c\n\nd").encode()).hexdigest()
    assert time.time() - began < 20


def test_a_batch_is_settled_with_texts_evaluated_once(spark):
    # the folded text stood in several places of the plan before, and each of them evaluated it anew
    docs = spark.createDataFrame([(1, "Żółw!"), (2, "żółw"), (3, None)], "doc_id long, text string")
    plan = docs.select("doc_id", T.cosmetic_key("text").alias("cosmetic_key"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and plan.count("ArrowEvalPython") == 1
    base = docs.where("doc_id = 1").select(T.cosmetic_key("text").alias("cosmetic_key"), F.col("doc_id").alias("main_id"))
    got = incremental.settle_batch(docs.where("doc_id > 1"), base).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["status"], r["main_id"]) for r in got] == [(2, "duplicate", 1), (3, "kept", None)]
    assert got[1]["cosmetic_key"] == hashlib.sha256(b"").hexdigest() and docs.where("doc_id = 3").select(T.cosmetic_key("text")).first()[0] is None


def test_every_character_is_treated_as_the_patterns_did(spark):
    # what Java's and Python's tables both know; classes of Java, as the pattern of the cosmetic form had them
    known = [c for c in map(chr, range(1, 0x30000)) if unicodedata.category(c) not in ("Cn", "Cs", "Co") and len(unicodedata.normalize("NFC", c.casefold())) == 1]
    rows = spark.createDataFrame([(c, f"a{c}{c}.b") for c in known], "c string, v string").where(F.col("c").rlike("\\P{Cn}"))
    wrong = rows.where((T.cosmetic_form("v") == "a b") != F.col("c").rlike("(?U)[\\p{P}\\p{S}\\s]"))
    assert [hex(ord(r["c"])) for r in wrong.collect()] == []
    spaced = rows.where((T.normalize("v", nfc=False) == "a .b") != F.col("c").rlike("(?U)[\\s&&[^\\n\\r]]"))
    assert [hex(ord(r["c"])) for r in spaced.collect()] == []
    assert not any(unicodedata.category(chr(i))[0] in "PSZ" for i in range(0x20000, 0x110000))
