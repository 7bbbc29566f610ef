import pytest
from pyspark.sql import functions as F

from corpusloom.functions import urls as U
from corpusloom.operators import url_lists as L


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make("v").alias("r")).first()["r"]


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTP://User:pw@Example.COM:80/a b?utm_source=x&b=2&a=1#top", "http://example.com/a%20b?a=1&b=2"), ("www.example.com", "https://www.example.com/"),
        ("https://example.com:8443/?q=&fbclid=1", "https://example.com:8443/?q="), ("https://example.com/x#!/p/1", "https://example.com/x#!/p/1"), ("https://e.com/?q=a+b%20c", "https://e.com/?q=a+b+c"),
        ("https://e.com/ż", "https://e.com/%C5%BC"), ("https://e.com:443/%41", "https://e.com/%41"), ("ftp://e.com", None), ("http://localhost/x", "http://localhost/x"), ("http://host/x", None), ("", None), (None, None),
    ],
)
def test_canonical(spark, url, want):
    assert one(spark, url, U.canonical) == want


def test_verdict_and_forms(spark):
    assert [one(spark, u, U.verdict) for u in ("  ", "plain words", "http:///x", "http://short", "https://ok.org")] == ["empty", "scheme", "host", "short_host", None]
    assert one(spark, "http://u:p@e.com/?b=1&a=2&utm_x=1", U.fetch_form) == "http://u:p@e.com/?b=1&a=2"
    assert one(spark, "http://u:p@e.com/x", U.without_login) == "http://e.com/x"


@pytest.mark.parametrize(
    "url, kind, ident",
    [
        ("https://www.youtube.com/watch?v=abcdefghijk&list=PL1", "video", "abcdefghijk"), ("https://youtu.be/abcdefghijk", "video", "abcdefghijk"), ("https://youtube.com/shorts/abcdefghijk", "video", "abcdefghijk"),
        ("https://youtube.com/playlist?list=PL", "playlist", None), ("https://youtube.com/@name/shorts", "channel", None), ("https://youtube.com/c/x", "channel", None), ("https://youtube.com/watch?v=short", "unknown", None),
        ("https://example.com/watch?v=abcdefghijk", None, None),
    ],
)
def test_video(spark, url, kind, ident):
    assert tuple(one(spark, url, U.video)) == (kind, ident)


def test_lists(spark):
    text = "# list\nhttps://a.example.com/x https://a.example.com/x?utm_source=n\n\nhttps://b.example.com\nhttps://b.example.com/#top\nthis is prose\nwww.c.example.com\nhttps://d.example.com/\nword"
    rows = L.collect(spark.createDataFrame([(1, text), (2, "https://e.org"), (3, None)], "doc_id long, text string"))
    counts = {(r["doc_id"], r["verdict"]): r["count"] for r in rows.groupBy("doc_id", "verdict").count().collect()}
    assert counts == {(1, "accepted"): 4, (1, "duplicate"): 2, (1, "rejected"): 2, (2, "accepted"): 1}
    only = {r["doc_id"]: r["only_addresses"] for r in L.only_addresses(spark.createDataFrame([(1, text), (2, "https://e.org"), (3, None)], "doc_id long, text string")).collect()}
    assert only == {1: False, 2: True, 3: False}


def test_addresses_in_texts(spark):
    md = "See (https://a.example.com/x). [b](https://hidden.example.com) https://a.example.com/x?utm_id=1\n[c]: https://ref.example.com"
    files = spark.createDataFrame([(1, md)], "doc_id long, text string")
    assert {r["url"] for r in L.found_addresses(files, markdown=True).collect()} == {"https://a.example.com/x"}
    many = spark.createDataFrame([(1, " ".join(f"https://h{i}.example.com" for i in range(5)))], "doc_id long, text string")
    assert all(r["over_limit"] and r["found"] == 5 for r in L.found_addresses(many, limit=4).collect())
    inputs = spark.createDataFrame([("https://a.example.com/x",)], "canonical string")
    merged = L.merge_found(inputs, L.found_addresses(files.withColumn("text", F.lit("https://a.example.com/x https://n.example.com"))))
    assert {(r["canonical"], r["explicit"]) for r in merged.collect()} == {("https://a.example.com/x", True), ("https://n.example.com/", False)}


def test_tracks(spark):
    rows = [("v1", "de", False, True), ("v1", "en", True, True), ("v1", "pl", True, True), ("v2", "fr", True, False), ("v3", "en", False, True), ("v3", "pl", True, True)]
    got = {r["video_id"]: (r["lang"], r["step"]) for r in L.choose_track(spark.createDataFrame(rows, "video_id string, lang string, generated boolean, translatable boolean"), ["pl", "en"]).collect()}
    assert got == {"v1": ("pl", 2), "v2": ("fr", 4), "v3": ("en", 1)}
