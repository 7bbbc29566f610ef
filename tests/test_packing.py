from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.operators import packing as P


def test_split_levels():
    assert P.split_text("a b", 2, 100) == (["a b"], [])
    assert P.split_text("a b\n\nc d\n\ne", 4, 100) == (["a b\n\nc d", "e"], [])
    assert P.split_text("one two.\nthree four. five", 2, 100) == (["one two.", "three four.", "five"], [])
    assert P.split_text("one two three", 2, 100) == (["one two", "three"], [P.CUT_IN_SENTENCE])
    assert P.split_text("x" * 10, 5, 4) == (["x" * 10], [P.TOKEN_OVER_LIMIT])
    assert P.split_text("żżż żżż", 5, 6)[0] == ["żżż", "żżż"]
    # the last piece of an oversized unit seeds the next part
    assert P.split_text("a b c\n\nd", 2, 100)[0] == ["a b", "c\n\nd"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=120), st.integers(1, 6), st.integers(4, 40))
def test_split_keeps_words(text, words, size):
    parts, warnings = P.split_text(text, words, size)
    assert " ".join(parts).split() == text.split()
    if P.TOKEN_OVER_LIMIT not in warnings:
        assert all(len(p.split()) <= words and len(p.encode()) <= size for p in parts)


def test_plan_and_slots(spark):
    docs = [(1, "g", "a b c"), (2, "g", "d e"), (3, "g", "w " * 30), (4, None, "solo"), (5, " ", None), (6, "g", "f g h i"), (7, "h", "x")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    plan = P.plan(df, 6, 1000).collect()
    files = {}
    for r in plan:
        files.setdefault(r["file_id"], []).append(r["doc_id"])
    assert sorted(files["group-g-1"]) == [1, 2] and files["group-g-2"] == [6] and files["group-h-1"] == [7]
    assert files["single-4-1"] == [4] and files["single-5-1"] == [5]
    assert sorted(f for f in files if f.startswith("single-3")) == [f"single-3-{i}" for i in range(1, 6)]
    exact = spark.createDataFrame([(i, "s", 8, 8) for i in range(4)], "doc_id long, source string, n_words long, n_bytes long")
    assert [r["bin"] for r in P.next_fit(exact, "source", ["doc_id"], 20, 18).orderBy("doc_id").collect()] == [1, 1, 2, 2]
    assert [r["bin"] for r in P.next_fit(exact, "source", ["doc_id"], 20, 17).orderBy("doc_id").collect()] == [1, 2, 3, 4]
    admitted = {r["doc_id"]: r["admitted"] for r in P.admit(df, 2).collect()}
    assert admitted == {1: True, 2: True, 3: True, 4: True, 5: False, 6: True, 7: False}
    parts = spark.createDataFrame([(i, n) for i, n in enumerate([3, 9, 2, 4, 1, 1])], "file_no long, part_count long")
    assert [r["fits"] for r in P.within_remaining(parts, 7).orderBy("file_no").collect()] == [True, False, True, False, True, True]


def test_small_operators(spark):
    files = spark.createDataFrame([("a.txt", "txt"), ("a.md", "md"), ("b.pdf", "pdf"), ("a.pdf", "pdf")], "path string, format string")
    assert P.used_slots(files).first()[0] == 3
    sources = spark.createDataFrame([("1", "g", "packed"), ("2", "g", "normalised"), ("3", "h", "packed"), ("4", None, "normalised")], "source_id string, group string, status string")
    assert {r["source_id"] for r in P.groups_to_repack(sources).collect()} == {"1", "2"}
    images = spark.createDataFrame([("x", "Images 4"), ("y", None), ("z", " ")], "name string, group string")
    assert {r["name"]: r["group"] for r in P.default_image_group(images).collect()} == {"x": "Images 4", "y": "Images 5", "z": "Images 5"}
    scans = spark.createDataFrame([("s10", "g", 5, 5), ("s2", "g", 5, 5), ("s1", "g", 5, 5)], "name string, group string, n_words long, n_bytes long")
    assert {r["name"]: r["bin"] for r in P.plan_in_order(scans, "group", "name", 10, 100).collect()} == {"s1": 1, "s2": 1, "s10": 2}


def test_routes_of_kinds(spark):
    rows = [(1, "g", "a b", "document", None), (2, "g", "c", "music", None), (3, "g", "d", "music", None), (4, None, "e f", "image", 50), (5, " ", "g", "image", 60), (6, "p", "", "image", 500), (7, "p", "x", "image", 10), (8, "g", "y z", "document", None)]
    sources = spark.createDataFrame(rows, "doc_id long, source string, text string, kind string, image_bytes long")
    files = {r["doc_id"]: (r["file_id"], r["route"]) for r in P.plan_kinds(sources, 6, 100).collect()}
    assert files == {
        1: ("group-g-1", "texts"), 8: ("group-g-1", "texts"), 2: ("single-2-1", "music"), 3: ("single-3-1", "music"),
        4: ("images-Images 1-1", "images"), 5: ("images-Images 1-2", "images"), 6: ("images-p-1", "images"), 7: ("images-p-2", "images"),
    }
    admitted = {r["doc_id"]: r["admitted"] for r in P.admit(sources.withColumn("status", F.when(F.col("doc_id") == 1, "error").otherwise("pending")), 3).collect()}
    assert admitted == {1: None, 2: True, 3: True, 4: True, 5: False, 6: False, 7: False, 8: False}


def test_split_orders_units_and_notes():
    assert P.split_text("a b c d. e f\n\ng h i j k\nl m", 3, 100) == (["a b c", "d. e f", "g h i", "j k\nl"[:3], "l m"], [P.CUT_IN_SENTENCE])
    assert P.split_text("a\n\n" + "x" * 9 + "\n\nb c", 2, 5) == (["a", "x" * 9, "b c"], [P.TOKEN_OVER_LIMIT])
    assert P.split_text("   " * 5, 1, 4) == (["   " * 5], [P.TOKEN_OVER_LIMIT])
