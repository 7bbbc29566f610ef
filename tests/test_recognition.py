from corpusloom.operators import recognition as R


def test_recognition(spark):
    words = spark.createDataFrame([(1, 1, 1, 1, 2, "world", 80.0), (1, 1, 1, 1, 1, "hello", 90.0), (1, 1, 1, 2, 1, "again", 70.0), (1, 2, 1, 1, 1, "end", 60.0), (1, 2, 1, 1, 2, " ", 95.0), (1, 0, 0, 0, 0, "", -1.0)], "page_id long, block int, par int, line int, word int, text string, conf double")
    assert tuple(R.page_text(words).first()) == (1, "hello world\nagain\n\nend", 75.0, 4)
    tries = spark.createDataFrame([(1, 0, "a", 50.0, 4), (1, 1, "b", 40.0, 5), (1, 2, "c", 90.0, 2)], "page_id long, attempt int, text string, confidence double, n_words int")
    assert R.best_attempt(tries).first()["text"] == "a"
    bars = spark.createDataFrame([("s", i, v) for i, v in enumerate(["x", "x", None, None, "x", "y"])], "source_id string, pos int, value string")
    assert [(r["first"], r["last"], r["value"], r["times"]) for r in R.collapse_runs(bars).orderBy("first").collect()] == [(0, 1, "x", 2), (2, 3, None, 2), (4, 4, "x", 1), (5, 5, "y", 1)]
    pages = [(1, p, i, t) for p in (1, 2, 3) for i, t in enumerate(["Journal", f"body {p}", "more", f"- {p} -"])] + [(2, 1, 0, "Journal"), (2, 1, 1, "7")]
    left = R.without_running_heads(spark.createDataFrame(pages, "doc_id long, page int, line int, text string"))
    assert sorted(tuple(r)[:3] for r in left.collect()) == [(1, 1, 1), (1, 1, 2), (1, 2, 1), (1, 2, 2), (1, 3, 1), (1, 3, 2), (2, 1, 0), (2, 1, 1)]
