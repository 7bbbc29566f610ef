"""Cache, touched groups, queue order, reports of what was left out, scans; the event log and the flow with kinds."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpusloom.config import Config
from corpusloom.operators import render, report
from corpusloom.plans import corpus
from corpusloom.plans.audit import Log, phases
from corpusloom.sources import files
from corpusloom.streaming import incremental


def test_cache(spark):
    day = lambda n: dt.datetime(2024, 5, n)
    schema = "key string, body string, fetched_at timestamp"
    cache = spark.createDataFrame([("a", "old", day(1)), ("b", "kept", day(20)), ("e", "x", None)], schema)
    new = files.cache_upsert(cache, spark.createDataFrame([("a", "new", day(25)), ("c", "first", day(2))], schema))
    assert sorted((r["key"], r["body"]) for r in new.collect()) == [("a", "new"), ("b", "kept"), ("c", "first"), ("e", "x")]
    fresh = files.cache_fresh(new, F.lit(day(26)), 10)
    assert {r["key"] for r in fresh.collect()} == {"a", "b"}
    edge = files.cache_fresh(new, F.lit(day(30)), 10)  # exactly ten days old is too old
    assert {r["key"] for r in edge.collect()} == {"a"}
    assert files.cache_upsert(cache.limit(0), cache.limit(0)).count() == 0


def test_touched_groups_and_queue(spark):
    sources = spark.createDataFrame([(1, "g"), (2, "h"), (3, None), (4, "g")], "id long, group string")
    batch = spark.createDataFrame([(5, "g"), (6, None), (7, "new")], "id long, group string")
    assert {r["id"] for r in incremental.touched_groups(batch, sources).collect()} == {1, 4}
    asked = spark.createDataFrame([("y", 2), ("x", 5), ("z", 3), ("y", 9), ("x", 1)], "project string, at int")
    assert [(r["project"], r["at"]) for r in incremental.queue_order(asked).collect()] == [("x", 1), ("x", 5), ("y", 2), ("y", 9), ("z", 3)]


def test_what_was_left_out_and_scans(spark):
    rows = spark.createDataFrame([("a", "skipped", "empty"), ("b", "packed", None), ("c", "error", "broken"), ("d", "duplicate", None)], "source_id string, status string, reason string")
    assert {tuple(r) for r in report.not_processed(rows).collect()} == {("a", "skipped", "empty"), ("c", "error", "broken")}
    scans = spark.createDataFrame([("f", 2, "b.png", "text", None), ("f", 1, "a.png", "", "by hand"), ("g", 1, "c.png", None, "")], "file_id string, pos int, name string, text string, notes string")
    got = {r["file_id"]: r["body"] for r in render.scan_sections(scans).collect()}
    assert got == {"f": "Skan: a.png\n\nDopiski:\nby hand\n\nSkan: b.png\n\ntext", "g": "Skan: c.png"}


def test_events_are_counted_by_the_pass_that_writes(spark, tmp_path):
    evaluated = spark.sparkContext.accumulator(0)

    def once(batches):
        for batch in batches:
            evaluated.add(batch.num_rows)
            yield batch

    log = Log(spark, "run-1")
    table = spark.range(100).mapInArrow(once, "id long")
    out = log.written(table, "numbers", even=F.count_if(F.col("id") % 2 == 0), nothing=F.sum(F.lit(None).cast("long")))
    assert evaluated.value == 100 and out.count() == 100 and evaluated.value == 100
    with pytest.raises(Exception):
        log.written(spark.range(3).select(F.raise_error(F.lit("broken on purpose")).cast("long").alias("id")), "failing")
    first, second = log.events().orderBy("nth").collect()
    assert (first["phase"], first["n_rows"], first["counts"], first["error"]) == ("numbers", 100, {"even": 50, "nothing": 0}, None) and first["seconds"] > 0
    assert second["phase"] == "failing" and second["n_rows"] is None and "broken on purpose" in second["error"]
    log.append(str(tmp_path / "log"))
    Log(spark, "run-2").append(str(tmp_path / "log"))
    told = {r["phase"]: (r["runs"], r["failed"], r["n_rows"]) for r in phases(spark.read.parquet(str(tmp_path / "log"))).collect()}
    assert told == {"numbers": (1, 0, 100), "failing": (1, 1, None)}


def test_flow_with_kinds_and_left_slots(spark):
    word = lambda n, w="słowo": " ".join([w] * n)
    rows = [
        (1, "g", word(60, "a") + " enable javascript", "document", "docx"), (2, "g", "enable javascript", "web", None), (3, "g", "enable javascript", "image", None),
        (4, None, word(95, "b"), "text", None), (5, None, word(250, "c"), "text", None), (6, "m", word(10, "d"), "music", None), (7, "m", word(10, "e"), "music", None),
        (8, None, "", "text", None), (9, "h", word(10, "f"), "text", None), (10, "h", word(10, "F"), "text", None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, kind string, format string")
    tables = corpus.run(docs, Config(slots=9, words_per_file=100, bytes_per_file=10_000, stage_similarity=False))
    got = {r["doc_id"]: (r["status"], r["reason"]) for r in tables["sources"].collect()}
    packed = ("packed", None)
    assert got == {1: packed, 2: ("skipped", "block_page"), 3: packed, 4: packed, 5: packed, 6: packed, 7: packed, 8: ("skipped", "empty"), 9: packed, 10: ("duplicate", None)}
    routes = {r["doc_id"]: (r["route"], r["is_group"], r["part_count"]) for r in tables["plan"].collect()}
    assert routes[3][0] == "images" and routes[6] == ("music", False, 1) and routes[5] == ("texts", False, 3) and routes[1][1]
    assert {r["doc_id"]: len(r["reasons"]) > 0 for r in tables["sources"].collect()}[3] is False  # images are not scored
    # four files are left beside the three merged ones: the text in three parts fits, then nothing does
    fewer = corpus.run(docs, Config(slots=7, words_per_file=100, bytes_per_file=10_000, stage_similarity=False))
    skipped = {r["doc_id"]: r["reason"] for r in fewer["skipped"].collect()}
    assert skipped[8] == "empty" and set(skipped.values()) <= {"empty", "block_page", "too_many_parts", "no_slot"} and "too_many_parts" in skipped.values()
    events = {r["phase"]: r for r in tables["events"].collect()}
    assert list(events) == ["sources", "decisions", "slots", "plan", "skipped"] and events["sources"]["counts"]["empty"] == 1 and events["decisions"]["counts"]["duplicate"] == 1
    assert events["skipped"]["n_rows"] == 2
