"""Snapshots, repacking on arrival and the two-phase sink."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import packing, render
from corpusloom.sources import text_sink
from corpusloom.streaming import store


def rows_of(table):
    return None if table is None else sorted(map(tuple, table.collect()))


def test_snapshots_survive_torn_writes(spark, tmp_path):
    path = str(tmp_path / "table")
    shots = store.Snapshots(spark, path)
    assert shots.read() is None
    table = lambda n: spark.createDataFrame([(n, "x")], "a long, b string")
    shots.write(table(1))
    second = shots.write(shots.read().unionByName(table(2)))
    assert rows_of(shots.read()) == [(1, "x"), (2, "x")]
    # a version that was written, but neither described nor pointed to
    table(9).write.parquet(f"{path}/v-0000000003")
    assert shots.current() == second and rows_of(shots.read()) == [(1, "x"), (2, "x")]
    fourth = shots.write(table(4))
    assert fourth == "v-0000000004" and rows_of(shots.read()) == [(4, "x")]
    # a file that is cut short: back to the version before, as the third was never whole
    file = next(f for f in os.listdir(f"{path}/{fourth}") if f.endswith(".parquet"))
    with open(f"{path}/{fourth}/{file}", "r+b") as f:
        f.truncate(10)
    assert shots.current() == second and rows_of(shots.read()) == [(1, "x"), (2, "x")]
    # a pointer that was torn
    (tmp_path / "table" / "CURRENT").write_text("v-00")
    assert shots.current() == second
    os.remove(f"{path}/CURRENT")
    assert rows_of(shots.read()) == [(1, "x"), (2, "x")]
    for n in range(5, 9):
        shots.write(table(n))
    assert shots.versions() == [f"v-{n:010d}" for n in (8, 7, 6)] and rows_of(shots.read()) == [(8, "x")]
    with pytest.raises(ValueError):
        store.Snapshots(spark, path, keep=1)


def stamps(path):
    found = [os.path.join(d, f) for d, _, files in os.walk(path) for f in files if f.endswith(".parquet")]
    return {os.path.relpath(f, path): os.stat(f).st_mtime_ns for f in found}


def test_repacking_leaves_other_groups_alone(spark, tmp_path):
    rng = random.Random(3)
    source, sources, plan = (str(tmp_path / n) for n in ("in", "sources", "plan"))
    rows = [(i, rng.choice(["a", "b", "c/d", "", None, " "]), "word " * rng.randint(0, 30) + "." * (i % 5 == 0) * 300) for i in range(90)]
    schema = "doc_id long, source string, text string"
    batches = [rows[:40], [r for r in rows[40:70] if r[1] in ("a", None)], [r for r in rows[40:70] if r[1] not in ("a", None)] + rows[70:]]
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    seen = []
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        store.stream_repack(stream(), sources, plan, str(tmp_path / "state"), 40, 400).awaitTermination()
        seen.append(stamps(plan))
    of = lambda g: "of=" + hashlib.sha256(g.encode()).hexdigest()
    untouched = {k: v for k, v in seen[0].items() if k.startswith((of("b"), of("c/d")))}
    assert untouched and all(seen[1].get(k) == v for k, v in untouched.items())
    assert not any(seen[1].get(k) == v for k, v in seen[0].items() if k.startswith(of("a") + "/lot=-1"))
    columns = ["file_id", "doc_id", "group", "is_group", "bin", "part_no", "part_count", "n_words", "n_bytes"]
    cold = packing.plan(spark.createDataFrame(rows, schema), 40, 400).select(*columns)
    got = spark.read.parquet(plan).select(*columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, cold.collect()))
    # the last batch once more: nothing changes
    store.repack(spark.createDataFrame(batches[2], schema), 2, sources, plan, 40, 400)
    assert sorted(map(str, spark.read.parquet(plan).select(*columns).collect())) == sorted(map(str, cold.collect()))


def listed(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, files in os.walk(path) for f in files)


def test_sink_writes_a_file_for_each_row(spark, tmp_path):
    rows = [(f"g/{i}.txt" if i % 2 else f"ż {i}.md", f"treść {i}\n" * i) for i in range(25)]
    files = render.described(spark.createDataFrame(rows, "file_id string, body string").repartition(5))
    path = str(tmp_path / "out")
    told = {r["file"]: (r["n_bytes"], r["checksum"]) for r in text_sink.write_text_files(files, path).collect()}
    assert listed(path) == sorted([*told, text_sink.LISTING]) and len(told) == 25
    assert told == {r["file_id"]: (r["n_bytes"], r["checksum"]) for r in files.collect()}
    for name, (size, digest) in told.items():
        raw = (tmp_path / "out" / name).read_bytes()
        assert (len(raw), hashlib.sha256(raw).hexdigest()) == (size, digest)


@pytest.mark.parametrize("bad", ["fails", "../x", "twice", None])
def test_a_failed_write_leaves_nothing(spark, tmp_path, bad):
    path = str(tmp_path / "out")
    rows = spark.range(20).select(F.concat(F.lit("f"), "id").alias("file_id"), F.lit("body").alias("body")).repartition(4)
    if bad == "fails":
        rows = rows.withColumn("body", F.when(F.col("file_id") == "f13", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("body")))
    else:
        name = F.when(F.col("file_id") == "f13", F.lit("f1" if bad == "twice" else bad).cast("string"))
        rows = rows.withColumn("file_id", name if bad is None else F.coalesce(name, "file_id")) if bad else rows.withColumn("file_id", F.when(F.col("file_id") != "f13", F.col("file_id")))
    with pytest.raises(Exception):
        text_sink.write_text_files(rows, path)
    assert not os.path.exists(path) or [f for f in listed(path) if not f.startswith("_writing-")] == []
