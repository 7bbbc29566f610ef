"""What must not grow faster than the input: broadcasts, rows sent, time in one group."""

import pytest

from corpusloom.llm import simhash
from corpusloom.operators import similarity


@pytest.mark.parametrize("pairs", [lambda p: similarity.ring_pairs(p), lambda p: similarity.masked_pairs(p), lambda p: simhash.near_pairs(p.withColumnRenamed("simhash", "fp"))])
def test_keyed_fingerprints_are_never_broadcast(spark, tmp_path, pairs):
    spark.range(50).selectExpr("xxhash64(id) AS simhash").write.parquet(str(tmp_path / "prints"))
    plan = pairs(spark.read.parquet(str(tmp_path / "prints")))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_rows_are_sent_a_bounded_number_of_times(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    rows = spark.range(2000).select("id")
    told = similarity.blocked_pairs(rows, F.lit(0), lambda a, b, same: pa.table({"n": pa.array([len(a) + len(b)], pa.int64())}), "n long", block=10)
    assert told.agg(F.sum("n")).first()[0] <= 2000 * (similarity.BLOCKS + 1)  # 402,000 with a block for each ten rows


def test_tiles_and_bounded_blocks_find_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(similarity, "TILE", 7)
    monkeypatch.setattr(similarity, "BLOCKS", 3)
    values = [r[0] for r in spark.range(120).selectExpr("xxhash64(id % 90) ^ (id * 3)").collect()]
    prints = spark.createDataFrame([(v,) for v in values], "simhash long")
    got = sorted((r["a"], r["b"]) for r in similarity.review_pairs(prints, 16).collect())
    distinct = sorted(set(values))
    assert got == [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if ((a ^ b) & 2**64 - 1).bit_count() <= 16]


def test_deduplicate_leaves_only_what_its_result_reads(spark):
    from pathlib import Path

    from corpusloom.operators.dedup import deduplicate
    from corpusloom.session import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://")) / "stash"
    before = set(folder.glob("*")) if folder.exists() else set()
    docs = spark.createDataFrame([(i, f"text {i % 5} of some words that is like the others") for i in range(20)], "doc_id long, text string")
    assert deduplicate(docs).count() == 20
    assert len(set(folder.glob("*")) - before) == 2


def test_the_file_sink_gets_few_bodies_at_once(spark, tmp_path, monkeypatch):
    from corpusloom.sources import text_sink

    seen = tmp_path / "seen"
    seen.mkdir()
    own = text_sink.Writer.write

    def write(self, iterator, folder=str(seen), own=own):
        def counted():
            for batch in iterator:
                open(f"{folder}/{batch.num_rows}", "w").close()
                yield batch

        return own(self, counted())

    class Counted(text_sink.TextFiles):
        def writer(self, schema, overwrite):
            made = super().writer(schema, overwrite)
            made.__class__ = type("W", (text_sink.Writer,), {"write": write})
            return made

    monkeypatch.setattr(text_sink, "TextFiles", Counted)
    rows = spark.range(0, 500, 1, 1).selectExpr("concat('f', id, '.txt') AS file_id", "repeat('x', 100) AS body")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert text_sink.write_text_files(rows, f"file://{tmp_path}/out").count() == 500
    assert max(int(p.name) for p in seen.iterdir()) <= text_sink.FILES
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_headings_take_time_by_lines_not_by_their_square(spark):
    import time

    from corpusloom.functions import quality

    texts = ["", "# a", "# a\n# b\ntext", "text\n# a\n\n# b", "# a\nx\n# b\ny"]
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [tuple(r) for r in table.select(*quality.headings("text")).collect()] == [(0, 0), (1, 1), (2, 1), (2, 2), (2, 0)]
    long = spark.range(1).selectExpr("repeat('# a\\nb\\n', 8000) AS text")
    began = time.time()
    assert tuple(long.select(*quality.headings("text")).first()) == (8000, 0)
    assert time.time() - began < 15


@pytest.mark.parametrize("pieces", [4, 5, 6])
def test_segments_leave_no_pair_out_and_compare_a_fraction(pieces, monkeypatch):
    import numpy as np

    random = np.random.default_rng(7)
    a = np.unique(random.integers(-(2**63), 2**63 - 1, 1500))
    flips = np.bitwise_or.reduce(np.left_shift(np.int64(1), random.integers(0, 64, (len(a), 18))), axis=1)
    b = np.unique(np.concatenate([a ^ flips, a[:9]]))
    compared, own = [], similarity._Compared.pairs
    monkeypatch.setattr(similarity._Compared, "pairs", lambda self, x, y: compared.append(len(x) * len(y)) or own(self, x, y))
    for distance in (8, 16, 20):
        compared.clear()
        got = [(int(x), int(y)) for some in similarity._near_in_segments(a, b, distance, pieces) for x, y in zip(*some)]
        i, j = np.nonzero(np.bitwise_count((a[:, None] ^ b).view(np.uint64)) <= distance)
        assert sorted(got) == sorted(zip(a[i].tolist(), b[j].tolist()))
        assert distance > 16 or sum(compared) < len(a) * len(b) / 4
    assert similarity._pieces(175_000, 175_000, 16) > 1  # blocks of that size were compared outright before


def test_rounds_read_certain_pairs_alone(spark, monkeypatch):
    from corpusloom.config import Config
    from corpusloom.operators import dedup

    read, own = [], dedup._round
    monkeypatch.setattr(dedup, "_round", lambda state, near, *more: read.append(near._jdf.queryExecution().optimizedPlan().toString()) or own(state, near, *more))
    docs = spark.createDataFrame([(i, " ".join(f"w{j if j % (i + 5) else i}" for j in range(80))) for i in range(12)], "doc_id long, text string")
    assert dedup.deduplicate(docs, Config(short_words=0), digest="md5").count() == 12
    assert read and not any("Filter" in plan for plan in read)


def test_few_pages_are_held_as_objects_at_once(spark, tmp_path):
    from corpusloom.operators import extract

    seen = tmp_path / "batches"
    seen.mkdir()
    pages = spark.range(0, 1000, 1, 1).selectExpr("id AS page_id", "concat('<article><p>', id, '</p></article>') AS html", "'html' AS format")
    found = extract.extract(pages, "page_id", "html")

    def noted(batches, folder=str(seen)):
        for batch in batches:
            open(f"{folder}/{batch.num_rows}", "w").close()
            yield batch

    direct = pages.selectExpr("page_id", "html AS value", "format AS fmt")
    monkey = []

    class Rows:  # hands the operator's own function on, to see the batches that leave it
        schema = pages.schema

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            monkey.append(lambda batches: noted(run(batches)))
            return direct.mapInArrow(monkey[0], schema)

    assert extract.extract(Rows(), "page_id", "html").count() == 1000
    assert max(int(p.name) for p in seen.iterdir()) <= extract.ROWS
    assert {(r["page_id"], r["blocks"][0]["content"]) for r in found.collect()} == {(i, str(i)) for i in range(1000)}
