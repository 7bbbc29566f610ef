"""What op7 writes and holds for vectors that are guests in many cells."""

import numpy as np
import pyarrow as pa

from corpusloom.llm import embedding_dedup as D


def test_a_vector_is_written_once_however_many_cells_it_visits(spark, monkeypatch):
    # each guest was written with a copy of its vector before, a whole batch of Spark's at once
    units = np.random.default_rng(3).normal(size=(600, 8))
    written, stash = {}, D.stash
    monkeypatch.setattr(D, "CELL", 40)
    monkeypatch.setattr(D, "BLOCK", 64)
    monkeypatch.setattr(D, "stash", lambda df, name: written.setdefault(name, stash(df, name)))
    rows = spark.createDataFrame([(i, u.tolist(), 1) for i, u in enumerate(units)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r["n_links"] for r in D.embedding_groups(rows).collect()}
    assert written["cells"].count() == 600 and written["cells"].selectExpr("sum(size(guests))").first()[0] > 600
    x = units.astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert [got[i] for i in range(600)] == ((x @ x.T >= 0.93).sum(axis=1) - 1).tolist()


def test_what_leaves_a_task_at_once_is_bounded():
    n, cells = 5000, {(1, 4): D.spherical_kmeans(np.eye(4).repeat(2, axis=0) + np.arange(8)[:, None] * 0.01, 8)}
    vectors = pa.array(np.random.default_rng(1).normal(size=(n, 4)).tolist())
    one = pa.array(np.ones(n))
    batch = pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int64)), pa.array(np.full(n, 4, np.int32)), vectors, one, one], ["label", "dim", "embedding", "top", "norm"])
    sizes = [b.num_rows for b in D._assign(iter([batch]), cells, 10.0)]
    assert sum(sizes) == n and max(sizes) <= D.SLICE


def test_strips_compare_as_whole_blocks_do(monkeypatch):
    side = lambda n, first: pa.table({"class": np.arange(first, first + n), "copies": np.ones(n, np.int64), "embedding": pa.array(np.random.default_rng(n).normal(size=(n, 2)).tolist()), "top": np.ones(n), "norm": np.ones(n)})
    a, b = side(90, 0), side(70, 40)
    want = [D._compare(a, b, 2.0, how) for how in ("homes", "guests")] + [D._compare(a, a, 2.0, "same")]
    monkeypatch.setattr(D, "STRIP", 7)
    assert [D._compare(a, b, 2.0, how) for how in ("homes", "guests")] + [D._compare(a, a, 2.0, "same")] == want and want[0].num_rows > 20
