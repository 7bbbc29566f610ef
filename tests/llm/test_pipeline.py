import random


def test_stages(spark):
    import corpus_pipeline

    random.seed(2)
    vocabulary = [f"{a}{b}" for a in ("the", "of", "and", "town", "river") for b in ("", "er", "ing", "ed", "s")]
    text = lambda n: " ".join(random.choices(vocabulary, k=n))
    passage = text(60)
    rows = [(i, text(80), "en", f"s{i % 3}", 0) for i in range(12)] + [(20, f"{text(40)} {passage} {text(40)}", "en", "s1", 0), (21, f"{text(40)} {passage} {text(40)}", "en", "s2", 0), (22, rows_copy := text(50), "en", "s0", 0), (23, rows_copy.upper(), "en", "s0", 0), (24, None, None, None, None)]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        seen[name] = docs.collect()
        docs = spark.createDataFrame(seen[name], docs.schema)
    ids = lambda name: {r["doc_id"] for r in seen[name]}
    assert ids("language ID") == {r[0] for r in rows} and ids("exact dedup") == {r[0] for r in rows} - {22}
    assert ids("suffix-array dedup") == ids("SimHash near-dedup")
    assert all(passage not in r["text"] for r in seen["suffix-array dedup"])
    assert sum(r["length"] for r in seen["packing"]) > 500 and [n for n, _ in corpus_pipeline.STAGES][-1] == "packing"


def _corpus(spark, folder):
    random.seed(4)
    text = lambda n: " ".join(random.choices([f"{a}{b}" for a in ("the", "of", "and", "town", "river") for b in ("", "er", "ing", "ed", "s")], k=n))
    rows = [(i, text(60), "en", "s", 0) for i in range(20)]
    rows += [rows[3], rows[3], (50, rows[4][1], "en", "t", 0), (None, rows[5][1], "en", "t", 0), (None, None, None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    return docs


def test_two_runs_and_lazy_stages(spark, tmp_path):
    """A result outlives later runs; stages may be chained without a write between them; repeats and empty tables pass."""
    import corpus_pipeline

    docs = _corpus(spark, tmp_path)
    first, second = corpus_pipeline.run(spark, str(tmp_path)), corpus_pipeline.run(spark, str(tmp_path))
    rows = sorted(map(str, first.collect()))
    assert rows == sorted(map(str, second.collect())) == sorted(map(str, first.collect()))
    chained = docs
    for _, stage in corpus_pipeline.STAGES:
        chained = stage(spark, chained, "")
    pieces = lambda found: sorted((r["doc_id"] is None, r["doc_id"], r["doc_tokens"]) for r in found.collect())
    assert pieces(chained) == pieces(first)
    assert len(set(pieces(first))) == 21  # one of each text, and the empty one
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
    assert empty.count() == 0
