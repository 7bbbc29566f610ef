"""Sequential rules in chunks, and pairs by masks and bounds, against the rules one by one."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import packing, similarity, subtitles


def bins_of(sizes, most_words, most_bytes, joiner):
    bins, number, words, size = [], 0, 0, 0
    for i, (w, b) in enumerate(sizes):
        if not i or words + w > most_words or size + joiner + b > most_bytes:
            number, words, size = number + 1, w, b
        else:
            words, size = words + w, size + joiner + b
        bins.append(number)
    return bins


@pytest.mark.parametrize("chunk", [3, 17, 1 << 16])
def test_next_fit_in_chunks(spark, chunk):
    rng = random.Random(chunk)
    groups = {
        "hot": [(rng.randint(0, 40), rng.randint(0, 300)) for _ in range(700)],
        "even": [(40, 10)] * 101,  # beginnings that never meet
        "tiny": [(0, 0)] * 120 + [(1, 1)] * 90,  # a bin over many chunks
        "huge": [(500, 5), (1, 1), (2, 5000), (3, 3)] * 9,
        "one": [(1, 1)], None: [(30, 200)] * 20,
    }
    rows = [(g, i, w, b, 7, "x") for g, sizes in groups.items() for i, (w, b) in enumerate(sizes)]
    rng.shuffle(rows)
    items = spark.createDataFrame(rows, "g string, nth int, n_words long, n_bytes long, chunk int, of string")
    got = packing.next_fit(items, "g", ["nth"], 100, 900, 2, chunk)
    assert got.columns == [*items.columns, "bin"]
    found = {(r["g"], r["nth"]): r["bin"] for r in got.collect()}
    assert found == {(g, i): n for g, sizes in groups.items() for i, n in enumerate(bins_of(sizes, 100, 900, 2))}
    assert packing.next_fit(items.limit(0), "g", ["nth"], 100, 900).count() == 0


def test_next_fit_tables_stay_short(spark):
    """Beginnings meet: a chunk of many items tells a few ranges, not a row for each item of a bin."""
    import pyarrow as pa

    rng = random.Random(2)
    items = pa.table({packing.NTH: pa.array(range(30_000), pa.int32()), "n_words": [rng.randint(1, 20) for _ in range(30_000)], "n_bytes": [rng.randint(1, 90) for _ in range(30_000)]})
    told = packing._outcomes(items, pa.table({"chunk": [1], "words": [10], "size": [20]}), (1000, 10**9), 2)
    assert told.num_rows < 12  # a bin holds some 95 items


@pytest.mark.parametrize("chunk", [1, 7, 50, 4096])
def test_paragraphs_in_chunks(spark, chunk):
    rng = random.Random(chunk)
    word = lambda: rng.choice(["tak", "nie", "może", "koniec.", "dobrze", "x" * 30, "i", "(śmiech)", "a:"])
    turn = lambda: " ".join(word() for _ in range(rng.randint(0, 12)))
    sources = {f"s{k}": [(i * 2.5, turn()) for i in range(n)] for k, n in enumerate((300 if chunk > 1 else 60, 41, 1, 5))}
    sources["mute"] = [(float(i), "[muzyka]" if i % 2 else None) for i in range(20)]
    sources["unended"] = [(float(i), "słowo" + "a" * (i % 7)) for i in range(400 if chunk > 1 else 30)]
    rows = [(s, i, at, text) for s, turns in sources.items() for i, (at, text) in enumerate(turns)]
    rng.shuffle(rows)
    got = subtitles.paragraphs(spark.createDataFrame(rows, "source_id string, pos int, start_s double, text string"), chunk=chunk)
    want = {(s, no): (start, text) for s, turns in sources.items() for no, (start, text) in enumerate(subtitles.fold_paragraphs(turns), 1)}
    assert {(r["source_id"], r["no"]): (r["start_s"], r["text"]) for r in got.collect()} == want


def test_masks_cover():
    rng = random.Random(1)
    for radius in range(11):
        masks = similarity.covering_masks(radius)
        assert len(set(masks)) == 2 ** (radius + 1) - 1 and min(m.bit_count() for m in masks) >= 12 and max(masks) < 1 << 32
        for _ in range(200):
            apart = sum(1 << b for b in rng.sample(range(32), radius))
            assert any(m & apart == 0 for m in masks)


@pytest.mark.parametrize("distance", [0, 7, 16])
def test_masks_and_blocks_give_all_pairs(spark, distance):
    rng = random.Random(distance)
    prints = [rng.getrandbits(64) for _ in range(60)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(64), n)) for p in prints[:40] for n in (1, 6, 8, 15, 16, 17)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(p,) for p in signed], "simhash long")
    bits = np.array(sorted(set(signed)), np.int64).view(np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(bits[:, None] ^ bits[None, :]) <= distance, 1))
    want = {(int(bits.view(np.int64)[i]), int(bits.view(np.int64)[j])) for i, j in near.tolist()}
    for pairs in (similarity.masked_pairs(table.distinct(), distance), similarity.review_pairs(table, distance)):
        assert {tuple(r) for r in pairs.collect()} == want


def test_masks_send_a_fixed_number_of_rows(spark):
    for n in (100, 1000):
        table = spark.range(n).select(F.xxhash64("id").alias("simhash"))
        keyed = similarity.masked_pairs(table, 16)._jdf.queryExecution().optimizedPlan().toString()
        assert keyed.count("Generate explode") == 2
    assert len(similarity.covering_masks(8)) + len(similarity.covering_masks(7)) == 766


@pytest.mark.parametrize("texts", [3, 256])
def test_short_pairs_are_all(spark, monkeypatch, texts):
    monkeypatch.setattr(similarity, "TEXTS", texts)
    rng = random.Random(6)
    alphabet = "ab cé\U0001f600"
    rows = ["", "", "a", "x " * 70, "x " * 90, "x" * 120]
    for _ in range(45):
        text = "".join(rng.choices(alphabet, k=rng.randint(1, 60)))
        rows += [text, "".join(c for c in text if rng.random() > 0.1), "".join(rng.sample(text, len(text)))]
    docs = spark.createDataFrame(list(enumerate(rows)), "place long, text string")
    for at_least in (0.75, 0.95):
        score = lambda s, t: difflib.SequenceMatcher(None, s, t, autojunk=False).ratio()
        want = {(i, j): score(s, t) for i, s in enumerate(rows) for j, t in enumerate(rows) if i < j and min(len(s.split()), len(t.split())) < 60 and score(s, t) >= at_least}
        assert {(r["a"], r["b"]): r["score"] for r in similarity.short_pairs(docs, at_least, 60).collect()} == want


def test_common_subsequences():
    rng = random.Random(8)
    for _ in range(300):
        s, t = ("".join(rng.choices("abc", k=rng.randint(0, 12))) for _ in range(2))
        table = [[0] * (len(t) + 1) for _ in range(len(s) + 1)]
        for i, x in enumerate(s):
            for j, y in enumerate(t):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert similarity.common_subsequence(similarity.character_masks(s), len(s), t) == table[-1][-1]
