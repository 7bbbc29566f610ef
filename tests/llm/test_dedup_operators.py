import hashlib
import random
from collections import Counter

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import common, deep_shallow, embedding_dedup, exact_dedup, simhash, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, mark string, spans int, kept_id int"
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, texts):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, None, None, None, 7, "x", 1, 2) for i, t in texts], DOCS)


def test_exact_groups(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BLOCK", 8)
    long = "Żółw abc " * 40
    rows = [(1, "Same TEXT"), (2, "same text"), (3, long), (4, long.translate(_UPPER)), (5, long[:-1]), (6, None), (7, ""), (None, "same text"), (9, "É"), (10, "é"), (11, long + "x"), (8, "q"), (8, "q"), (12, "12345678"), (13, "123456781")]
    got = exact_dedup.exact_groups(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    classes = {}
    for i, t in rows:
        classes.setdefault((t or "").translate(_UPPER), []).append(i)
    for r in got:
        members = next(m for t, m in classes.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        assert (r["keep_id"], r["group_size"]) == (max(i for i in members if i is not None), len(members))
    assert sum(r["kept"] for r in got) == len(classes)
    kept = exact_dedup.keep_one(documents(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(max(i for i in m if i is not None) for m in classes.values())
    assert kept.columns == documents(spark, []).columns
    assert exact_dedup.exact_groups(documents(spark, [])).count() == 0


def test_exact_groups_where_hashes_clash(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BLOCK", 8)
    monkeypatch.setattr(exact_dedup, "block_hash", lambda c: F.pmod(F.xxhash64(c), F.lit(3)))
    test_exact_groups(spark, monkeypatch)


def test_exact_groups_of_hot_blocks(spark):
    rows = [(i, "copy of a text " * 3 if i % 2 else f"text {i}") for i in range(600)]
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(documents(spark, rows)).collect()}
    assert got[1]["group_size"] == 300 and got[1]["keep_id"] == 599 and got[0]["group_size"] == 1


def plain_fingerprint(text):
    words = (text or "").translate(_UPPER).encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_of(ids, near):
    label = dict(zip(ids, ids))
    while True:
        new = {i: min(label[j] for j in near[i]) for i in ids}
        if new == label:
            return label
        label = new


def test_simhash(spark):
    random.seed(2)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(random.choices(words, k=60))) for i in range(40)]
    rows += [(100 + i, t.replace("w1 ", "W1 ") + (" tail" if i % 2 else "")) for i, t in rows] + [(200, None), (201, ""), (202, " \t\n"), (203, "two words"), (204, "two words"), (204, "x\x0by\x1cz \u00a0 q")]
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    prints = {(i, t): plain_fingerprint(t) for i, t in rows}
    assert Counter(r["fingerprint"] for r in got) == Counter(f"{p:016x}" for p in prints.values())
    ids = sorted(set(i for i, _ in rows))
    near = {i: [j for j in ids if any((a ^ b).bit_count() <= 3 for (x, _), a in prints.items() if x == i for (y, _), b in prints.items() if y == j)] for i in ids}
    label = classes_of([i for i in ids if i != 204], {i: [j for j in n if j != 204] for i, n in near.items()})
    for r in got:
        if r["doc_id"] != 204:
            assert r["component_id"] == label[r["doc_id"]] and r["kept"] == (label[r["doc_id"]] == r["doc_id"])
    kept = simhash.keep_one(documents(spark, rows))
    assert kept.count() == len({r["component_id"] for r in got}) and kept.columns == documents(spark, []).columns
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_ring_finds_every_pair(spark):
    random.seed(3)
    base = [random.getrandbits(64) for _ in range(12)]
    values = {b ^ sum(1 << random.randrange(64) for _ in range(random.randrange(6))) & (1 << 64) - 1 for b in base for _ in range(25)}
    values = np.array(sorted(values), dtype=np.uint64)
    rows = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    got = {frozenset((r["a"], r["b"])) for r in simhash.near_pairs(rows).collect()}
    close = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    signed = values.view(np.int64)
    assert got == {frozenset((int(signed[i]), int(signed[j]))) for i, j in zip(*np.nonzero(np.triu(close, 1)))}


def test_components(spark):
    chain = [(i, i + 1) for i in range(20)] + [(100, 50), (50, 70), (7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {50: 50, 70: 50, 100: 50, 200: 200, 201: 200}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.binary(max_size=12) | st.lists(st.sampled_from([97, 98]), max_size=40).map(bytes), max_size=25), st.integers(0, 6))
def test_deep_shallow_sort(strings, shallow):
    order = deep_shallow.sort(strings, shallow)
    assert [strings[i] for i in order] == sorted(strings) and sorted(order) == list(range(len(strings)))


def plain_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    counts = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if counts[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        rest = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(rest).hexdigest()))
    return out


def test_suffix_dedup(spark, monkeypatch):
    random.seed(1)
    pieces = ["".join(random.choices("abcdé ", k=random.randrange(50, 300))) for _ in range(12)]
    rows = [(i, "".join(random.choices(pieces, k=random.randrange(6)))[random.randrange(80) :]) for i in range(50)]
    rows += [(5, "x" * 500), (5, "x" * 500), (None, "y" * 210), (None, None), (7, ""), (None, "z" * 199)]
    want = sorted(((i, *w) for (i, _), w in zip(rows, plain_repeats([t for _, t in rows], 200))), key=str)
    found = lambda: sorted(map(tuple, suffix_dedup.remove_repeats(documents(spark, rows), texts=False).collect()), key=str)
    assert found() == want
    # groups too large to gather, and anchors too frequent, go another way to the same end
    monkeypatch.setattr(suffix_dedup, "GROUP", 1)
    monkeypatch.setattr(suffix_dedup, "HOT", 0.0)
    assert found() == want
    stripped = suffix_dedup.strip_repeats(documents(spark, rows))
    assert stripped.columns == documents(spark, []).columns and stripped.count() == len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in stripped.collect())
    assert suffix_dedup.remove_repeats(documents(spark, [])).count() == 0


def test_reach_without_pairs_agrees(monkeypatch):
    random.seed(9)
    for _ in range(30):
        texts = ["".join(random.choices("ab", k=random.randrange(20))).encode() for _ in range(random.randrange(2, 14))]
        lefts = ["".join(random.choices("ab", k=random.randrange(20))).encode() for _ in texts]
        pairs = suffix_dedup._reach(texts, lefts, 16)
        monkeypatch.setattr(suffix_dedup, "PAIRED", 1)
        assert suffix_dedup._reach(texts, lefts, 16) == pairs
        monkeypatch.undo()


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    monkeypatch.setattr(embedding_dedup, "CELL", 60)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(20, 8))
    rows = [(i, i % 3 if i % 17 else None, [float(x) for x in base[i % 20] + rng.normal(size=8) * 0.25 * (i % 4)]) for i in range(500)]
    rows += [(900, 0, None), (901, 1, [0.0] * 8), (902, 1, [None] + [1.0] * 7), (903, 2, [float("nan")] * 8), (904, 0, [1.0, 2.0]), (905, 0, [2.0, 4.0]), (906, 1, []), (907, 0, [1e200, 2e200])]
    vectors = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<double>, class int, unit string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.embedding_groups(vectors).collect()}
    good = [(i, g, np.array(v)) for i, g, v in rows if g is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    near = {i: [i] for i, _, _ in rows}
    for i, g, v in good:
        near[i] = [j for j, h, w in good if h == g and len(w) == len(v) and (v / np.abs(v).max()) @ (w / np.abs(w).max()) >= 0.93 * np.linalg.norm(v / np.abs(v).max()) * np.linalg.norm(w / np.abs(w).max())]
    label = classes_of([i for i, _, _ in rows], near)
    assert got == {i: (len(near[i]) - 1, label[i], label[i] == i) for i, _, _ in rows}
    assert embedding_dedup.embedding_groups(vectors.limit(0)).count() == 0
