import random


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_stage_drops_near_copies(spark):
    import corpus_pipeline

    random.seed(5)
    word = lambda: f"w{random.randrange(3000)}"
    texts = []
    for i in range(60):
        words = [word() for _ in range(random.randrange(60, 400))]
        texts.append(" ".join(words))
        for edits in (2, 3, 6) if i else [2] * 60:  # the first is a large family
            copy = words[:]
            for _ in range(edits * len(words) // 200 + (edits == 6)):
                copy[random.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    docs = spark.createDataFrame([*enumerate(texts), (1000, None), (1001, "  "), (1002, "a b"), (1003, "A  b"), (None, "a b")], "doc_id long, text string")
    got = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    assert got == sorted(set(label)) + [1000, 1002]


def test_stage_keeps_links_inside_a_family_below_the_threshold(spark):
    """Four hundred texts that are all somewhat alike, and sixty pairs among them that are near copies."""
    import corpus_pipeline

    random.seed(9)
    fresh = (f"u{i}" for i in range(100_000)).__next__
    shared = " ".join(f"s{i}" for i in range(300))
    texts = [f"{shared} {' '.join(fresh() for _ in range(40))}" for _ in range(340)]
    planted = {}
    for i in range(60):
        words = texts[i].split()
        planted[len(texts)] = i
        texts.append(" ".join(words[:-31] + [fresh() for _ in range(31)]))
    sets = [shingles(t) for t in texts]
    alike = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    assert all(alike(i, j) > 0.82 for j, i in planted.items()) and alike(100, 200) < 0.79
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert got == set(range(len(texts))) - set(planted)


def test_links_in_groups_are_all(spark, monkeypatch):
    """Blocks of any size connect what links between probes and members connect by brute force."""
    import numpy as np

    from corpusloom.llm import simhash

    rng = random.Random(3)
    sets = {n: sorted(rng.sample(range(30), rng.randint(1, 12))) for n in range(40)}
    rows = [(n, np.array(s, "<u8").tobytes()) for n, s in sets.items()]
    members = [(k, n, rng.random() < 0.4) for k in (1, 2) for n in range(40) if rng.random() < 0.8]
    want = {(min(n, m), max(n, m)) for k, n, asks in members for q, m, _ in members if asks and k == q and n != m and len(set(sets[n]) & set(sets[m])) >= 0.5 * len(set(sets[n]) | set(sets[m]))}
    for size in (3, 512):
        monkeypatch.setattr(simhash, "ROWS", size)
        found = simhash.links_in_groups(spark.createDataFrame(members, "key long, node long, probe boolean"), spark.createDataFrame([(n, bytearray(h)) for n, h in rows], "node long, hashes binary"), 0.5)
        got = [tuple(r) for r in found.collect()]
        assert classes(got) == classes(want) and all(a < b for a, b in got)
        if size == 512:
            assert len(got) <= 80  # one link for each node of a group


def classes(links):
    label = {}
    for _ in range(50):
        for a, b in links:
            label[a] = label[b] = min(label.get(a, a), label.get(b, b))
    return label


def test_the_ring_gives_candidates_of_its_own(spark, monkeypatch):
    """Without any band in common the pigeonring still links what is near, and the exact check still keeps apart what is not alike."""
    from pyspark.sql import functions as F

    from corpusloom.llm import simhash

    own = simhash.sketches
    monkeypatch.setattr(simhash, "sketches", lambda docs, words: own(docs, words).withColumn("bands", F.array(F.xxhash64("doc_id"))))
    words = [f"w{i}" for i in range(3000)]
    docs = [(1, " ".join(words)), (2, " ".join([*words[:-1], "end"])), (3, " ".join(f"v{i}" for i in range(3000))), (4, "a short one"), (5, "another short one of six words")]
    kept = simhash.keep_unlike(spark.createDataFrame(docs, "doc_id long, text string"), 5, 0.8)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5]
