"""Centroid clustering, personal data and alignment against brute force."""

import hashlib
import random
import re
import time
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import alignment, centroids, pii

VECTORS = "vec_id long, embedding array<double>, label int, cluster string, flat int, key int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows], VECTORS)


def plain_clusters(rows, k, rounds, dim):
    """k-means with Python's integers, vector by vector."""
    own = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v):
            own.append((i, [max(-centroids.LARGEST, min(centroids.LARGEST, int(np.floor(np.float64(x) * 256)))) for x in v]))
    of = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centers = [v for _, v in sorted(own, key=lambda r: (of(r[0]), r[1]))[:k]]
    assign = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c)), n) for n, c in enumerate(centers))
    for _ in range(rounds):
        at = [assign(v)[1] for _, v in own]
        for n in set(at):
            members = [v for (_, v), a in zip(own, at) if a == n]
            centers[n] = [sum(x) // len(members) for x in zip(*members)]
    found = [(i, *assign(v)) for i, v in own]
    inertia = Counter()
    for _, distance, n in found:
        inertia[n] += distance
    most = (1 << 63) - 1
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return Counter((i, n, distance, min(most, inertia[n]), min(most, inertia.total()), digest[n]) for i, distance, n in found)


def test_clusters(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(60)] + [(7, rows[3][1]), (7, rows[3][1]), (None, rows[4][1]), (None, [0.0] * 6)]
    rows += [(300, None), (301, []), (302, [1.0] * 5), (303, [1.0] * 7), (304, [None] + [1.0] * 5), (305, [float("nan")] + [1.0] * 5), (306, [float("inf")] * 6), (307, [-0.0] * 6), (308, [0.5] * 6)]
    got = centroids.cluster(vectors(spark, rows), k=9, rounds=3, dim=6, block=8)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == plain_clusters(rows, 9, 3, 6)


def test_clusters_of_few_huge_and_no_vectors(spark):
    rows = [(1, [1e30, -1e30]), (2, [524287.9, 0.0]), (3, [0.0, 0.0])]
    got = centroids.cluster(vectors(spark, rows), k=40, rounds=5, dim=2)
    assert Counter(tuple(r) for r in got.collect()) == plain_clusters(rows, 40, 5, 2)
    assert centroids.cluster(vectors(spark, []), k=3, rounds=2, dim=2).count() == 0
    assert centroids.cluster(vectors(spark, [(1, None)]), k=3, rounds=2, dim=2).count() == 0


def test_curve_visits_neighbours():
    """Along a Hilbert curve each cell is a step from the next."""
    for dim, bits in ((2, 4), (3, 2), (4, 2)):
        side = 1 << bits
        cells = np.array(list(product(range(side), repeat=dim)), np.int64)
        keys = centroids.hilbert_keys(cells, np.zeros(dim, np.int64), np.full(dim, side - 1), bits)
        assert len(set(keys)) == len(cells)
        ordered = cells[sorted(range(len(keys)), key=keys.__getitem__)]
        assert (np.abs(np.diff(ordered, axis=0)).sum(axis=1) == 1).all()


def test_boxes_leave_few_centroids_of_clustered_vectors(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 8)) * 4
    rows = [(i, (centers[i % 12] + rng.normal(size=8) * 0.05).tolist()) for i in range(960)]
    table = centroids.blocks(vectors(spark, rows), 8, 16)
    found = centroids.pruning(table, np.floor(centers * 256).astype(np.int64)).first()
    assert found["compared"] < found["possible"] / 3
    low, high = np.zeros(8, np.int64), np.full(8, 3)
    for _ in range(200):
        centers = rng.integers(-20, 20, size=(10, 8))
        points = rng.integers(0, 4, size=(50, 8))
        assert set(centroids.nearest(points, centers)[0]) <= set(centroids.candidates(low, high, centers))


def plain_spans(text):
    """The base kinds as their definition has them."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    found = []
    for order, (kind, pattern) in enumerate(patterns.items()):
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), order, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def base(text):
    return [s[:3] for s in pii.spans(text) if s[0] in {k.name for k in pii.BASE}]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab.@-+%(_) 0149é\n", max_size=60))
def test_base_kinds(text):
    assert base(text) == plain_spans(text)


def test_base_kinds_of_likely_texts():
    rng = random.Random(4)
    parts = ["a@b.c", "x.y@", "@", "4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4", "256.1.1.1", "0001.02.3.255", "+1 (614) 555-8001", "+44", "12", "٣٤", " ", ".", "é", "+4915112345678", "-", "foo%bar@mail-1.example.co.uk."]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 9)))
        assert base(text) == plain_spans(text)


def test_added_kinds():
    kinds = lambda text: {k: text[a:b] for k, a, b, _ in pii.spans(text)}
    assert kinds("pay to GB82 WEST 1234 5698 7654 32 AND 5 MORE") == {"iban": "GB82 WEST 1234 5698 7654 32"}
    assert [s[0] for s in pii.spans("GB82 WEST 1234 5698 7654 32 or DE89370400440532013000")] == ["iban", "iban"]
    assert "iban" not in kinds("GB83 WEST 1234 5698 7654 32")
    assert kinds("my SSN is 536-90-4399")["ssn"] == "536-90-4399" and "ssn" not in kinds("part 536-90-4399") and "ssn" not in kinds("SSN 000-90-4399")
    assert kinds("DNI 12345678Z")["dni"] and "dni" not in kinds("DNI 12345678A") and "dni" not in kinds("ref 12345678Z")
    assert "nir" in kinds("sécurité sociale 2 69 05 49 588 157 80") and "steuer" in kinds("Steuer 86 095 742 719")
    assert kinds("call (030) 1234 5678") == {"localphone": "(030) 1234 5678"} and kinds("see (030) 1234 5678") == {}
    assert kinds("born 12.03.1984")["birthday"] == "12.03.1984" and kinds("on 12.03.1984") == {} and kinds("geboren 1984-13-32") == {}
    assert kinds("tel +1 (614) 555-8001") == {"phone": "+1 (614) 555-8001"}  # no local number inside a base span
    scores = {k: s for k, _, _, s in pii.spans("card 4111 1111 1111 1111")}
    assert scores["card"] == 1.0 and {k: s for k, _, _, s in pii.spans("xx 4111 1111 1111 1111")}["card"] == 0.8


def test_time_is_linear_in_hostile_texts():
    began = time.time()
    for text in ("a" * 10**6, "a@" * 10**5, "1" * 10**6, "1." * 10**5, "+1" + "(" * 10**6, "+1 " * 10**5, "a." * 10**5 + "@", "A1" * 10**5, "1-" * 10**5, "GB82 " * 10**5):
        pii.spans(text)
    assert time.time() - began < 30


def test_pii_tables(spark):
    rows = [(1, "mail a@b.cd now"), (2, None), (3, ""), (None, "1.2.3.4"), (1, "mail a@b.cd now"), (4, "é +1 (614) 555-8001, 4111111111111111 born 12.03.1984")]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, found string, start int, spans int")
    got = pii.counted(docs).collect()
    line = lambda s: ",".join(f"{k}:{a}:{b}" for k, a, b in s)
    want = [(i, *(sum(s[0] == k for s in plain_spans(t)) for k in ("email", "ip", "card", "phone")), hashlib.sha256(line(plain_spans(t)).encode()).hexdigest()) for i, t in rows]
    assert Counter(tuple(r)[:6] for r in got) == Counter(want)
    assert {r["doc_id"]: r["spans"] for r in got}[4] == "phone:2:19,card:21:37,birthday:43:53"
    assert pii.counted(docs.limit(0)).count() == 0
    hidden = pii.redact(docs)
    assert hidden.columns == docs.columns and {r["doc_id"]: r["text"] for r in hidden.collect()}[4] == "é [phone], [card] born [birthday]"
    assert [r["text"] for r in hidden.where("doc_id = 2").collect()] == [None]


def plain_alignment(rows):
    """Links and groups from the ends of the tokens, with the vocabularies' own libraries."""
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coder.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    counts, out = Counter(), []
    for i, text in rows:
        found = coder.encode(" " + (text or ""), add_special_tokens=False)
        sides = [[bytes(letters[c] for c in t) for t in found.tokens], found.ids], [[], model.encode(text or "")]
        for piece in map(model.id_to_piece, sides[1][1]):
            sides[1][0].append(bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode())
        if not text or any(b"".join(s) != (" " + text).encode() for s, _ in sides):
            out.append((i, 0, 0, [], []))
            continue
        ends = [np.cumsum([len(t) for t in s]).tolist() for s, _ in sides]
        links, groups, at = [], [], [0, 0]
        for end in sorted(set(ends[0]) & set(ends[1])):
            to = [e.index(end) + 1 for e in ends]
            groups.append("|".join(",".join(map(str, sides[n][1][at[n] : to[n]])) for n in (0, 1)))
            links.append((sides[0][1][to[0] - 1], sides[1][1][to[1] - 1]))
            at = to
        counts.update(links)
        out.append((i, len(ends[0]), len(ends[1]), groups, links))
    best = {b: max(n for (_, c), n in counts.items() if c == b) for _, b in counts}
    digest = lambda groups: hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
    return Counter((i, a, b, len(g), len(k), sum(counts[p] == best[p[1]] for p in k), sum(counts[p] for p in k), digest(g)) for i, a, b, g, k in out)


def test_alignment(spark):
    rng = random.Random(1)
    words = "the naïve 漢字 tokenizer's 123456 <s> <|endoftext|> \x00 ½ 😀 don't  \n\n été ▁ <0x41> ﬁ ａ".split(" ")
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 30)))) for i in range(120)] + [(1, "the same"), (1, "the same"), (None, "the"), (500, None), (501, ""), (502, " "), (503, "  a \t"), (504, "a" * 5000), (505, "word " * 4000), (506, "▁x")]
    docs = spark.createDataFrame([(i, t, 1, "x", [1], "y") for i, t in rows], "doc_id long, text string, chunk int, name string, pairs array<int>, groups string")
    assert Counter(tuple(r) for r in alignment.aligned(docs, groups=False).collect()) == plain_alignment(rows)
    assert alignment.aligned(docs.limit(0)).count() == 0
    whole = alignment.aligned(docs).where("n_a > 0").select("groups", "groups_sha256").distinct().collect()
    assert whole and all(hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] for r in whole)


def test_alignment_of_many_chunks(spark):
    rows = [(i, f"number {i % 7} of the naïve words") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    assert Counter(tuple(r) for r in alignment.aligned(docs, groups=False).collect()) == plain_alignment(rows)


def test_overlaps_are_all_that_share_bytes():
    rng = np.random.default_rng(2)
    for _ in range(50):
        sides = []
        for _ in range(2):
            cuts = np.unique(np.concatenate((rng.integers(1, 40, size=8), [40])))
            sides.append(alignment.pd.DataFrame({"start": np.concatenate(([0], cuts[:-1])), "end": cuts, "doc": 0}))
        got = list(zip(*(at.tolist() for at in alignment.overlaps(*sides))))
        a, b = (s[["start", "end"]].to_numpy().tolist() for s in sides)
        assert len(got) == len(set(got)) and set(got) == {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[0] < y[1] and y[0] < x[1]}
