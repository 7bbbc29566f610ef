import difflib
import hashlib
import random
import unicodedata

import pytest

from corpusloom.config import Config
from corpusloom.operators import dedup as D

WORDS = "alpha Beta gamma delta eps zeta eta! theta iota straße kappa".split()


def fingerprint(text):
    words = text.split()
    weights = [0] * 64
    for i in range(max(1, len(words) - 2) if words else 0):
        value = int.from_bytes(hashlib.blake2b(" ".join(words[i : i + 3]).encode(), digest_size=8).digest(), "big")
        for b in range(64):
            weights[b] += 1 if value >> b & 1 else -1
    return sum(1 << b for b in range(64) if weights[b] > 0)


def plain(text):
    folded = unicodedata.normalize("NFC", text.casefold())
    return " ".join("".join(" " if c.isspace() or unicodedata.category(c)[0] in "PS" else c for c in folded).split())


def one_by_one(new, base, config):
    """The rule as it is stated: each source against all leaders in order."""
    leaders, out = sorted(base), []
    known = {t: (plain(t), fingerprint(t), len(t.split())) for _, t in [*new, *base]}
    for key, text in sorted(new):
        hit = weak = None
        for other, theirs in leaders:
            a, b = known[theirs], known[text]
            if config.stage_hash and theirs == text:
                hit = other, "hash", 1.0
            elif config.stage_cosmetic and a[0] == b[0]:
                hit = other, "cosmetic", 1.0
            elif config.stage_similarity:
                short = min(a[2], b[2]) < config.short_words
                score = difflib.SequenceMatcher(None, theirs, text, autojunk=False).ratio() if short else 1 - (a[1] ^ b[1]).bit_count() / 64
                found = other, "sequence" if short else "simhash", score
                hit = found if score >= config.duplicate else None
                if not hit and score >= config.review and (weak is None or score > weak[2]):
                    weak = found
            if hit:
                break
        if not hit:
            leaders.append((key, text))
        best = hit or weak
        out.append((key, "duplicate" if hit else "review" if weak else "kept", *(best[:2] if best else (None, None)), round(best[2], 4) if best else None))
    return out


def corpus():
    random.seed(5)

    def near(text, n):
        words = text.split(" ")
        for _ in range(n):
            words[random.randrange(len(words))] = random.choice(WORDS)
        return " ".join(words)

    texts = []
    for n in (5, 12, 70, 200):
        for _ in range(3):
            t = " ".join(random.choices(WORDS, k=n))
            texts += [t, t.upper(), near(t, 1), near(near(t, 2), 2), t]
    random.shuffle(texts)
    return list(enumerate([*texts, "", ""]))


@pytest.mark.parametrize("config, based", [(Config(), 0), (Config(), 20), (Config(stage_hash=False, stage_cosmetic=False), 0)])
def test_leaders(spark, config, based):
    rows = corpus()
    base, new = rows[:based], rows[based:]
    frame = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    got = D.deduplicate(frame(new), config, frame(base) if base else None).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == one_by_one(new, base, config)


def test_exact_and_cosmetic_and_tables(spark):
    docs = spark.createDataFrame([(3, "A b."), (1, "a b"), (2, "a b"), (4, None), (5, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["status"], r["main_id"], r["method"]) for r in D.exact_and_cosmetic(docs).collect()}
    assert got == {1: ("kept", None, None), 2: ("duplicate", 1, "hash"), 3: ("duplicate", 1, "cosmetic"), 4: ("kept", None, None), 5: ("duplicate", 4, "hash")}
    sources = spark.createDataFrame([("a", "normalised", False), ("b", "normalised", False), ("c", "packed", False), ("d", "normalised", True)], "source_id string, status string, unreadable boolean")
    compared = spark.createDataFrame([("b",)], "source_id string")
    base, new = D.new_against_base(sources, compared)
    assert {r["source_id"] for r in base.collect()} == {"b", "c"} and {r["source_id"] for r in new.collect()} == {"a"}
    decisions = spark.createDataFrame([("b", "duplicate", "a"), ("c", "review", "a")], "source_id string, status string, main_id string")
    assert {r["source_id"]: r["status"] for r in D.apply_decisions(sources, decisions).collect()} == {"a": "normalised", "b": "duplicate", "c": "packed", "d": "normalised"}
    left, rest = D.release(D.apply_decisions(sources, decisions).drop("duplicate_of"), decisions, spark.createDataFrame([("a",)], "source_id string"))
    assert {r["source_id"]: r["status"] for r in left.collect()} == {"b": "normalised", "c": "packed", "d": "normalised"} and rest.count() == 0
    left, rest = D.invalidate(compared, decisions, compared)
    assert left.count() == 0 and rest.count() == 1
