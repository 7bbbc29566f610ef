"""Bounds for the common subsequences of many pairs of short texts at once."""

import random

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.operators import similarity as S


def _texts(n, seed, most=400):
    rng, words = random.Random(seed), ["the", "of", "être", "schön", "漢字", "a", "reading", "ń", "\n", "😀"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, most // 6))) for _ in range(n)]
    return ["", "a", "aaaa" * 40, *texts, *(t.replace("e", "x", 3) for t in texts[: n // 4])]


@pytest.mark.parametrize("groups, limb", [(1, 63), (2, 63), (3, 7)])
def test_bounds_by_groups_are_never_too_low(groups, limb, monkeypatch):
    monkeypatch.setattr(S, "GROUPS", groups)
    monkeypatch.setattr(S, "LIMB", limb)
    a, b = _texts(25, 1), _texts(20, 2)
    x, y = (side.ravel() for side in np.indices((len(a), len(b))))
    got = S.GroupedSubsequences(a, b).bounds(x, y)
    want = np.array([S.common_subsequence(S.character_masks(a[i]), len(a[i]), b[j]) for i, j in zip(x, y)])
    assert (got >= want).all() and (groups > 1 or (got == want).all())


@pytest.mark.parametrize("long, pairs", [(1 << 13, 1 << 13), (0, 1 << 13), (1 << 13, 5)])
def test_few_pairs_are_left_for_the_exact_subsequence(long, pairs, monkeypatch):
    # each pair that its characters allowed took one in Python before
    monkeypatch.setattr(S, "LONG", long)
    monkeypatch.setattr(S, "PAIRS", pairs)
    rng, letters = random.Random(4), "etaoin shrdlu"
    texts = ["".join(rng.choices(letters, k=200)) for _ in range(60)]
    texts += [t[:150] + "".join(rng.choices(letters, k=50)) for t in texts[:10]]
    rows = pa.table({"place": range(70), "text": texts, "words": [9] * 70, "band": [3] * 70, "at": [3] * 70})
    asked, common = [], S.common_subsequence
    monkeypatch.setattr(S, "common_subsequence", lambda *a: asked.append(1) or common(*a))
    got = sorted(S._alike(rows, rows, True, 0.75, 60))
    want = sorted((i, j, r) for i in range(70) for j in range(i + 1, 70) if (r := S.ratio(texts[i], texts[j])) >= 0.75)
    assert got == want and len(want) >= 10
    assert len(asked) > 2000 if not long else len(asked) < 100


def test_long_texts_meet_short_ones_within_reach_only(monkeypatch):
    # all texts of a band were compared by their characters before, also two long ones
    rng, texts = random.Random(6), ["a b " * k for k in range(1, 90, 2)] + _texts(40, 7)
    words = [len(t.split()) for t in texts]
    rows = pa.table({"place": range(len(texts)), "text": texts, "words": words, "band": [3] * len(texts), "at": [3] * len(texts)})
    able = {(int(i), int(j)) for x, y in S._able(rows, rows, True, 0.75, 60) for i, j in zip(x, y)}
    bound = lambda i, j: np.minimum(*S.letter_counts([texts[i], texts[j]])).sum() >= 0.375 * (len(texts[i]) + len(texts[j])) - 1e-9
    assert able == {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if min(words[i], words[j]) < 60 and bound(i, j)} and len(able) > 100
    seen, minimum = [0], np.minimum
    monkeypatch.setattr(S.np, "minimum", lambda a, b: seen.__setitem__(0, seen[0] + (a.shape[1] if a.ndim == 2 else 0)) or minimum(a, b))
    long = pa.table({"place": range(50), "text": ["".join(rng.choices("abc ", k=900)) for _ in range(50)], "words": [200] * 50, "band": [3] * 50, "at": [3] * 50})
    assert list(S._able(long, long, True, 0.75, 60)) == [] and seen == [0]
