"""Pairs of similar fingerprints and of similar short texts; what ``dedup`` settles by.

Fingerprints within a few bits are found by a ring of eight 8-bit segments.
Those up to 16 bits apart are found by covering masks: a pair within ``r`` bits
agrees on all bits of at least one mask of a linear code of dimension ``r + 1``
(some word of the code is zero wherever the two differ).  The halves of a
fingerprint take masks of their own, so each fingerprint makes a fixed number
of rows, whatever their number.  Blocks of fingerprints that are compared
outright give the same result; there are ``BLOCKS`` of them at most, so a
fingerprint travels ``BLOCKS + 1`` times at most, far less often.  Inside two
large blocks only fingerprints meet that are near in one of a few segments.

Short texts are compared by sequence matching.  The characters that two texts
have in common, and then their longest common subsequence, bound its ratio from
above, so few pairs reach the matcher itself.  The subsequence is bounded for
many pairs at once first: that of the whole texts is no longer than those of
what each group of characters leaves of them, taken together.
"""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import word_list
from corpusloom.session import stash

BLOCK = 2048
#: Fingerprints in a block, and blocks of them at most: what their segments save grows with a block.
PRINTS, PRINT_BLOCKS = 1 << 14, 16
#: Short texts in a block, and long ones that these are compared with.
TEXTS, LONG_TEXTS = 256, 1024
#: Blocks of a part at most; larger parts have larger blocks, so what is sent grows with the rows.
BLOCKS = 32
#: Fingerprints that are compared with one at once; they stay in a core's cache.
TILE = 1 << 16
#: Groups of characters, the bits of a row's limbs, and pairs that are bounded at once; longer texts are not bounded by groups.
GROUPS, LIMB, PAIRS, LONG = 3, 63, 1 << 12, 1 << 13
#: Generator of a cyclic code of length 31 and dimension 11 (octal, from tables of such codes); with a parity bit its words have 12 ones at least.
_CODE = 0o5423325


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def ring_pairs(prints: DataFrame, distance: int = 6, value: str = "simhash") -> DataFrame:
    """Pairs ``a < b`` of distinct fingerprints within ``distance`` bits (7 at most); a pair may repeat."""
    if not 0 <= distance < 8:
        raise ValueError("the ring of eight segments serves distances of 0 to 7")
    fp = F.col(value)
    segment = lambda i: F.shiftrightunsigned(fp, 8 * (i % 8)).bitwiseAND(F.lit(255).cast("long"))
    key = lambda i, near: F.lit(i << 16).cast("long").bitwiseOR(F.shiftleft(segment(i), 8)).bitwiseOR(near)
    flips = [0, *(1 << b for b in range(8))] if 2 * distance >= 8 else [0]
    left = prints.select(fp.alias("a"), F.explode(F.array(*[key(i, segment(i + 1)) for i in range(8)])).alias("key"))
    right = prints.select(fp.alias("b"), F.explode(F.array(*[key(i, segment(i + 1).bitwiseXOR(F.lit(f).cast("long"))) for i in range(8) for f in flips])).alias("key"))
    # Spark takes keyed sides for as small as the fingerprints, and would broadcast up to 72 rows of each through the driver
    return left.hint("merge").join(right, (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & (hamming(F.col("a"), F.col("b")) <= distance)).select("a", "b")


def covering_masks(radius: int) -> list[int]:
    """Masks of 32 bits: values within ``radius`` (0 to 10) bits of each other agree on one of them."""
    if not 0 <= radius <= 10:
        raise ValueError("masks of 32 bits serve distances of 0 to 10")
    basis = [word << 1 | word.bit_count() % 2 for word in (_CODE << k for k in range(radius + 1))]
    masks = [0]
    for word in basis:
        masks += [m ^ word for m in masks]
    return masks[1:]


def masked_pairs(prints: DataFrame, distance: int = 16, value: str = "simhash") -> DataFrame:
    """All pairs ``a < b`` of the distinct ``prints`` within ``distance`` (21 at most) bits, by covering masks; a pair may repeat.

    Of two fingerprints within ``distance`` bits the low halves are within half
    of it, or the high halves within the rest less one.
    """
    low = distance // 2
    fp = F.col(value)
    mine = covering_masks(low)
    other = covering_masks(distance - low - 1) if distance else []
    half = lambda shift: F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit(0xFFFFFFFF))

    def keys(masks: list[int], first: int, shift: int) -> Column:
        listed = F.lit(masks).cast("array<long>") if masks else F.array().cast("array<long>")
        return F.transform(listed, lambda m, i: F.shiftleft((i + first).cast("long"), 32).bitwiseOR(half(shift).bitwiseAND(m)))

    keyed = prints.select(fp.alias("a"), F.explode(F.concat(keys(mine, 0, 0), keys(other, len(mine), 32))).alias("key"))
    right = keyed.select(F.col("a").alias("b"), F.col("key").alias("other"))
    return keyed.hint("merge").join(right, (F.col("key") == F.col("other")) & (F.col("a") < F.col("b")) & (hamming(F.col("a"), F.col("b")) <= distance)).select("a", "b")


def blocked_pairs(rows: DataFrame, part: Column, found, schema: str, block: int = BLOCK, most: int | None = None) -> DataFrame:
    """Compares all rows of a part in blocks: ``found(left, right, same)`` returns the hits of two blocks as an Arrow table.

    A block holds ``block`` rows, or a share of ``BLOCKS`` (or ``most``, if that is less) of its part if that is more.
    """
    dealt = rows.withColumn("part", part).withColumn("h", F.xxhash64(*rows.columns))
    blocks = dealt.groupBy("part").agg(F.least(F.ceil(F.count(F.lit(1)) / block), F.lit(min(most or BLOCKS, BLOCKS))).cast("int").alias("blocks"))
    dealt = dealt.join(blocks, "part").withColumn("block", F.pmod("h", F.col("blocks")).cast("int"))
    one = F.lit(1)
    span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    up = F.transform(span(F.col("block"), F.col("blocks") - one), lambda x: F.struct(F.col("block").alias("i"), x.alias("j"), F.lit(True).alias("left")))
    down = F.transform(span(F.lit(0), F.col("block")), lambda x: F.struct(x.alias("i"), F.col("block").alias("j"), F.lit(False).alias("left")))
    sent = dealt.select("part", *rows.columns, F.inline(F.concat(up, down)))

    def run(table: pa.Table) -> pa.Table:
        mask = table["left"]
        return found(table.filter(mask), table.filter(pa.compute.invert(mask)), table["i"][0].as_py() == table["j"][0].as_py())

    return _dealt(sent, "part").groupBy("part", "i", "j").applyInArrow(run, schema)


def crossed_pairs(lefts: DataFrame, rights: DataFrame, part: str, found, schema: str, block: int, other: int) -> DataFrame:
    """Compares rows of ``lefts`` with all of ``rights`` in the same part, in blocks as ``blocked_pairs`` has them; both have the same columns.

    Parts that one side has no rows in are not dealt.
    """
    sizes = lefts.groupBy(part).agg(F.least(F.ceil(F.count(F.lit(1)) / block), F.lit(BLOCKS)).cast("int").alias("n"))
    sizes = sizes.join(rights.groupBy(part).agg(F.least(F.ceil(F.count(F.lit(1)) / other), F.lit(BLOCKS)).cast("int").alias("m")), part)
    own = lambda rows, n: F.pmod(F.xxhash64(*rows.columns), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sent = lefts.join(sizes, part).select(*lefts.columns, own(lefts, "n").alias("i"), every("m").alias("j"), F.lit(True).alias("left"))
    sent = sent.unionByName(rights.join(sizes, part).select(*lefts.columns, own(rights, "m").alias("j"), every("n").alias("i"), F.lit(False).alias("left")))

    def run(table: pa.Table) -> pa.Table:
        return found(table.filter(table["left"]), table.filter(pa.compute.invert(table["left"])), False)

    return _dealt(sent, part).groupBy(part, "i", "j").applyInArrow(run, schema)


def _dealt(sent: DataFrame, part: str) -> DataFrame:
    """Blocks in as many tasks as the session names: Spark would join them by their bytes, which say little of the work."""
    return sent.repartition(int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions")), part, "i", "j")


def segments(distance: int, pieces: int) -> list[tuple[int, int, int]]:
    """``shift, width, most`` of each of ``pieces`` segments of 64 bits: a pair within ``distance`` bits is within ``most`` in one of them."""
    wide, near = divmod(64, pieces), divmod(distance + 1 - pieces, pieces)
    widths = [wide[0] + (i < wide[1]) for i in range(pieces)]
    return [(sum(widths[:i]), w, near[0] + (i < near[1])) for i, w in enumerate(widths)]


def _pieces(n: int, m: int, distance: int) -> int:
    """How many segments serve best for ``n`` times ``m`` fingerprints, by what comparisons, values and values near them took in a trial; 1 is none."""

    def cost(pieces: int) -> float:
        balls = [(w, sum(math.comb(w, d) for d in range(most + 1))) for _, w, most in segments(distance, pieces)]
        return sum(min(1 << w, n) * (50_000 + 600 * ball) + 2 * n * m * ball / (1 << w) for w, ball in balls)

    return min([(2 * n * m, 1), *((cost(p), p) for p in (4, 5, 6) if distance >= p)])[1]


class _Compared:
    """Compares fingerprints outright, in buffers that stay in a core's cache."""

    def __init__(self, distance: int):
        self.distance, self.bits, self.apart, self.close = distance, np.empty(TILE, np.int64), np.empty(TILE, np.uint8), np.empty(TILE, bool)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(b), TILE):
            tile = b[at : at + TILE]
            step = TILE // len(tile)
            for first in range(0, len(a), step):
                own = a[first : first + step]
                n = len(own) * len(tile)
                np.bitwise_xor(own[:, None], tile, out=self.bits[:n].reshape(len(own), len(tile)))
                np.bitwise_count(self.bits[:n].view(np.uint64), out=self.apart[:n])
                hits = np.less_equal(self.apart[:n], self.distance, out=self.close[:n]).nonzero()[0]
                if len(hits):
                    yield own[hits // len(tile)], tile[hits % len(tile)]


def _near_in_segments(a: np.ndarray, b: np.ndarray, distance: int, pieces: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within ``distance`` bits, each once: the fingerprints of each value of a segment meet those near it in that segment."""
    parts, compared = segments(distance, pieces), _Compared(distance)
    of = lambda v, shift, width: v >> shift & (1 << width) - 1
    dealt = lambda v, *part: np.split((v := v[np.argsort(of(v, *part), kind="stable")]), np.searchsorted(of(v, *part), np.arange(1, 1 << part[1])))
    for i, (shift, width, most) in enumerate(parts):
        values = np.arange(1 << width)
        ball = values[np.bitwise_count(values) <= most]
        right = dealt(b, shift, width)
        hits = [(a[:0], b[:0])]
        for value, own in enumerate(dealt(a, shift, width)):
            if len(own):
                hits += compared.pairs(own, np.concatenate([right[near] for near in (ball ^ value).tolist()]))
        x, y = (np.concatenate(side) for side in zip(*hits))
        new = np.ones(len(x), bool)
        for earlier in parts[:i]:  # there they have met before
            new &= np.bitwise_count(of(x ^ y, *earlier[:2])) > earlier[2]
        yield x[new], y[new]


def compared_pairs(prints: DataFrame, distance: int = 16, value: str = "simhash") -> DataFrame:
    """All pairs ``a < b`` of the distinct ``prints`` within ``distance`` bits, each once, compared in blocks; only hits leave them."""

    def found(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
        a, b = left["fp"].to_numpy(), right["fp"].to_numpy()
        pieces = _pieces(len(a), len(b), distance)
        hits = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *(_near_in_segments(a, b, distance, pieces) if pieces > 1 else _Compared(distance).pairs(a, b))]
        x, y = (np.concatenate(side) for side in zip(*hits))
        keep = x < y if same else x != y
        return pa.table({"a": np.minimum(x, y)[keep], "b": np.maximum(x, y)[keep]})

    return blocked_pairs(prints.select(F.col(value).alias("fp")), F.lit(0), found, "a long, b long", PRINTS, PRINT_BLOCKS)


def review_pairs(prints: DataFrame, distance: int = 16, value: str = "simhash") -> DataFrame:
    """All pairs ``a < b`` of distinct fingerprints within ``distance`` bits, each once, compared in blocks."""
    return compared_pairs(stash(prints.select(value).distinct(), "prints"), distance, value)


def letter_counts(texts: list[str], bins: int = 64) -> np.ndarray:
    """How often characters occur in each text, by code point modulo ``bins``."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32) % bins
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return np.bincount(of * bins + points, minlength=len(texts) * bins).reshape(-1, bins).astype(np.int32)


def character_masks(text: str) -> dict[str, int]:
    """For each character of a text the places where it stands, as bits."""
    masks: dict[str, int] = {}
    for i, c in enumerate(text):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def common_subsequence(masks: dict[str, int], size: int, other: str) -> int:
    """Length of the longest common subsequence of a text of ``size`` characters, given by its ``masks``, and another, by bit-parallel rows."""
    full = (1 << size) - 1
    row = full
    for c in other:
        met = row & masks.get(c, 0)
        if met:
            row = (row + met | row - met) & full
    return size - row.bit_count()


class GroupedSubsequences:
    """Bounds for the longest common subsequences of pairs ``(texts[x], others[y])``, by bit-parallel rows of many pairs at once.

    Characters, by code point modulo 256, are dealt into ``GROUPS`` of about
    the same weight.  Inside a group rows are as long as what the group leaves
    of a text, in limbs of ``LIMB`` bits.
    """

    def __init__(self, texts: list[str], others: list[str]):
        sides = [(np.repeat(np.arange(len(side)), [len(t) for t in side]), np.frombuffer("".join(side).encode("utf-32-le"), np.uint32) % 256) for side in (texts, others)]
        weights = sum(np.bincount(points, minlength=256) for _, points in sides)
        group, number, held, ids = np.zeros(256, np.int64), np.zeros(256, np.int64), [0] * GROUPS, [0] * GROUPS
        for c in np.argsort(-weights, kind="stable").tolist():
            g = held.index(min(held))
            group[c], number[c] = g, ids[g] + 1  # no character is number 0
            held[g], ids[g] = held[g] + int(weights[c]) + 1, ids[g] + 1
        self.groups = []
        for g in range(GROUPS):
            (text, place, code, size), (other, step, met, steps) = (self._left(g, group, number, *side, len(of)) for side, of in zip(sides, (texts, others)))
            masks = np.zeros((int(size.max(initial=0)) // LIMB + 1, len(texts) * (ids[g] + 1)), np.uint64)
            np.bitwise_or.at(masks, (place // LIMB, text * (ids[g] + 1) + code), np.uint64(1) << (place % LIMB).astype(np.uint64))
            codes = np.zeros((int(steps.max(initial=0)), len(others)), np.int64)
            codes[step, other] = met
            self.groups.append((masks, ids[g] + 1, size, codes, steps))

    @staticmethod
    def _left(g: int, group: np.ndarray, number: np.ndarray, text: np.ndarray, points: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        """What a group leaves of texts: text, place in it and number of each character, and the texts' sizes."""
        own = group[points] == g
        text = text[own]
        sizes = np.bincount(text, minlength=n)
        return text, np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes), number[points[own]], sizes

    def bounds(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return sum(self._common(x, y, *group) for group in self.groups)

    @staticmethod
    def _common(x: np.ndarray, y: np.ndarray, masks: np.ndarray, ids: int, sizes: np.ndarray, codes: np.ndarray, steps: np.ndarray) -> np.ndarray:
        masks = masks[: int(sizes[x].max(initial=0)) // LIMB + 1]
        order = np.argsort(-steps[y], kind="stable")  # whose steps end first are last
        base, other = x[order] * ids, y[order]
        active = np.searchsorted(-steps[other], -np.arange(len(codes)), side="left").tolist()
        full, shift = np.uint64((1 << LIMB) - 1), np.uint64(LIMB)
        rows = np.full((len(masks), len(x)), full, np.uint64)
        for code, n in zip(codes, active):
            at, carry = base[:n] + code.take(other[:n]), None
            for mask, row in zip(masks, rows[:, :n]):
                met = mask.take(at)
                met &= row
                total = row + met
                if carry is not None:
                    total += carry
                carry = total >> shift
                row ^= met
                row |= total
                row &= full
        found = np.empty(len(x), np.int64)
        found[order] = LIMB * len(masks) - np.bitwise_count(rows).sum(axis=0, dtype=np.int64)
        return found


def ratio(first: str, second: str) -> float:
    """Similarity of two sequences of characters: twice the matches over both lengths."""
    return difflib.SequenceMatcher(None, first, second, autojunk=False).ratio() if first or second else 1.0


def reach(most: int, at_least: float) -> int:
    """The greatest length of a text that has a ``ratio`` of ``at_least`` with one of ``most`` characters."""
    return int(most * (2 / at_least - 1)) + 1


def _able(left: pa.Table, right: pa.Table, same: bool, at_least: float, short_words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of two blocks that are to meet here and whose characters allow a ratio of ``at_least``, about ``PAIRS`` at once."""
    at, texts, others = left["at"][0].as_py(), left["text"].to_pylist(), right["text"].to_pylist()
    lengths, sizes = (np.array([len(t) for t in side]) for side in (texts, others))
    places, words, bands = (right[c].to_numpy() for c in ("place", "words", "band"))
    counts, by_size = letter_counts(others), np.argsort(sizes, kind="stable")
    # long texts meet short ones only; of either, those whose lengths are in reach
    met = []
    for order in (by_size[words[by_size] < short_words], by_size):
        quotient = 2 / at_least - 1
        first, last = np.searchsorted(sizes[order], np.floor(lengths / quotient) - 1), np.searchsorted(sizes[order], np.ceil(lengths * quotient) + 1, side="right")
        met.append((order, first.tolist(), last.tolist(), np.ascontiguousarray(counts[order].T), sizes[order], words[order], bands[order], places[order]))
    held, n = [], 0
    given = list(zip(left["place"].to_pylist(), left["words"].to_pylist(), left["band"].to_pylist(), letter_counts(texts)))
    for nth, i in enumerate(np.argsort(lengths, kind="stable").tolist(), 1):  # pairs that are bounded at once have rows of about one length
        p, w, b, own = given[i]
        order, first, last, *columns = met[w < short_words]
        if first[i] < last[i]:
            letters, size, words, bands, places = (c[..., first[i] : last[i]] for c in columns)
            needed = at_least * (lengths[i] + size) / 2 - 1e-9
            able = np.flatnonzero((np.minimum(letters, own[:, None]).sum(axis=0) >= needed) & (np.minimum(bands, b) == at) & (places > p if same else places != p))
            held.append((np.full(len(able), i), order[first[i] : last[i]][able]))
            n += len(able)
        if held and (n >= PAIRS or nth == len(texts)):
            yield tuple(np.concatenate(side) for side in zip(*held))
            held, n = [], 0


def _alike(left: pa.Table, right: pa.Table, same: bool, at_least: float, short_words: int) -> Iterator[tuple[int, int, float]]:
    """``a, b, score`` of the pairs of two blocks."""
    texts, others, first, second = left["text"].to_pylist(), right["text"].to_pylist(), left["place"].to_pylist(), right["place"].to_pylist()
    n, m = (np.array([len(t) for t in side]) for side in (texts, others))
    grouped = None
    for x, y in _able(left, right, same, at_least, short_words):
        needed = at_least * (n[x] + m[y]) / 2 - 1e-9
        if len(x) and max(n.max(), m.max()) <= LONG:
            grouped = grouped or GroupedSubsequences(texts, others)
            near = grouped.bounds(x, y) >= needed
            x, y, needed = x[near], y[near], needed[near]
        of, masks = None, {}
        for i, j, least in zip(x.tolist(), y.tolist(), needed.tolist()):
            if of != i:
                of, masks = i, character_masks(texts[i])
            if common_subsequence(masks, len(texts[i]), others[j]) >= least:
                (a, s), (b, o) = sorted(((first[i], texts[i]), (second[j], others[j])))
                score = ratio(s, o)
                if score >= at_least:
                    yield a, b, score


def short_pairs(docs: DataFrame, at_least: float, short_words: int) -> DataFrame:
    """``a, b, score`` of places ``a < b``: pairs with a text of under ``short_words`` words and a ``ratio`` of ``at_least``.

    Lengths bound the ratio, so texts meet only in a band of lengths, once;
    there blocks of ``TEXTS`` are compared, with each other and with blocks of
    long texts, which do not meet among themselves.  No index on characters can do
    better: of pairs in reach by length most share one of their rarest characters.
    """
    step = math.log(2 / at_least - 1) or 1.0  # ln of the greatest quotient of lengths
    band = F.floor(F.log(F.greatest(F.length("text"), F.lit(1))) / step).cast("int")
    # a longer text also visits the band below; pairs meet in the band of the shorter one
    rows = docs.select("place", "text", F.size(word_list("text")).alias("words"), band.alias("band"))
    most = rows.where(F.col("words") < short_words).agg(F.max(F.length("text")).alias("n")).first()["n"]
    if most is None:
        return docs.sparkSession.createDataFrame([], "a long, b long, score double")
    rows = rows.where(F.length("text") <= reach(most, at_least))
    rows = rows.select("place", "text", "words", "band", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("at"))

    def found(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            out += _alike(left, right, same, at_least, short_words)
        a, b, s = zip(*out) if out else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "score": pa.array(s, pa.float64())})

    short, schema = F.col("words") < short_words, "a long, b long, score double"
    return blocked_pairs(rows.where(short), F.col("at"), found, schema, TEXTS).unionByName(crossed_pairs(rows.where(short), rows.where(~short), "at", found, schema, TEXTS, LONG_TEXTS))
