"""Duplicates and what to review: hash, cosmetic key, similarity, and leader clustering.

Sources are settled in order: one that is certainly like an earlier leader is
its duplicate, all others become leaders.  The sequential rule is computed in
rounds over tables: whoever has a leader among its earlier certain neighbours
is a duplicate; whoever has no undecided one left is a leader.

Equal texts, equal cosmetic keys and equal fingerprints of long texts are never
paired: a class of equals acts through its first leader and its first undecided
member, and so do classes of fingerprints that are near each other.  A pair of
classes is one row, whatever their sizes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

try:
    from _md5 import md5  # Python's own takes a third of OpenSSL's time for a few words
except ImportError:
    from hashlib import md5

from corpusloom.config import Config
from corpusloom.functions.text import content_hash, cosmetic_key, word_count, word_list
from corpusloom.operators.similarity import blocked_pairs, hamming, ratio, reach, review_pairs, ring_pairs, short_pairs
from corpusloom.session import discard, forget, scratch, stash

__all__ = ["blocked_pairs", "deduplicate", "exact_and_cosmetic", "hamming", "ratio", "review_pairs", "ring_pairs", "short_pairs", "shingles", "simhash"]


def shingles(text: str | Column, size: int = 3) -> Column:
    """Overlapping word n-grams, repeats included; of fewer words all of them, of none none."""
    words = word_list(text)
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, size), " "))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(many)


def simhash(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, digest: str = "blake2b", more: tuple[str, ...] = ()) -> DataFrame:
    """``key, simhash`` (64 bits as a signed number), and columns ``more``: a bit is set where its weight is above zero; 0 for no words.

    ``digest`` is blake2b (8 bytes) or md5 (its first 8 bytes, which SQL can check).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blake = lambda s: hashlib.blake2b(s, digest_size=8).digest()
        first8 = lambda s: md5(s, usedforsecurity=False).digest()[:8]
        hashed = blake if digest == "blake2b" else first8
        for batch in batches:
            out = []
            for value in batch["text"]:
                words = [w for w in "\n".join((value.as_py() or "").split()).encode().split(b"\n") if w]
                lines = list(map(b" ".join, zip(*(words[i:] for i in range(size))))) if len(words) > size else [b" ".join(words)] * bool(words)
                weights = np.zeros(64, np.int64)
                for i in range(0, len(lines), 65536):
                    part = np.frombuffer(b"".join(map(hashed, lines[i : i + 65536])), np.uint8).reshape(-1, 8)
                    weights += 2 * np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64) - len(part)
                out.append(int(np.packbits(weights > 0).view(">i8")[0]))
            yield pa.RecordBatch.from_arrays([batch[key], pa.array(out, pa.int64()), *(batch[c] for c in more)], [key, "simhash", *more])

    schema = ", ".join([f"{key} {docs.schema[key].dataType.simpleString()}", "simhash long", *(f"{c} {docs.schema[c].dataType.simpleString()}" for c in more)])
    return docs.select(key, F.col(text).alias("text"), *more).mapInArrow(run, schema)


def profiles(docs: DataFrame, config: Config, key: str = "doc_id", text: str = "text", digest: str = "blake2b") -> DataFrame:
    """``key, n_words, n_chars, content_hash, cosmetic_key, simhash`` of each source; hash and key are binary."""
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = rows.select(key, "text", word_count("text").alias("n_words"), F.length("text").cast("long").alias("n_chars"), F.unhex(content_hash("text")).alias("content_hash"), F.unhex(cosmetic_key("text")).alias("cosmetic_key"))
    more = ("n_words", "n_chars", "content_hash", "cosmetic_key")
    return simhash(out, key, "text", config.shingle, digest, more) if config.stage_similarity else out.select(key, F.lit(0).cast("long").alias("simhash"), *more)


def deduplicate(docs: DataFrame, config: Config | None = None, base: DataFrame | None = None, key: str = "doc_id", text: str = "text", digest: str = "blake2b") -> DataFrame:
    """Decisions ``key, status, main_id, method, score`` for each source of ``docs``; keys are unique.

    ``status`` is kept, duplicate or review.  Sources of ``base`` are leaders
    from the start, come first and are never duplicates.  A duplicate's
    ``main_id`` is the first leader it is certainly like; a review case's is
    its most similar earlier leader (ties: the earliest).  ``digest`` makes the
    fingerprints.
    """
    config, spark = config or Config(), docs.sparkSession
    with scratch(spark) as keep:
        both, texts = profiles(docs, config, key, text, digest).withColumn("new", F.lit(True)), docs.select(key, F.col(text).alias("text"), F.lit(True).alias("new"))
        if base is not None:
            both = both.unionByName(profiles(base, config, key, text, digest).withColumn("new", F.lit(False)))
            texts = texts.unionByName(base.select(key, F.col(text).alias("text"), F.lit(False).alias("new")))
        # the place: base before new, then by key; ranges of a sort give consecutive numbers without one big task
        made = stash(both, "profiles")
        ordered = made.repartitionByRange("new", key).sortWithinPartitions("new", key).withColumn("place", F.monotonically_increasing_id())
        every = placed = stash(ordered, "places")
        discard(made)
        if config.stage_hash:
            # equal texts have equal neighbours: only the first new one and the first base one are settled, the others follow
            head = placed.groupBy("content_hash", "new").agg(F.min("place").alias("head"))
            every = stash(placed.join(head, ["content_hash", "new"]), "heads")
            discard(placed)
        every = keep(every) if config.stage_hash else keep(placed).withColumn("head", F.col("place"))
        fingerprint = F.when(F.col("n_words") >= config.short_words, F.col("simhash")).alias("print")
        rows = every.where("place = head").select("place", key, "new", "n_words", "n_chars", "content_hash", "cosmetic_key", fingerprint if config.stage_similarity else F.lit(None).cast("long").alias("print"))
        near, short = _near(rows, config), _short(rows, texts, config, key)
        sure = stash(near.where("certain"), "near-certain")  # each round reads these, and not the many others
        forget(spark)
        classes = ["content_hash"] * config.stage_hash + ["cosmetic_key"] * config.stage_cosmetic + ["print"] * config.stage_similarity
        state = stash(rows.select("place", *classes, F.when(F.col("new"), "open").otherwise("leader").alias("status")), "state")
        while not state.where("status = 'open'").isEmpty():
            before, state = state, stash(_round(state, sure, short.where("certain"), classes), "state")
            discard(before)
            forget(spark)
        settled = keep(stash(_settled(rows, state, near, short, classes), "settled"))
    own = every.where("new and place = head").select("place", key).join(settled, "place")
    copies = every.where("new and place <> head").select(key, F.col("head").alias("place")).join(settled, "place")
    led = F.col("status") == "duplicate"
    copies = copies.select(
        "place", key, F.lit("duplicate").alias("status"), F.when(led, F.col("leader")).otherwise(F.col("place")).alias("leader"),
        F.when(led, F.col("method")).otherwise("hash").alias("method"), F.when(led, F.col("score")).otherwise(1.0).alias("score"),
    )
    names = every.select(F.col("place").alias("leader"), F.col(key).alias("main_id"))
    found = own.select("place", key, "status", "leader", "method", "score").unionByName(copies).join(names, "leader", "left")
    return found.select(key, "status", "main_id", "method", F.bround("score", 4).alias("score"))


def _near(rows: DataFrame, config: Config) -> DataFrame:
    """``print, other, score, certain``: different fingerprints of long texts that are similar, in both directions."""
    if not config.stage_similarity:
        return rows.sparkSession.createDataFrame([], "print long, other long, score double, certain boolean")
    far = math.floor(64 * (1 - config.review) + 1e-9)
    prints = rows.where("print is not null").select(F.col("print").alias("simhash")).distinct()
    pairs = ring_pairs(prints, far).distinct() if far < 8 else review_pairs(prints, far)
    both = pairs.select(F.col("a").alias("print"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("print"), F.col("a").alias("other")))
    score = 1 - hamming(F.col("print"), F.col("other")) / 64
    return stash(both.select("print", "other", score.alias("score"), (score >= config.duplicate).alias("certain")), "near")


def _short(rows: DataFrame, texts: DataFrame, config: Config, key: str) -> DataFrame:
    """``a, b, score, certain``: places ``a < b`` of similar texts, one of them short; pairs of two base sources do not count."""
    if not config.stage_similarity:
        return rows.sparkSession.createDataFrame([], "a long, b long, score double, certain boolean")
    # few texts are in reach of a short one; only these are joined and compared
    most = rows.where(F.col("n_words") < config.short_words).agg(F.max("n_chars").alias("n")).first()["n"]
    limit = -1 if most is None else reach(most, config.review)
    near = rows.where(F.col("n_chars") <= limit).select("place", key, "new")
    own = texts.withColumn("text", F.coalesce("text", F.lit(""))).where(F.length("text") <= limit)
    found = short_pairs(stash(near.join(own, [key, "new"]).select("place", "text"), "short-texts"), config.review, config.short_words)
    new = rows.where("new").select(F.col("place").alias("b"))
    return stash(found.join(new, "b", "left_semi").select("a", "b", "score", (F.col("score") >= config.duplicate).alias("certain")), "short")


def _firsts(state: DataFrame, column: str) -> DataFrame:
    """The first leader and the first undecided member of each class."""
    first = lambda status: F.min(F.when(F.col("status") == status, F.col("place")))
    return state.where(F.col(column).isNotNull()).groupBy(column).agg(first("leader").alias("leader"), first("open").alias("open"))


def _round(state: DataFrame, near: DataFrame, short: DataFrame, classes: list[str]) -> DataFrame:
    """One round: open sources with an earlier leader become duplicates, those without an earlier open neighbour leaders."""
    of = short.join(state.select(F.col("place").alias("a"), F.col("status").alias("of")), "a")
    first = lambda status: F.min(F.when(F.col("of") == status, F.col("a")))
    tables = [("place", of.groupBy(F.col("b").alias("place")).agg(first("leader").alias("leader"), first("open").alias("open")))]
    tables += [(c, _firsts(state, c)) for c in classes]
    if "print" in classes:
        around = near.join(_firsts(state, "print").withColumnRenamed("print", "other"), "other")
        tables.append(("print", around.groupBy("print").agg(F.min("leader").alias("leader"), F.min("open").alias("open"))))
    out, led, waits = state, F.lit(False), F.lit(False)
    for i, (c, table) in enumerate(tables):
        out = out.join(table.withColumnsRenamed({"leader": f"leader{i}", "open": f"open{i}"}), c, "left")
        led = led | F.coalesce(F.col(f"leader{i}") < F.col("place"), F.lit(False))
        waits = waits | F.coalesce(F.col(f"open{i}") < F.col("place"), F.lit(False))
    status = F.when(F.col("status") != "open", F.col("status")).when(led, "duplicate").when(waits, "open").otherwise("leader")
    return out.select("place", *classes, status.alias("status"))


def _settled(rows: DataFrame, state: DataFrame, near: DataFrame, short: DataFrame, classes: list[str]) -> DataFrame:
    """``place, status, leader, method, score`` of what is decided."""
    leaders, duplicates = state.where("status = 'leader'"), state.where("status = 'duplicate'")
    firsts = {c: leaders.groupBy(c).agg(F.min("place").alias("leader")).where(F.col(c).isNotNull()) for c in classes}
    # the first leader that each duplicate is certainly like
    hits = [short.where("certain").select("a", F.col("b").alias("place")).join(duplicates.select("place"), "place").join(leaders.select(F.col("place").alias("a")), "a").select("place", F.col("a").alias("leader"))]
    hits += [duplicates.join(firsts[c], c).select("place", "leader") for c in classes]
    if "print" in classes:
        around = near.join(firsts["print"].withColumnRenamed("print", "other"), "other").select("print", "leader", "score", "certain")
        around = stash(around, "around")
        hits.append(duplicates.join(around.where("certain").groupBy("print").agg(F.min("leader").alias("leader")), "print").select("place", "leader"))
    main = reduce(DataFrame.unionByName, hits).where("leader < place").groupBy("place").agg(F.min("leader").alias("leader"))
    keys = rows.select("place", "print", "content_hash", "cosmetic_key")
    of_leader = keys.select(F.col("place").alias("leader"), *[F.col(c).alias(f"main_{c}") for c in ("print", "content_hash", "cosmetic_key")])
    sure = main.join(keys, "place").join(of_leader, "leader").join(short.select(F.col("a").alias("leader"), F.col("b").alias("place"), "score"), ["leader", "place"], "left")
    long = F.col("print").isNotNull() & F.col("main_print").isNotNull()
    method, score = F.when(long, "simhash").otherwise("sequence"), F.when(long, 1 - hamming(F.col("print"), F.col("main_print")) / 64).otherwise(F.col("score"))
    for c in ("cosmetic_key", "content_hash"):
        if c in classes:
            equal = F.col(c) == F.col(f"main_{c}")
            method, score = F.when(equal, {"content_hash": "hash", "cosmetic_key": "cosmetic"}[c]).otherwise(method), F.when(equal, 1.0).otherwise(score)
    sure = sure.select("place", F.lit("duplicate").alias("status"), "leader", method.alias("method"), score.alias("score"))
    # the best weak hit of each leader among earlier ones
    weak = [short.where("not certain").join(leaders.select(F.col("place").alias("a")), "a").select(F.col("b").alias("place"), F.col("a").alias("leader"), "score", F.lit("sequence").alias("method"))]
    if "print" in classes:
        weak.append(leaders.select("place", "print").join(around.where("not certain"), "print").where("leader < place").select("place", "leader", "score", F.lit("simhash").alias("method")))
    best = reduce(DataFrame.unionByName, weak).groupBy("place").agg(F.max(F.struct("score", (-F.col("leader")).alias("first"), "method")).alias("best"))
    best = best.select("place", (-F.col("best.first")).alias("leader"), "best.score", "best.method")
    rest = leaders.select("place").join(best, "place", "left")
    rest = rest.select("place", F.when(F.col("leader").isNull(), "kept").otherwise("review").alias("status"), "leader", "method", "score")
    return sure.unionByName(rest)


def exact_and_cosmetic(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, status, main_id, method`` by hash and cosmetic key only; the first of equal keys leads.

    Equal texts have equal keys, so one minimum by cosmetic key decides; it is
    aggregated and joined back rather than windowed, so that hot keys spread.
    """
    rows = stash(docs.select(key, content_hash(F.coalesce(text, F.lit(""))).alias("content_hash"), cosmetic_key(F.coalesce(text, F.lit(""))).alias("cosmetic_key")), "keys")
    first = rows.groupBy("cosmetic_key").agg(F.min(F.struct(key, "content_hash")).alias("first"))
    out = rows.join(first, "cosmetic_key")
    dup = F.col(key) != F.col(f"first.{key}")
    return out.select(
        key, F.when(dup, "duplicate").otherwise("kept").alias("status"), F.when(dup, F.col(f"first.{key}")).alias("main_id"),
        F.when(dup, F.when(F.col("content_hash") == F.col("first.content_hash"), "hash").otherwise("cosmetic")).alias("method"),
    )


def new_against_base(sources: DataFrame, compared: DataFrame, key: str = "source_id") -> tuple[DataFrame, DataFrame]:
    """Base (packed or compared before) and new (normalised, not compared) sources; unreadable scans are in neither."""
    readable = sources.where("not coalesce(unreadable, false)")
    done = readable.join(compared.select(key), key, "left_semi")
    packed = readable.where("status = 'packed'").join(compared.select(key), key, "left_anti")
    return done.unionByName(packed), readable.where("status = 'normalised'").join(compared.select(key), key, "left_anti")


def apply_decisions(sources: DataFrame, decisions: DataFrame, key: str = "source_id") -> DataFrame:
    """Sources with their new status; duplicates name their main source, review cases stay."""
    found = decisions.where("status = 'duplicate'").select(key, F.col("main_id").alias("duplicate_of"))
    out = sources.join(found, key, "left")
    return out.withColumn("status", F.when(F.col("duplicate_of").isNotNull(), "duplicate").otherwise(F.col("status")))


def invalidate(compared: DataFrame, decisions: DataFrame, changed: DataFrame, key: str = "source_id") -> tuple[DataFrame, DataFrame]:
    """Changed sources are compared anew: they leave both tables."""
    return compared.join(changed.select(key), key, "left_anti"), decisions.join(changed.select(key), key, "left_anti")


def release(sources: DataFrame, decisions: DataFrame, removed: DataFrame, key: str = "source_id") -> tuple[DataFrame, DataFrame]:
    """Duplicates of removed sources wait again; decisions about or by removed ones go."""
    gone = removed.select(F.col(key).alias("main_id"))
    freed = decisions.where("status = 'duplicate'").join(gone, "main_id", "left_semi").select(key, F.lit(True).alias("freed"))
    left = sources.join(removed.select(key), key, "left_anti").join(freed, key, "left")
    left = left.withColumn("status", F.when(F.col("freed"), "normalised").otherwise(F.col("status"))).drop("freed")
    return left, decisions.join(gone, "main_id", "left_anti").join(removed.select(key), key, "left_anti")
