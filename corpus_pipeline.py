"""The corpus pipeline: documents in, packed sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import exact_dedup, language_id, packing, simhash, suffix_dedup
from corpusloom.llm.common import discard, stash
from corpusloom.session import forget, scratch, ship

#: The stages have no SQL form: fingerprints, trigram models and token ids are made in tasks.
ORACLE_SQL = None

def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified stay."""
    ship(spark)
    forget(spark)
    return language_id.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    ship(spark)
    forget(spark)
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles stays."""
    ship(spark)
    forget(spark)
    return simhash.keep_unlike(docs, words=5, similarity=0.8)


def strip_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long strings that occur twice go from the texts."""
    ship(spark)
    forget(spark)
    return suffix_dedup.strip_repeats(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, packed into sequences."""
    ship(spark)
    forget(spark)
    return packing.pack(docs, ids=False)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", strip_repeats),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written before the next reads it, and so is the last one's.

    What a stage writes for itself goes with its end, its result when the next
    one's is written.  The returned table belongs to this call alone.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        with scratch(spark) as keep:
            docs = keep(stash(stage(spark, docs, sf_dir), f"stage-{i}"))
        if last is not None:
            discard(last)
        last = docs
    return docs
