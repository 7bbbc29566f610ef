"""Limits and thresholds with their defaults; a session's ``corpusloom.*`` settings or arguments override them."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Config:
    slots: int = 100
    words_per_file: int = 480_000
    bytes_per_file: int = 190 * 1024 * 1024
    addresses_per_file: int = 200
    stage_hash: bool = True
    stage_cosmetic: bool = True
    stage_similarity: bool = True
    duplicate: float = 0.90
    review: float = 0.75
    shingle: int = 3
    short_words: int = 60
    cache_days: int = 30
    ocr_unreadable: float = 50.0
    ocr_warning: float = 75.0
    speech_share: float = 0.5
    archive_files: int = 200
    archive_bytes: int = 500 * 1024 * 1024
    archive_ratio: int = 200
    archive_depth: int = 2

    def __post_init__(self):
        if not 0 < self.review <= self.duplicate <= 1:
            raise ValueError("thresholds must be 0 < review <= duplicate <= 1")
        if min(self.slots, self.words_per_file, self.bytes_per_file) < 1:
            raise ValueError("limits must be positive")


def from_session(spark: SparkSession, **given) -> Config:
    """Defaults, then settings ``corpusloom.<name>`` of the session, then ``given``; a bad value is an error."""
    found = {}
    for f in fields(Config):
        value = spark.conf.get(f"corpusloom.{f.name}", None)
        if value is not None:
            kind = type(f.default)
            found[f.name] = value.lower() in ("1", "true", "yes") if kind is bool else kind(value)
    return replace(Config(), **(found | given))
