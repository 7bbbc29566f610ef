"""Language identification by Bayesian fusion of evidence.

The text's evidence is a naive Bayes model of hashed character trigrams, fitted
on a bounded sample of labelled documents.  A text, the language its markup
declares, its address suffix and its host are taken as independent given the
language:

    P(lang | all) ~ P(text | lang) P(declared | lang) P(suffix | lang) P(lang | host)

The last three are counted over all rows by grouped aggregation, with the
text's own verdict as the label.  Host priors are smoothed hierarchically: a
host's counts towards its registered domain's, these towards all rows'.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import html_extraction
from corpusloom.llm.common import scratch, stash
from corpusloom.llm.url_filters import host_and_path

#: Bound of the labelled sample that the trigram model is fitted on.
SAMPLE = 4000
BUCKETS = 1 << 16
#: Most languages of a model, the most frequent ones of the sample; with the buckets they bound what the driver fetches.
LANGUAGES = 64
UNDETERMINED = "und"
#: A text contradicts its declared language from this lead in log-likelihood on (some fifty letters of another language).
MARGIN = 8.0
#: Neighbouring trigrams share letters, so a text's log-likelihood counts by this much.
TEMPER = 0.25
#: Pseudo-counts of the tables for declared languages and suffixes, and of host priors.
SMOOTH, HOST = 1.0, 10.0
_CHUNK = 1 << 20


def trigrams(text: str) -> np.ndarray:
    """Buckets of the letter trigrams of a text; runs of anything else are one blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    if not len(points):
        return np.empty(0, np.int64)
    letters = (points >= 97) & (points <= 122) | (points >= 0xAA)
    points = np.where(letters, points, 32)
    keep = np.concatenate(([True], (points[1:] != 32) | (points[:-1] != 32)))
    points = np.concatenate(([32], points[keep], [32])).astype(np.uint64)
    grams = points[:-2] * np.uint64(0x9E3779B1) + points[1:-1] * np.uint64(0x85EBCA6B) + points[2:] * np.uint64(0xC2B2AE35)
    letters = points[1:-1] != 32
    return (((grams ^ (grams >> np.uint64(15))) * np.uint64(0x27D4EB2F)) >> np.uint64(12) & np.uint64(BUCKETS - 1))[letters].astype(np.int64)


class Model:
    """Log-probabilities of buckets for each language and, last, for what is none of them."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        sums = counts.sum(axis=1, keepdims=True)
        known = np.log((counts + 0.1) / (sums + 0.1 * BUCKETS))
        # no language: any bucket is as likely as another, with some room for chance
        other = np.full((1, BUCKETS), math.log(1 / BUCKETS) + 1.0)
        self.table = np.concatenate((known, other)).astype(np.float32)

    def text(self, text: str | None) -> list[float]:
        """Tempered log-likelihood of a text for each language and for none; all zero if it has no letters."""
        at = trigrams(text or "")
        total = np.zeros(len(self.table))
        for i in range(0, len(at), _CHUNK):
            total += self.table[:, at[i : i + _CHUNK]].sum(axis=1, dtype=np.float64)
        return (TEMPER * total).tolist()


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """The trigram model of ``labelled(doc_id, text, lang)``: of the ``sample`` rows with the least hash of ``doc_id``, whole texts.

    Languages beyond the ``LANGUAGES`` most frequent ones of the sample are not
    modelled.  An empty table gives a model of no language.
    """
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    chosen = rows.orderBy("h", "doc_id").limit(sample).select("doc_id").distinct()
    texts = labelled.where("lang is not null and text is not null").select("doc_id", F.lower("lang").alias("lang"), "text").join(F.broadcast(chosen), "doc_id")
    common = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).select("lang")
    texts = texts.join(F.broadcast(common), "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
                if lang not in sums:
                    sums[lang] = np.zeros(BUCKETS, np.int64)
                np.add.at(sums[lang], trigrams(text.as_py()), 1)
        for lang, values in sums.items():
            at = np.flatnonzero(values)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(values[at])], ["lang", "bucket", "n"])

    found = texts.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    counts = np.zeros((len(languages), BUCKETS))
    for i, lang in enumerate(languages):
        part = found[found["lang"] == lang]
        counts[i, part["bucket"].to_numpy()] = part["n"].to_numpy()
    return Model(languages, counts)


def _score(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` without ``text``, with ``logs``: the text's evidence."""
    names = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs = pa.array([model.text(t.as_py()) for t in batch["text"]], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), logs], [*names, "logs"])

    schema = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    return rows.mapInArrow(run, f"{schema}, logs array<double>")


def _best(logs: Column, names: Column) -> Column:
    """The name of the greatest value, the first of equal ones."""
    return F.element_at(names, F.array_position(logs, F.array_max(logs)).cast("int"))


def _evidence(scored: DataFrame, by: list[str], names: list[str], name: str) -> DataFrame:
    """Counts of the texts' verdicts by ``by``, as one array in the order of ``names``."""
    rows = scored.groupBy(*by).agg(*[F.count_if(F.col("verdict") == n).alias(f"n{i}") for i, n in enumerate(names)])
    return rows.select(*by, F.array(*[F.col(f"n{i}").cast("double") for i in range(len(names))]).alias(name))


def identify(rows: DataFrame, model: Model, key: list[str]) -> DataFrame:
    """The ``key`` columns and ``lang, confidence, text_lang, margin, declared, suffix, host`` for each row.

    ``rows`` has ``key``'s columns and ``text, declared, suffix, host``; null evidence tells
    nothing and counts as a value of its own in its table.  ``lang`` is ``und``
    where no language explains the letters; a text without letters is no evidence
    and leaves the verdict to the rest.  Ties go to the first name in the alphabet.
    ``margin`` is by how much the text's own verdict leads its declared language
    (or, if that is not modelled, the likeliest language) in log-likelihood.
    """
    names = [*model.languages, UNDETERMINED]
    listed = F.array(*map(F.lit, names))
    base = rows.select(*key, "text", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("declared", "suffix", "host")])
    scored = stash(_score(base, model).withColumn("verdict", F.when(F.array_max("logs") > F.array_min("logs"), _best(F.col("logs"), listed))).withColumn("domain", F.regexp_extract("host", r"([^.]*\.[^.]*)$", 1)), "scored")
    k = float(len(names))
    every = [float(r or 0) for r in scored.agg(*[F.sum((F.col("verdict") == n).cast("long")) for n in names]).first()]
    whole = F.array(*[F.lit((n + 1) / (sum(every) + k)) for n in every])
    # P(value | lang) of declared languages and suffixes; languages that some value never meets keep a pseudo-count
    per_lang = F.array(*[F.lit(n + SMOOTH * 50) for n in every])
    likely = lambda c: F.zip_with(c, per_lang, lambda a, b: F.log((a + SMOOTH) / b))
    declared = _evidence(scored, ["declared"], names, "n").select("declared", likely(F.col("n")).alias("by_declared"))
    suffix = _evidence(scored, ["suffix"], names, "n").select("suffix", likely(F.col("n")).alias("by_suffix"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    smooth = lambda counts, prior: F.zip_with(counts, prior, lambda a, p: (a + HOST * p) / (total(counts) + HOST))
    domains = _evidence(scored, ["domain"], names, "of_domain").select("domain", smooth(F.col("of_domain"), whole).alias("by_domain"))
    hosts = _evidence(scored, ["host", "domain"], names, "of_host").join(domains, "domain").select("host", F.transform(smooth(F.col("of_host"), F.col("by_domain")), lambda x: F.log(x)).alias("by_host"))
    tables = [(stash(declared, "declared"), "declared"), (stash(suffix, "suffix"), "suffix"), (stash(hosts, "hosts"), "host")]
    out = scored
    for table, column in tables:
        out = out.join(table, column)
    parts = [F.col(c) for c in ("logs", "by_declared", "by_suffix", "by_host")]
    sums = parts[0]
    for part in parts[1:]:
        sums = F.zip_with(sums, part, lambda a, b: a + b)
    out = out.withColumn("all", sums).withColumn("top", F.array_max("all"))
    chance = 1 / F.aggregate(F.transform("all", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda s, x: s + x)
    of_declared = F.coalesce(F.get("logs", F.array_position(listed, F.col("declared")).cast("int") - 1), F.array_max(F.slice("logs", 1, len(model.languages))) if model.languages else F.array_max("logs"))
    return out.select(
        *key, _best(F.col("all"), listed).alias("lang"), chance.alias("confidence"), F.coalesce("verdict", F.lit(UNDETERMINED)).alias("text_lang"),
        (F.array_max("logs") - of_declared).alias("margin"), "declared", "suffix", "host",
    )


def page_rows(pages: DataFrame) -> DataFrame:
    """``page_id, text, declared, suffix, host`` of raw pages: all their blocks' text, ``<html lang>`` and the address."""
    host, _ = host_and_path()
    lang = F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), F.nullif(lang, F.lit("")).alias("declared"), "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [html_extraction.blocks(page.as_py()) for page in batch["html"]]
            article = ["\n".join(t for k, t in p if k == html_extraction.ARTICLE) or "\n".join(t for k, t in p if k == html_extraction.OPEN) for p in parsed]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["host"], batch["declared"], pa.array(article, pa.string())], ["page_id", "host", "declared", "text"])

    out = rows.mapInArrow(run, "page_id long, host string, declared string, text string")
    return out.select("page_id", "text", "declared", F.nullif(F.regexp_extract("host", r"\.([^.:]+)(?::\d*)?$", 1), F.lit("")).alias("suffix"), "host")


def identify_pages(pages: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row for each row of ``pages``, the model fitted on ``labelled`` documents."""
    return identify(page_rows(pages), fit(labelled, sample), ["page_id"])


def keep_identified(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that do not contradict their declared language; all columns.

    ``lang`` is the declared language and ``source`` the host.  Texts go that
    another language, or none (junk letters), explains better by ``MARGIN`` and
    more; so do texts without a declared language that no language explains.
    What is too short to tell, has no letters or declares a language that is
    not modelled stays.
    """
    with scratch(docs.sparkSession) as keep:
        model = fit(docs, sample)
        if not model.languages:
            return docs
        mark = F.xxhash64("text").alias("mark")
        rows = docs.select("doc_id", mark, "text", F.lower("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"))
        contradicts = F.col("declared").isin(model.languages) & (F.col("text_lang") != F.col("declared")) & (F.col("margin") >= MARGIN)
        found = identify(rows, model, ["doc_id", "mark"]).where(contradicts | (F.col("declared") == "") & (F.col("lang") == UNDETERMINED))
        bad = keep(stash(found.select(F.col("doc_id").alias("bad_id"), F.col("mark").alias("bad_mark")).distinct(), "undetermined"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_mark"]), "left_anti")
