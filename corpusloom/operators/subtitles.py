"""Subtitles and transcripts: cues, cleaning, paragraphs, quality."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.functions.text import cosmetic_form, subtitle_seconds, timecode
from corpusloom.operators.chunks import CHUNK, NTH, chunked, listed
from corpusloom.session import stash

#: Lengths at which a paragraph may and must end, words of a sound label.
CLOSE, MUST_CLOSE, LABEL_WORDS = 350, 1200, 3
#: Segments of a source that a task folds at once.
SEGMENTS = 4096
_BRACKET = re.compile(r"\[[^\]]*\]|\([^)]*\)")
_CUE = "^((?:\\d+:)?\\d{1,2}:\\d{2}[.,]\\d{1,3})[ \\t]*-->"


def cues(files: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, pos, start_s, text`` from SRT or VTT texts: blocks between blank lines with a time line anywhere in them."""
    parts = files.select(key, F.posexplode(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\\r\\n?", "\n"), "\\n[ \\t]*\\n")).alias("pos", "block"))
    lines = F.split("block", "\n")
    at = F.array_position(F.transform(lines, lambda x: F.trim(x).rlike(_CUE)), True).cast("int")
    rows = parts.withColumn("at", at).where("at > 0")
    body = F.array_join(F.filter(F.transform(F.slice(lines, F.col("at") + 1, F.size(lines)), F.trim), lambda x: x != ""), " ")
    return rows.select(key, "pos", subtitle_seconds(F.regexp_extract(F.trim(F.element_at(lines, F.col("at"))), _CUE, 1)).alias("start_s"), body.alias("text")).where("start_s is not null")


def skipped_blocks(files: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, skipped``: blocks without a time line, but for headers, notes and styles."""
    parts = files.select(key, F.explode(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\\r\\n?", "\n"), "\\n[ \\t]*\\n")).alias("block"))
    odd = (F.trim("block") != "") & ~F.col("block").rlike("(?m)" + _CUE) & ~F.trim("block").rlike("^(WEBVTT|NOTE|STYLE|REGION)")
    return parts.groupBy(key).agg(F.count_if(odd).alias("skipped"))


def json3_segments(tracks: DataFrame, key: str = "video_id", body: str = "body") -> DataFrame:
    """``key, pos, start_s, text`` from JSON subtitle events."""
    schema = "struct<events:array<struct<tStartMs:double,segs:array<struct<utf8:string>>>>>"
    events = tracks.select(key, F.posexplode(F.from_json(body, schema)["events"]).alias("pos", "event"))
    text = F.array_join(F.transform(F.col("event.segs"), lambda s: s["utf8"]), "")
    rows = events.select(key, "pos", (F.coalesce("event.tStartMs", F.lit(0.0)) / 1000).alias("start_s"), F.trim(F.regexp_replace(text, "\\s+", " ")).alias("text"))
    return rows.where("text <> ''")


def is_label(inside: str, whole: bool) -> bool:
    """Whether what stands in brackets is a sound label: never with a digit; a whole segment; else short and no sentence."""
    if any(c.isdigit() for c in inside):
        return False
    return whole or (len(inside.split()) <= LABEL_WORDS and not any(c in inside for c in ".!?…"))


def clean_segment(text: str) -> str:
    plain = re.sub(r"<[^>]*>", " ", text)
    whole = plain.strip()
    plain = _BRACKET.sub(lambda m: " " if is_label(m[0][1:-1].strip(), m[0] == whole) else m[0], plain)
    return " ".join(re.sub("[♪♫]", " ", plain).split())


class Fold:
    """The open paragraph of ordered segments: its words, where it starts, and the segment that closes it."""

    def __init__(self, text: str | None = None, start: float = 0.0):
        self.words, self.start = text.split(" ") if text else [], start

    def add(self, at: float, text: str | None) -> tuple[float, str] | None:
        """The paragraph that this segment closes, if it does; words that repeat the paragraph's end are left out."""
        new = clean_segment(text or "").split()
        overlap = next((n for n in range(min(len(self.words), len(new)), 0, -1) if self.words[-n:] == new[:n]), 0)
        new = new[overlap:]
        if not new:
            return None
        self.start = self.start if self.words else at
        self.words += new
        size = sum(map(len, self.words)) + len(self.words) - 1
        if size >= MUST_CLOSE or size >= CLOSE and self.words[-1][-1] in ".!?…:":
            return self.close()
        return None

    def close(self) -> tuple[float, str] | None:
        found = (self.start, " ".join(self.words)) if self.words else None
        self.words, self.start = [], 0.0
        return found


def fold_paragraphs(segments: Iterable[tuple[float, str]]) -> Iterator[tuple[float, str]]:
    """Paragraphs (start, text) of ordered segments."""
    fold = Fold()
    for at, text in segments:
        if closed := fold.add(at, text):
            yield closed
    if closed := fold.close():
        yield closed


def _folded(rows: pa.Table, handed: pa.Table) -> tuple[list[tuple[float, str]], Fold]:
    """The paragraphs that close in a chunk, and what stays open at its end."""
    fold = Fold(handed["open"][0].as_py(), handed["open_start"][0].as_py() or 0.0)
    rows = rows.sort_by(NTH)
    closed = [fold.add(at, text) for at, text in zip(rows["start_s"].to_pylist(), rows["text"].to_pylist())]
    return [c for c in closed if c], fold


def _ends(rows: pa.Table, handed: pa.Table) -> pa.Table:
    closed, fold = _folded(rows, handed)
    left = " ".join(fold.words) or None
    columns = [handed["chunk"], handed["open"], handed["open_start"], pa.array([left], pa.string()), pa.array([fold.start if left else None], pa.float64()), pa.array([len(closed)], pa.int64())]
    return pa.Table.from_arrays(columns, ["chunk", "open", "open_start", "left", "left_start", "closed"])


_ENDS = "chunk long, open string, open_start double, left string, left_start double, closed long"


def paragraphs(segments: DataFrame, key: str = "source_id", chunk: int = SEGMENTS) -> DataFrame:
    """``key, no, start_s, text``: paragraphs of each source's segments ``(key, pos, start_s, text)``; ``pos`` is unique in a source.

    Long sources are folded in chunks of ``chunk`` segments, each as if a
    paragraph began there.  A chunk that is handed an open paragraph is folded
    again; as paragraphs soon end at the same segment whatever came before, what
    it leaves open rarely changes, and the rounds end when nothing does.  No task
    reads a source.
    """
    rows = chunked(segments.select(key, "pos", F.col("start_s").cast("double").alias("start_s"), "text"), key, ["pos"], chunk, "segments")
    chunks = stash(listed(rows, key), "listed")
    nothing = chunks.select("chunk", F.lit(None).cast("string").alias("open"), F.lit(None).cast("double").alias("open_start"))
    ahead = Window.partitionBy("of").orderBy("chunk")
    if chunks.groupBy("of").count().where("count > 1").isEmpty():
        handed = nothing.withColumns({"done": F.lit(0).cast("long"), "ends": F.lit(True)})
    else:
        fold = lambda some, given: some.groupBy(CHUNK).cogroup(given.groupBy("chunk")).applyInArrow(_ends, _ENDS)
        ends = stash(fold(rows, nothing), "ends")
        while True:
            before = ends.join(chunks, "chunk").withColumns({"given": F.lag("left").over(ahead), "given_start": F.lag("left_start").over(ahead)})
            changed = before.where(~F.col("given").eqNullSafe(F.col("open")) | ~F.col("given_start").eqNullSafe(F.col("open_start")))
            changed = stash(changed.select("chunk", F.col("given").alias("open"), F.col("given_start").alias("open_start")), "changed")
            if changed.isEmpty():
                break
            again = fold(rows.join(changed.select(F.col("chunk").alias(CHUNK)), CHUNK, "left_semi"), changed)
            ends = stash(ends.join(changed.select("chunk"), "chunk", "left_anti").unionByName(again), "ends")
        done = F.coalesce(F.sum("closed").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        handed = ends.join(chunks, "chunk").select("chunk", "open", "open_start", done.alias("done"), F.lead("chunk").over(ahead).isNull().alias("ends"))
        handed = stash(handed, "handed")
    kinds = (to_arrow_type(segments.schema[key].dataType), pa.int32(), pa.float64(), pa.string())

    def run(some: pa.Table, given: pa.Table) -> pa.Table:
        found, open_one = _folded(some, given)
        if given["ends"][0].as_py() and (last := open_one.close()):
            found.append(last)
        of, first = some[key][0].as_py(), given["done"][0].as_py() + 1
        columns = list(zip(*((of, first + i, start, text) for i, (start, text) in enumerate(found)))) or [()] * 4
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [key, "no", "start_s", "text"])

    return rows.groupBy(CHUNK).cogroup(handed.groupBy("chunk")).applyInArrow(run, f"{key} {segments.schema[key].dataType.simpleString()}, no int, start_s double, text string")


def written(paras: DataFrame, key: str = "source_id", marks: bool = False, lengths: DataFrame | None = None) -> DataFrame:
    """``key, text``: paragraphs with blank lines between, with timecodes if wanted, in one form for each source."""
    rows = paras
    if marks:
        last = paras.groupBy(key).agg(F.max("start_s").alias("length_s")) if lengths is None else lengths.select(key, "length_s")
        rows = rows.join(last, key).withColumn("text", F.concat(timecode("start_s", F.col("length_s") >= 3600), F.lit(" "), F.col("text")))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


#: How credits of translators and subtitle makers begin.
CREDITS = r"(?iU)^\s*(?:tłumaczenie\s*:|korekta\s*:|napisy\s*:|opracowanie\s*:|translated\s+by|reviewed\s+by|subtitles\s+by|captions\s+by)"


def without_credits(segments: DataFrame, key: str = "source_id", edge: int = 4, pattern: str = CREDITS) -> DataFrame:
    """Segments without credits among the first and last ``edge`` of each source.

    Tracks that were made by a machine have none: if there is a column
    ``generated``, its rows stay where it is true.
    """
    up, down = Window.partitionBy(key).orderBy("pos"), Window.partitionBy(key).orderBy(F.desc("pos"))
    made_by_hand = ~F.coalesce("generated", F.lit(False)) if "generated" in segments.columns else F.lit(True)
    at_edge = (F.row_number().over(up) <= edge) | (F.row_number().over(down) <= edge)
    return segments.withColumn("_gone", at_edge & made_by_hand & F.coalesce(F.col("text").rlike(pattern), F.lit(False))).where("not _gone").drop("_gone")


def quality(segments: DataFrame, key: str = "source_id", repeats: int = 3, share: float = 0.3, least: int = 3) -> DataFrame:
    """``key, n_segments, most_repeated, uncertain_share, reasons``: phrases said over and over, and uncertain ones.

    Counts per phrase come first, so a phrase in a third of all rows is one
    partial sum in each task.
    """
    uncertain = F.col("uncertain") if "uncertain" in segments.columns else F.lit(False)
    rows = segments.select(key, cosmetic_form(F.coalesce("text", F.lit(""))).alias("phrase"), uncertain.alias("uncertain"))
    by_phrase = rows.groupBy(key, "phrase").agg(F.count(F.lit(1)).alias("n"), F.count_if("uncertain").alias("u"))
    out = by_phrase.groupBy(key).agg(F.sum("n").alias("n_segments"), F.max(F.when(F.col("phrase") != "", F.col("n"))).alias("most_repeated"), F.sum("u").alias("u"))
    out = out.withColumn("most_repeated", F.coalesce("most_repeated", F.lit(0).cast("long"))).withColumn("uncertain_share", F.col("u") / F.col("n_segments"))
    checks = F.array(F.when(F.col("most_repeated") >= repeats, "repeated"), F.when((F.col("n_segments") >= least) & (F.col("uncertain_share") > share), "uncertain"))
    return out.withColumn("reasons", F.array_compact(checks)).drop("u")


def uncertain(logprob: Column, no_speech: Column, least: float = -1.0, most: float = 0.6) -> Column:
    """Whether a recognised segment is uncertain."""
    return (logprob < least) | (no_speech > most)
