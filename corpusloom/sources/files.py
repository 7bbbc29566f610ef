"""Files as rows: folders, formats, archives, character sets, notes beside images."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.config import Config
from corpusloom.functions.text import natural_key

#: Formats by kind of source.
TEXT = "txt md json xml yaml yml toml ini cfg log srt vtt csv tsv html htm rtf musicxml".split()
DOCUMENTS = "pdf docx epub odt ods odp fodt fods fodp pptx xlsx xlsm xls doc ppt mhtml mht".split()
IMAGES = "png jpg jpeg tif tiff bmp webp gif heic heif".split()
AUDIO = "mp3 wav m4a ogg flac opus aac wma mp4 mkv webm mov avi".split()
MUSIC = "mxl mid midi gp3 gp4 gp5".split()
NOTES_SUFFIX = "_notes"

_ENTRY = "path string, status string, format string, n_bytes long, message string, content binary"


def read_folder(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """``path, name, format, n_bytes, content`` of a folder's files; hidden ones are left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select("path", name.alias("name"), format_of(name).alias("format"), F.col("length").alias("n_bytes"), "content").where(~F.col("name").startswith("."))


def format_of(name: str | Column) -> Column:
    """The lower-case suffix; null without one."""
    name = F.col(name) if isinstance(name, str) else name
    return F.nullif(F.lower(F.regexp_extract(name, "[.]([^./]+)$", 1)), F.lit(""))


def source_type(fmt: str | Column, scanned_music: bool | Column = False) -> Column:
    """text, document, image, audio or music; null for what is not supported."""
    fmt = F.col(fmt) if isinstance(fmt, str) else fmt
    music = F.lit(scanned_music) if isinstance(scanned_music, bool) else scanned_music
    return (
        F.when(music & fmt.isin("pdf", *IMAGES), "music").when(fmt.isin("musicxml", *MUSIC), "music").when(fmt.isin(*TEXT), "text")
        .when(fmt.isin(*IMAGES), "image").when(fmt.isin(*AUDIO), "audio").when(fmt.isin(*DOCUMENTS), "document")
    )


def validate(files: DataFrame, most_bytes: int = 500 * 1024 * 1024) -> DataFrame:
    """``files`` with ``type`` and ``reason`` (null: accepted): format, empty or too_large; nothing is dropped silently."""
    kind = source_type("format")
    reason = F.when(kind.isNull(), "format").when(F.coalesce("n_bytes", F.lit(0)) == 0, "empty").when((kind != "text") & (F.col("n_bytes") > most_bytes), "too_large")
    return files.withColumns({"type": kind, "reason": reason})


def decode(raw: bytes | None, charset: str | None = None) -> tuple[str | None, str | None]:
    """Text and character set: the declared one, a byte-order mark, UTF-8, else a guess; (None, None) for binary data."""
    if raw is None:
        return None, None
    marks = ((b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
    first = [charset] if charset else []
    for name in [*first, *(n for mark, n in marks if raw.startswith(mark)), "utf-8"]:
        try:
            return raw.decode(name), name
        except (UnicodeDecodeError, LookupError):
            continue
    if b"\x00" in raw[:4096]:
        return None, None
    try:
        from charset_normalizer import from_bytes
    except ImportError:
        return raw.decode("cp1250", errors="replace"), "cp1250"
    best = from_bytes(raw).best()
    return (str(best), best.encoding) if best else (None, None)


def decoded(files: DataFrame, key: str = "path", charset: str | None = None) -> DataFrame:
    """``key, text, charset`` of binary ``content``; bytes that are UTF-8 never reach Python."""
    given = F.col(charset) if charset else F.lit(None).cast("string")
    rows = files.select(key, "content", given.alias("charset"))
    plain = F.is_valid_utf8(F.col("content").cast("string")) & F.col("charset").isNull() & (F.substring("content", 1, 3) != F.lit(b"\xef\xbb\xbf"))
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [decode(c, s) for c, s in zip(batch["content"].to_pylist(), batch["charset"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch[key], pa.array([t for t, _ in found], pa.string()), pa.array([s for _, s in found], pa.string())], [key, "text", "charset"])

    ok = F.coalesce(plain, F.lit(False))
    return rows.where(ok).select(key, F.col("content").cast("string").alias("text"), F.lit("utf-8").alias("charset")).unionByName(rows.where(~ok).mapInArrow(run, f"{key} {kind}, text string, charset string"))


def _entry_problem(info: zipfile.ZipInfo, name: str) -> str | None:
    parts = name.split("/")
    if "\x00" in info.filename:
        return "bad_name"
    if name.startswith("/") or re.match(r"^[A-Za-z]:", name) or ".." in parts:
        return "unsafe_path"
    if info.flag_bits & 1:
        return "encrypted"
    if info.external_attr >> 28 == 0xA:
        return "symbolic_link"
    if any(p.startswith(".") or p in ("__MACOSX", "Thumbs.db", "desktop.ini") for p in parts):
        return "metadata"
    return "empty" if info.file_size == 0 else None


class _Breach(Exception):
    pass


def expand(raw: bytes, config: Config, depth: int = 1, prefix: str = "", state: dict | None = None) -> list[tuple]:
    """Entries (path, status, format, bytes, message, content) of an archive; a breach of a limit drops the whole archive."""
    state = state if state is not None else {"files": 0, "bytes": 0}
    rows = []
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        for info in archive.infolist():
            if info.is_dir():
                continue
            name = posixpath.normpath(info.filename.replace("\\", "/")) if ".." not in info.filename else info.filename
            path, fmt = prefix + name, name.rpartition(".")[2].lower() if "." in name else None
            problem = _entry_problem(info, name)
            if problem is None and info.compress_size and info.file_size / info.compress_size > config.archive_ratio:
                raise _Breach("ratio")
            if problem is None and fmt == "zip":
                if depth >= config.archive_depth:
                    problem = "nested_too_deep"
                else:
                    rows += expand(archive.read(info), config, depth + 1, path + "/", state)
                    continue
            if problem is None and fmt not in {*TEXT, *DOCUMENTS, *IMAGES, *AUDIO, *MUSIC}:
                problem = "format"
            if problem:
                rows.append((path, "skipped", fmt, info.file_size, problem, None))
                continue
            state["files"] += 1
            state["bytes"] += info.file_size
            if state["files"] > config.archive_files or state["bytes"] > config.archive_bytes:
                raise _Breach("files" if state["files"] > config.archive_files else "bytes")
            content = archive.read(info)
            if len(content) > info.file_size:
                raise _Breach("bytes")
            rows.append((path, "accepted", fmt, len(content), None, content))
    return rows


def expand_archives(files: DataFrame, config: Config | None = None) -> DataFrame:
    """``archive, path, status, format, n_bytes, message, content``: every entry with its verdict."""
    config = config or Config()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
        for batch in batches:
            for path, raw in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                try:
                    rows = expand(raw or b"", config)
                except _Breach as breach:
                    rows = [(None, "skipped", None, None, f"archive_{breach}", None)]
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError):
                    rows = [(None, "skipped", None, None, "archive_unreadable", None)]
                columns = list(zip(*((path, *r) for r in rows))) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["archive", "path", "status", "format", "n_bytes", "message", "content"])

    return files.select("path", "content").mapInArrow(run, "archive string, " + _ENTRY)


def pair_notes(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images with the notes file beside them (``NAME_notes.txt`` before ``.md``, any case), and notes without an image."""
    named = files.withColumns({"stem": F.lower(F.regexp_replace("name", "[.][^.]*$", "")), "folder": F.regexp_replace("path", "[^/]*$", "")})
    notes = named.where(F.col("stem").endswith(NOTES_SUFFIX) & F.col("format").isin("txt", "md"))
    notes = notes.select("folder", F.expr(f"left(stem, length(stem) - {len(NOTES_SUFFIX)})").alias("stem"), F.col("path").alias("notes_path"), F.col("format").alias("notes_format"))
    first = Window.partitionBy("folder", "stem").orderBy(F.desc("notes_format"), "notes_path")
    images = named.where(F.col("format").isin(IMAGES))
    best = notes.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth", "notes_format")
    return images.join(best, ["folder", "stem"], "left").drop("folder", "stem"), notes.join(images.select("folder", "stem"), ["folder", "stem"], "left_anti").select("notes_path")


def in_natural_order(files: DataFrame) -> DataFrame:
    return files.orderBy(natural_key("name"), "name")


def fetch_class(status: str | Column) -> Column:
    """What an HTTP status means: ok, not_modified, transient or permanent."""
    s = F.col(status) if isinstance(status, str) else status
    return F.when(s == 304, "not_modified").when(s.between(200, 299), "ok").when((s == 429) | (s >= 500) | s.isNull(), "transient").otherwise("permanent")


def robots_class(status: str | Column, attempts: str | Column, most: int = 3) -> Column:
    """What a robots file's answer means: parse, allow, or deny (after all retries), else retry."""
    s, n = (F.col(c) if isinstance(c, str) else c for c in (status, attempts))
    return F.when(s.between(200, 299), "parse").when(s.between(400, 499), "allow").when(n >= most, "deny").otherwise("retry")


def cache_upsert(cache: DataFrame, fetched: DataFrame, key: str = "key") -> DataFrame:
    """The cache with its fetched rows replaced or added."""
    return cache.join(fetched.select(key), key, "left_anti").unionByName(fetched)


def cache_fresh(cache: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Rows younger than ``days``."""
    return cache.where(F.col("fetched_at") > now - F.make_dt_interval(F.lit(days)))
