"""Extractors: bytes or text of a format to blocks, with titles, links and metadata.

Blocks are structs ``kind, level, content, link_chars``: heading, paragraph,
list, table, quote, code.  An extractor is a function of one value that
returns (blocks, title, confidence, metadata, warnings); it runs in Arrow
batches, and an exception becomes a row's ``error``.
"""

from __future__ import annotations

import csv
import email
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import col, first_line_title, one_line, parse_date

BLOCKS = "array<struct<kind:string,level:int,content:string,link_chars:int>>"
SCHEMA = f"blocks {BLOCKS}, title string, confidence string, metadata map<string,string>, warnings array<string>, error string"
Result = tuple[list[tuple], str | None, str, dict[str, str], list[str]]

#: Elements of a page that hold no content, of which everything is left out.
NOT_CONTENT = frozenset("script style noscript template nav header footer aside form iframe svg button select".split())
_HEADING = re.compile("^h([1-6])$")
#: Rows whose blocks are held as Python objects at once; a batch from Spark may have 10,000.
ROWS = 64


class _Page(HTMLParser):
    """Blocks of a page; article or main only, if there is one."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple] = []
        self.inside: list[bool] = []
        self.title, self.skip, self.scope, self.in_title, self.in_link = "", 0, 0, False, 0
        self.kind, self.level, self.parts, self.link_chars = "paragraph", 0, [], 0
        self.items: list[str] | None = None
        self.rows: list[list[str]] | None = None
        self.links: list[tuple[str, str]] = []
        self.href, self.href_text = None, []

    def _close(self, into: str | None = None) -> None:
        text, chars = " ".join("".join(self.parts).split()), self.link_chars
        self.parts, self.link_chars = [], 0
        if not text:
            return
        if into == "item" and self.items is not None:
            self.items.append(text)
        elif into == "cell" and self.rows:
            self.rows[-1].append(text)
        else:
            self._add(self.kind, self.level, text, min(chars, len(text)))

    def _add(self, *block) -> None:
        self.blocks.append(block)
        self.inside.append(self.scope > 0)

    def handle_starttag(self, tag, attrs):
        if tag in NOT_CONTENT or self.skip:
            self.skip += tag in NOT_CONTENT
            return
        heading = _HEADING.match(tag)
        if tag == "title":
            self.in_title = True
        elif tag in ("article", "main"):
            self._close()
            self.scope += 1
        elif tag == "a":
            self.in_link += 1
            self.href, self.href_text = dict(attrs).get("href"), []
        elif tag == "br":
            self.parts.append(" ")
        elif heading or tag in ("p", "div", "section", "blockquote", "pre", "table", "ul", "ol", "tr", "td", "th", "li", "body"):
            self._close("item" if tag == "li" else "cell" if tag in ("td", "th", "tr") else None)
            self.kind, self.level = "paragraph", 0
            if heading:
                self.kind, self.level = "heading", int(heading[1])
            elif tag == "blockquote":
                self.kind = "quote"
            elif tag == "pre":
                self.kind = "code"
            elif tag in ("ul", "ol") and self.items is None:
                self.items, self.ordered = [], tag == "ol"
            elif tag == "table" and self.rows is None:
                self.rows = []
            elif tag == "tr" and self.rows is not None:
                self.rows.append([])

    def handle_endtag(self, tag):
        if self.skip:
            self.skip -= tag in NOT_CONTENT
            return
        if tag == "title":
            self.in_title = False
        elif tag == "a":
            self.in_link = max(0, self.in_link - 1)
            if self.href:
                self.links.append((self.href, " ".join("".join(self.href_text).split())))
            self.href = None
        elif tag == "li":
            self._close("item")
        elif tag in ("td", "th"):
            self._close("cell")
        elif tag in ("ul", "ol") and self.items is not None:
            self._close("item")
            items, self.items = self.items, None
            if items:
                self._add("list", int(self.ordered), "\n".join(items), 0)
        elif tag == "table" and self.rows is not None:
            self._close("cell")
            rows, self.rows = [r for r in self.rows if r], None
            if rows:
                self._add("table", 0, "\n".join("\t".join(r) for r in rows), 0)
        elif tag in ("article", "main"):
            self._close()
            self.scope = max(0, self.scope - 1)
        elif _HEADING.match(tag) or tag in ("p", "div", "section", "blockquote", "pre"):
            self._close()
            self.kind, self.level = "paragraph", 0

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip:
            self.parts.append(data)
            if self.in_link:
                self.link_chars += len(data)
                self.href_text.append(data)


def html_page(text: str) -> Result:
    page = _Page()
    page.feed(text)
    page.close()
    page._close()
    blocks = [b for b, inside in zip(page.blocks, page.inside) if inside] or page.blocks
    title = " ".join(page.title.split()) or next((b[2] for b in blocks if b[0] == "heading"), None)
    return blocks, title or None, "medium" if any(page.inside) else "low", {}, []


def markdown(text: str) -> Result:
    blocks, lines, i = [], text.split("\n"), 0
    flat = lambda s: re.sub(r"[*_`]+", "", re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", s)).strip()
    while i < len(lines):
        line = lines[i]
        head = re.match(r"^(#{1,6})\s+(.*?)\s*#*$", line)
        fence = re.match(r"^(```|~~~)", line)
        if not line.strip():
            i += 1
        elif head:
            blocks.append(("heading", len(head[1]), flat(head[2]), 0))
            i += 1
        elif fence:
            end = next((j for j in range(i + 1, len(lines)) if lines[j].startswith(fence[1])), len(lines))
            blocks.append(("code", 0, "\n".join(lines[i + 1 : end]), 0))
            i = end + 1
        elif line.startswith(">"):
            end = next((j for j in range(i, len(lines)) if not lines[j].startswith(">")), len(lines))
            blocks.append(("quote", 0, flat(" ".join(x.lstrip("> ") for x in lines[i:end])), 0))
            i = end
        elif "|" in line and i + 1 < len(lines) and re.match(r"^\s*\|?[\s:|-]*-[\s:|-]*$", lines[i + 1]):
            end = next((j for j in range(i, len(lines)) if "|" not in lines[j]), len(lines))
            rows = [[flat(c) for c in x.strip().strip("|").split("|")] for x in (lines[i], *lines[i + 2 : end])]
            blocks.append(("table", 0, "\n".join(" | ".join(r) for r in rows), 0))
            i = end
        elif re.match(r"^\s*(?:[-*+]|\d+[.)])\s+", line):
            end = next((j for j in range(i, len(lines)) if not re.match(r"^\s*(?:[-*+]|\d+[.)])\s+", lines[j])), len(lines))
            blocks.append(("list", int(bool(re.match(r"^\s*\d", line))), "\n".join(flat(re.sub(r"^\s*(?:[-*+]|\d+[.)])\s+", "", x)) for x in lines[i:end]), 0))
            i = end
        else:
            end = next((j for j in range(i + 1, len(lines)) if not lines[j].strip() or re.match(r"^(#{1,6}\s|```|~~~|>)", lines[j])), len(lines))
            blocks.append(("paragraph", 0, flat(" ".join(x.strip() for x in lines[i:end])), 0))
            i = end
    title = next((b[2] for b in blocks if b[0] == "heading"), None) or next((b[2][:80] for b in blocks if b[0] == "paragraph"), None)
    return blocks, title, "high", {}, []


def plain_text(text: str) -> Result:
    first = next((x.strip() for x in text.splitlines() if x.strip()), None)
    return [("paragraph", 0, p.strip(), 0) for p in text.split("\n\n") if p.strip()], first[:80] if first else None, "low", {}, []


def delimited(text: str, tab: bool = False) -> Result:
    dialect: type[csv.Dialect] = csv.excel_tab if tab else csv.excel
    if not tab:
        try:
            dialect = csv.Sniffer().sniff(text[:8192], delimiters=",;\t|")
        except csv.Error:
            pass
    rows = [[" ".join(c.split()) for c in r] for r in csv.reader(io.StringIO(text), dialect)]
    rows = [r for r in rows if any(r)]
    table = [("table", 0, "\n".join("\t".join(r) for r in rows), 0)] if rows else []
    return table, None, "high", {"columns": str(max(map(len, rows), default=0)), "rows": str(len(rows))}, []


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    raw = archive.read(name)
    if b"<!DOCTYPE" in raw[:4096] or b"<!ENTITY" in raw:
        raise ValueError("declarations are refused")
    return ElementTree.fromstring(raw)


def _local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def _text(element: ElementTree.Element) -> str:
    return " ".join("".join(element.itertext()).split())


def word_document(raw: bytes) -> Result:
    blocks: list[tuple] = []
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        body = next(e for e in _xml(archive, "word/document.xml") if _local(e) == "body")
        for e in body.iter():
            if _local(e) == "tbl":
                rows = ["\t".join(_text(c) for c in r if _local(c) == "tc") for r in e if _local(r) == "tr"]
                blocks.append(("table", 0, "\n".join(rows), 0))
        tables = {id(p) for t in body.iter() if _local(t) == "tbl" for p in t.iter()}
        for e in body.iter():
            if _local(e) != "p" or id(e) in tables or not _text(e):
                continue
            style = next((v for s in e.iter() if _local(s) == "pStyle" for k, v in s.attrib.items() if k.endswith("val")), "")
            head = re.match(r"(?i)heading(\d)|nag[^\d]*(\d)", style)
            kind = "heading" if head or style.lower() == "title" else "list" if "list" in style.lower() else "quote" if "quote" in style.lower() else "paragraph"
            blocks.append((kind, int(head[1] or head[2]) if head else 1 if kind == "heading" else 0, _text(e), 0))
        core = {_local(e): _text(e) for e in _xml(archive, "docProps/core.xml")} if "docProps/core.xml" in archive.namelist() else {}
    meta = {k: core[v] for k, v in (("author", "creator"), ("date", "created")) if core.get(v)}
    return blocks, core.get("title") or next((b[2] for b in blocks if b[0] == "heading"), None), "high", meta, []


def open_document(raw: bytes) -> Result:
    if raw.lstrip()[:1] == b"<":
        root = ElementTree.fromstring(raw)
    else:
        with zipfile.ZipFile(io.BytesIO(raw)) as archive:
            root = _xml(archive, "content.xml")
    blocks, done = [], set()
    for e in root.iter():
        name = _local(e)
        if id(e) in done:
            continue
        if name == "table":
            rows = [[_text(c) for c in r if _local(c) == "table-cell"] for r in e.iter() if _local(r) == "table-row"]
            blocks.append(("table", 0, "\n".join("\t".join(r) for r in rows if any(r)), 0))
            done.update(map(id, e.iter()))
        elif name == "list":
            blocks.append(("list", 0, "\n".join(_text(i) for i in e if _local(i) == "list-item"), 0))
            done.update(map(id, e.iter()))
        elif name in ("h", "p") and _text(e):
            level = next((int(v) for k, v in e.attrib.items() if k.endswith("outline-level")), 1)
            blocks.append(("heading", level, _text(e), 0) if name == "h" else ("paragraph", 0, _text(e), 0))
    title = next((_text(e) for e in root.iter() if _local(e) == "title"), None)
    return blocks, title or next((b[2] for b in blocks if b[0] == "heading"), None), "high", {}, []


def epub(raw: bytes) -> Result:
    blocks, warnings = [], []
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        container = _xml(archive, "META-INF/container.xml")
        path = next(e.attrib["full-path"] for e in container.iter() if _local(e) == "rootfile")
        package = _xml(archive, path)
        meta = {_local(e): _text(e) for e in package.iter() if _local(e) in ("title", "creator", "date", "language")}
        files = {e.attrib["id"]: e.attrib["href"] for e in package.iter() if _local(e) == "item"}
        for ref in (e.attrib["idref"] for e in package.iter() if _local(e) == "itemref"):
            try:
                blocks += html_page(archive.read(f"{path.rpartition('/')[0]}/{files[ref]}".lstrip("/")).decode("utf-8", "replace"))[0]
            except KeyError:
                warnings.append(f"missing chapter {ref}")
    return blocks, meta.get("title"), "high", {k: v for k, v in (("author", meta.get("creator")), ("date", meta.get("date")), ("language", meta.get("language"))) if v}, warnings


def slides(raw: bytes) -> Result:
    blocks = []
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        names = sorted((n for n in archive.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        for number, name in enumerate(names, 1):
            root = _xml(archive, name)
            lines = [_text(p) for p in root.iter() if _local(p) == "p" and _text(p)]
            hidden = " (hidden)" if root.attrib.get("show") == "0" else ""
            blocks.append(("heading", 2, f"Slide {number}{hidden}", 0))
            blocks += [("paragraph", 0, line, 0) for line in lines]
    return blocks, next((b[2] for b in blocks if b[0] == "paragraph"), None), "high", {"slides": str(len(names))}, []


def workbook(raw: bytes) -> Result:
    blocks = []
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        shared = [_text(e) for e in _xml(archive, "xl/sharedStrings.xml") if _local(e) == "si"] if "xl/sharedStrings.xml" in archive.namelist() else []
        names = [e.attrib["name"] for e in _xml(archive, "xl/workbook.xml").iter() if _local(e) == "sheet"]
        for i, name in enumerate(names, 1):
            rows = []
            for row in (e for e in _xml(archive, f"xl/worksheets/sheet{i}.xml").iter() if _local(e) == "row"):
                cells = []
                for c in (e for e in row if _local(e) == "c"):
                    value = next((_text(v) for v in c if _local(v) in ("v", "is")), "")
                    cells.append(shared[int(value)] if c.attrib.get("t") == "s" and value else value)
                rows.append("\t".join(cells))
            blocks += [("heading", 2, name, 0), ("table", 0, "\n".join(r for r in rows if r.strip()), 0)]
    return blocks, None, "high", {"sheets": str(len(names))}, []


def web_archive(raw: bytes) -> Result:
    message = email.message_from_bytes(raw)
    part = next(p for p in message.walk() if p.get_content_type() == "text/html")
    text = part.get_payload(decode=True).decode(part.get_content_charset() or "utf-8", "replace")
    blocks, title, confidence, meta, warnings = html_page(text)
    url = message.get("Snapshot-Content-Location")
    return blocks, title, confidence, meta | ({"url": url} if url else {}), warnings


def score(raw: bytes) -> Result:
    """Header facts of MusicXML, plain or packed."""
    if raw[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(raw)) as archive:
            raw = archive.read(next(n for n in archive.namelist() if n.endswith((".xml", ".musicxml")) and not n.startswith("META-INF")))
    root = ElementTree.fromstring(raw)
    find = lambda name: next((e for e in root.iter() if _local(e) == name), None)
    value = lambda name: _text(find(name)) if find(name) is not None else None
    parts = [_text(e) for e in root.iter() if _local(e) == "part-name"]
    first = find("part")
    bars = sum(_local(e) == "measure" for e in first) if first is not None else 0
    tempo = next((e.attrib["tempo"] for e in root.iter() if _local(e) == "sound" and "tempo" in e.attrib), None)
    facts = {"title": value("work-title") or value("movement-title"), "fifths": value("fifths"), "mode": value("mode"), "metre": f"{value('beats')}/{value('beat-type')}" if value("beats") else None, "tempo": tempo, "bars": str(bars), "parts": ", ".join(parts) or None}
    facts = {k: v for k, v in facts.items() if v}
    return [("paragraph", 0, "\n".join(f"{k}: {v}" for k, v in facts.items()), 0)], facts.get("title"), "high", facts, []


_TEXTUAL: dict[str, Callable[[str], Result]] = {"html": html_page, "htm": html_page, "md": markdown, "csv": delimited, "tsv": lambda t: delimited(t, True)}
_BINARY: dict[str, Callable[[bytes], Result]] = {"docx": word_document, "epub": epub, "pptx": slides, "xlsx": workbook, "xlsm": workbook, "mhtml": web_archive, "mht": web_archive, "musicxml": score, "mxl": score}
_BINARY |= dict.fromkeys("odt ods odp fodt fods fodp".split(), open_document)
_TEXTUAL |= dict.fromkeys("txt json xml yaml yml toml ini cfg log".split(), plain_text)


def register(fmt: str, function: Callable, binary: bool = False) -> None:
    """Adds or replaces the extractor of a format (one for OCR or speech, for instance)."""
    (_BINARY if binary else _TEXTUAL)[fmt] = function


def extract(rows: DataFrame, key: str = "path", value: str = "text", fmt: str | Column = "format") -> DataFrame:
    """``key`` and the extracted parts; ``value`` is text, or binary for packed formats.

    A format without an extractor, and one that fails, gives an ``error``.
    """
    table = dict(_BINARY) if rows.schema[value].dataType.simpleString() == "binary" else dict(_TEXTUAL)
    kind = rows.schema[key].dataType.simpleString()
    block = pa.struct([("kind", pa.string()), ("level", pa.int32()), ("content", pa.string()), ("link_chars", pa.int32())])
    kinds = (pa.list_(block), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.list_(pa.string()), pa.string())
    names = ["blocks", "title", "confidence", "metadata", "warnings", "error"]

    def one(content, name):
        if content is None or name not in table:
            return None, None, None, None, None, "format" if content is not None else "no content"
        try:
            blocks, title, confidence, meta, warnings = table[name](content)
        except Exception as problem:  # whatever a broken file makes a parser raise
            return None, None, None, None, None, f"{type(problem).__name__}: {problem}"
        return [dict(zip(("kind", "level", "content", "link_chars"), b)) for b in blocks], title, confidence, list(meta.items()), warnings, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            found = [one(c.as_py(), n.as_py()) for c, n in zip(batch["value"], batch["fmt"])]
            yield pa.RecordBatch.from_arrays([batch[key], *(pa.array(c, k) for c, k in zip(zip(*found), kinds))], [key, *names])

    return rows.select(key, F.col(value).alias("value"), (F.col(fmt) if isinstance(fmt, str) else fmt).alias("fmt")).mapInArrow(run, f"{key} {kind}, {SCHEMA}")


def exploded(extracted: DataFrame, key: str = "path") -> DataFrame:
    """Blocks as rows ``key, pos, tag, text, link_chars`` for the boilerplate rules."""
    rows = extracted.select(key, F.posexplode("blocks").alias("pos", "b"))
    return rows.select(key, "pos", F.when(F.col("b.kind") == "heading", "head").when(F.col("b.kind") == "paragraph", "p").otherwise(F.col("b.kind")).alias("tag"), F.col("b.content").alias("text"), F.col("b.link_chars").alias("link_chars"))


def as_markdown(blocks: str | Column) -> Column:
    """Blocks as Markdown text."""
    lines = lambda x: F.split(x["content"], "\n")
    row = lambda r: F.concat(F.lit("| "), F.replace(r, F.lit("\t"), F.lit(" | ")), F.lit(" |"))

    def table(x: Column) -> Column:
        head = F.get(lines(x), F.lit(0))
        rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.split(head, "\t"))))
        return F.array_join(F.concat(F.array(row(head), rule), F.transform(F.slice(lines(x), 2, F.greatest(F.size(lines(x)) - 1, F.lit(0))), row)), "\n")

    def text(x: Column) -> Column:
        items = F.transform(lines(x), lambda i, n: F.concat(F.when(x["level"] == 1, F.concat((n + 1).cast("string"), F.lit(". "))).otherwise("- "), i))
        return (
            F.when(x["kind"] == "heading", F.concat(F.repeat(F.lit("#"), F.least(F.greatest(x["level"], F.lit(1)), F.lit(6))), F.lit(" "), x["content"]))
            .when(x["kind"] == "list", F.array_join(items, "\n")).when(x["kind"] == "table", table(x))
            .when(x["kind"] == "quote", F.concat(F.lit("> "), F.replace(x["content"], F.lit("\n"), F.lit("\n> "))))
            .when(x["kind"] == "code", F.concat(F.lit("```\n"), x["content"], F.lit("\n```"))).otherwise(x["content"])
        )

    return F.array_join(F.transform(F.coalesce(col(blocks), F.array().cast(BLOCKS)), text), "\n\n")


def scripts_only(text: Column, html: Column) -> Column:
    """A long page with scripts from which next to nothing came out."""
    return (F.length(F.coalesce(text, F.lit(""))) <= 200) & (F.length(html) >= 2000) & F.contains(F.lower(html), F.lit("<script"))


def links(pages: DataFrame, key: str = "page_id", html: str = "html", absolute: bool = True) -> DataFrame:
    """``key, no, url, text``: distinct link targets in page order, the first text wins."""
    found = F.regexp_extract_all(html, F.lit(r'(?is)<a\s[^>]*?href\s*=\s*"[^"]*"[^>]*>.*?</a>'), F.lit(0))
    rows = pages.select(key, F.posexplode(found).alias("at", "raw"))
    rows = rows.select(key, "at", F.regexp_extract("raw", r'(?is)href\s*=\s*"([^"]*)"', 1).alias("url"), one_line(F.regexp_replace("raw", "<[^>]*>", "")).alias("text"))
    rows = rows.where(F.col("url").rlike("(?i)^https?://")) if absolute else rows.where("url <> ''")
    once = rows.groupBy(key, "url").agg(F.min("at").alias("at"), F.min_by("text", "at").alias("text"))
    return once.select(key, F.row_number().over(Window.partitionBy(key).orderBy("at")).alias("no"), "url", "text")


_ARTICLES = ["Article", "NewsArticle", "BlogPosting"]


def json_ld(html: str | Column) -> Column:
    """Struct ``title, author, date, publisher, body`` of the first article in a page's JSON-LD; nulls if none."""
    scripts = F.regexp_extract_all(col(html), F.lit(r'(?is)<script[^>]*type\s*=\s*["\']application/ld\+json["\'][^>]*>(.*?)</script>'), F.lit(1))
    def flat(raw):
        v = F.try_parse_json(raw)
        graph = F.try_variant_get(v, "$['@graph']", "array<variant>")
        many = F.try_variant_get(v, "$", "array<variant>")
        return F.coalesce(graph, many, F.array(v))

    nodes = F.flatten(F.transform(scripts, flat))
    kinds = lambda v: F.coalesce(F.try_variant_get(v, "$['@type']", "array<string>"), F.array(F.try_variant_get(v, "$['@type']", "string")))
    article = F.get(F.filter(nodes, lambda v: F.arrays_overlap(kinds(v), F.array(*map(F.lit, _ARTICLES)))), F.lit(0))
    at = lambda *paths: F.substring(F.coalesce(*[F.try_variant_get(article, p, "string") for p in paths]), 1, 500)
    return F.struct(
        at("$.headline", "$.name").alias("title"), at("$.author.name", "$.author[0].name", "$.author").alias("author"), parse_date(at("$.datePublished", "$.dateCreated")).alias("date"),
        at("$.publisher.name").alias("publisher"), F.try_variant_get(article, "$.articleBody", "string").alias("body"),
    )


def merge_metadata(first: Column, second: Column) -> tuple[Column, Column]:
    """Two maps as one, and the keys on which they differ: gaps are filled, conflicts keep both values."""
    keys = F.array_union(F.map_keys(first), F.map_keys(second))
    a, b = (lambda k: F.trim(F.try_element_at(first, k))), (lambda k: F.trim(F.try_element_at(second, k)))
    differs = lambda k: a(k).isNotNull() & b(k).isNotNull() & F.when(F.contains(k, F.lit("date")), F.substring(a(k), 1, 10) != F.substring(b(k), 1, 10)).otherwise(F.lower(a(k)) != F.lower(b(k)))
    merged = F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.coalesce(a(k), b(k)))))
    clash = F.filter(keys, differs)
    others = F.map_from_entries(F.transform(clash, lambda k: F.struct(F.concat(k, F.lit(" (structured data)")), b(k))))
    return F.map_concat(merged, others), clash


def title_of(text: str | Column) -> Column:
    return first_line_title(text)
