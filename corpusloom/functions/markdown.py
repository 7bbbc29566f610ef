"""Markdown as plain text: a fold over lines that knows fences, tables, lists, quotes and headings."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import col

_FENCE = re.compile(r"^( {0,3})(`{3,}|~{3,})([^`]*)$")
_ITEM = re.compile(r"^(\s*)([-*+]|\d{1,9}[.)])(?:([ \t]+)(.*)|\s*)$")
_RULE = re.compile(r"^ {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")
_UNDERLINE = re.compile(r"^ {0,3}(?:=+|-+)[ \t]*$")
_HEADING = re.compile(r"^ {0,3}#{1,6}(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_QUOTE = re.compile(r"^ {0,3}(?:> ?)+")
_MARKUP = re.compile(r"^ {0,3}<(?:[A-Za-z][A-Za-z0-9-]*(?=[\s/>])|/[A-Za-z]|!--|!\[CDATA\[|\?)")
_ALIGNS = re.compile(r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")
_ESCAPE_OR_TICKS = re.compile(r"\\[!-/:-@\[-`{-~]|`+")
_IMAGE = re.compile(r"!\[([^\]]*)\]\(\s*<?([^\s)>]*)>?[^)]*\)")
_LINK = re.compile(r"\[([^\[\]]*)\]\(\s*<?([^\s)>]*)>?[^)]*\)")
_ADDRESS = re.compile(r"<((?:https?|mailto):[^\s<>]*)>")
_EMPHASIS = (re.compile(r"(\*\*)(?=\S)(.+?)(?<=\S)\1", re.DOTALL), re.compile(r"(?<!\w)(__)(?=\S)(.+?)(?<=\S)\1(?!\w)", re.DOTALL), re.compile(r"(\*)(?=\S)([^*]+?)(?<=\S)\1"), re.compile(r"(?<!\w)(_)(?=\S)([^_]+?)(?<=\S)\1(?!\w)"))


def plain_inline(text: str) -> str:
    """A paragraph, cell or heading without marks: links as ``text (address)``, images by their description, code as it is."""
    held: list[str] = []

    def hold(value: str) -> str:
        held.append(value)
        return f"\x00{len(held) - 1}\x00"

    def code(inside: str) -> str:
        inside = inside.replace("\n", " ")
        return hold(inside[1:-1] if inside.strip() and inside[0] == inside[-1] == " " else inside)

    def literal() -> Iterator[str]:
        """The text with escaped characters and code held back; grave accents that nothing closes stay."""
        at, unclosed = 0, set()
        while m := _ESCAPE_OR_TICKS.search(text, at):
            yield text[at : m.start()]
            at, run = m.end(), m[0]
            if run[0] == "\\":
                yield hold(run[1])
                continue
            end = None if len(run) in unclosed else re.compile(rf"(?<!`){run}(?!`)").search(text, at)
            if end:
                yield code(text[at : end.start()])
                at = end.end()
            else:
                unclosed.add(len(run))
                yield run
        yield text[at:]

    def with_address(m: re.Match) -> str:
        shown, address = m[1].strip(), html.unescape(m[2])
        return f"{shown} ({hold(address)})" if shown and address and address != shown else shown or hold(address)

    text = text.replace("\x00", "")
    text = "".join(literal())
    text = _LINK.sub(with_address, _IMAGE.sub(with_address, _ADDRESS.sub(lambda m: hold(m[1]), text)))
    for pattern in _EMPHASIS:
        text = pattern.sub(r"\2", text)
    text = html.unescape(text)
    while "\x00" in text:  # what was held may hold more
        text = re.sub("\x00(\\d+)\x00", lambda m: held[int(m[1])], text)
    return text.strip()


def _cells(line: str) -> list[str]:
    body = line.strip().removeprefix("|")
    body = body[:-1] if body.endswith("|") and not body.endswith("\\|") else body
    return [plain_inline(c.strip().replace("\\|", "|")) for c in re.split(r"(?<!\\)\|", body)]


class PlainText:
    """What a line makes of the text so far: its lines, the open paragraph, lists and table."""

    def __init__(self):
        self.out: list[str] = []
        self.paragraph: list[str] = []
        self.lists: list[list] = []  # width of an item's content, next number (None: bullets)
        self.prefix = ""  # of the next line of an item
        self.fence = self.head = None
        self.markup = self.gap = False

    def blank(self) -> None:
        if self.out and self.out[-1]:
            self.out.append("")

    def flush(self) -> None:
        """Writes the open paragraph; an item's first line has its mark, further ones stand below it."""
        if self.paragraph:
            lines = [s.strip() for s in plain_inline("\n".join(self.paragraph)).split("\n")]
            self.paragraph = []
            deep = "  " * max(0, len(self.lists) - 1)
            for line in lines:
                self.out.append(deep + (self.prefix or "  ") + line if self.lists else line)
                self.prefix = ""
            if not self.lists:
                self.blank()

    def leave(self) -> None:
        self.flush()
        if self.lists:
            self.lists, self.prefix = [], ""
            self.blank()

    def add(self, line: str, following: str) -> None:
        if self.fence:
            mark, indent = self.fence
            if re.match(rf"^ {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$", line.lstrip() if self.lists else line):
                self.fence = None
                self.blank()
            else:
                body = line[min(indent, len(line) - len(line.lstrip(" "))) :]
                self.out.append("  " * len(self.lists) + body if body else "")
            return
        if self.markup and line.strip():
            self.out.append(line)
            return
        self.markup = False
        line = _QUOTE.sub("", line).expandtabs(4)
        if not line.strip():
            self.flush()
            if self.head is not None:
                self.head = None
            self.gap = True
            if not self.lists:
                self.blank()
            return
        gap, self.gap = self.gap, False
        indent = len(line) - len(line.lstrip(" "))
        if self.head is not None:
            if "|" in line:
                self.record(line)
                return
            self.head = None
        if self.lists and gap and not _ITEM.match(line) and indent < 2:
            self.leave()
        if m := _FENCE.match(line.lstrip() if self.lists else line):
            self.flush()
            self.blank()
            self.fence = m[2], indent
        elif self.paragraph and not self.lists and _UNDERLINE.match(line):
            self.flush()
        elif _RULE.match(line):
            self.leave()
            self.blank()
        elif m := _ITEM.match(line):
            self.item(m)
        elif "|" in line and _ALIGNS.match(following) and "|" in following and len(_cells(line)) == len(_cells(following)):
            self.leave()
            self.head = _cells(line)
        elif m := _HEADING.match(line):
            self.leave()
            self.paragraph = [m[1] or ""]
            self.flush()
        elif not self.paragraph and not self.lists and _MARKUP.match(line):
            self.markup = True
            self.out.append(line)
        elif indent >= 4 and not self.paragraph and not self.lists:
            self.out.append(line[4:])
        else:
            self.paragraph.append(re.sub(r" {2,}$|\\$", "", line))

    def item(self, m: re.Match) -> None:
        if self.paragraph and not self.lists and m[2][0].isdigit() and not m[2].startswith("1"):  # a number at a line's start
            self.paragraph.append(m[0])
            return
        if not self.lists:
            self.flush()
        self.flush()
        number = int(m[2][:-1]) if m[2][0].isdigit() else None
        indent = len(m[1])
        while self.lists and indent < self.lists[-1][0] and len(self.lists) > 1 and indent < self.lists[-2][0]:
            self.lists.pop()
        if not self.lists or indent >= self.lists[-1][0]:
            self.lists.append([0, number])
        elif (self.lists[-1][1] is None) != (number is None):
            self.lists[-1] = [0, number]
        self.lists[-1][0] = indent + len(m[2]) + 1
        if number is not None:
            self.prefix = f"{self.lists[-1][1]}. "
            self.lists[-1][1] += 1
        else:
            self.prefix = "- "
        if m[4]:
            self.paragraph = [m[4]]

    def record(self, line: str) -> None:
        """A table's row as ``column: value`` lines; the line of alignments says nothing."""
        cells = _cells(line)
        if _ALIGNS.match(line):
            return
        for i, cell in enumerate(cells):
            if cell:
                name = self.head[i] if i < len(self.head) else ""
                self.out.append(f"{name}: {cell}" if name else cell)
        self.blank()

    def text(self) -> str:
        self.flush()
        return "\n".join(self.out).strip("\n")


def plain_text(source: str | None) -> str:
    """The plain text of a Markdown document; each line is read once."""
    lines = (source or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    fold = PlainText()
    for line, following in zip(lines, [*lines[1:], ""]):
        fold.add(line, following)
    return fold.text()


def plain_markdown(text: str | Column) -> Column:
    """``plain_text`` of a column, in Arrow batches; null stays null."""

    @F.pandas_udf("string")
    def plain(values: pd.Series) -> pd.Series:
        return values.map(plain_text, na_action="ignore")

    return plain(col(text))
