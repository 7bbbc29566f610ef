"""Main text of web pages: a suffix array of what a host's pages share, and markup where that leaves it open.

Pages are parsed into blocks.  The token streams of a host's pages are
concatenated and their suffixes ranked by prefix doubling.  A token is covered
by a repeated substring of ``RUN`` tokens or more exactly if one of ``RUN``
tokens that is repeated covers it, so ranking to that depth finds all long
substrings that distinct pages share, whatever their length.  Pages of equal
content are one page here: copies of a page do not make it boilerplate, and one
of them stands for all in everything that is counted or ranked.

* Blocks outside articles that are mostly covered go; unique runs stay.
* Blocks of an article go where nine tenths of the host's pages (of
  ``SITE_WIDE`` at least) have them; what some articles share stays.
* Markup breaks ties: marked parts (menus, adverts, comments and so on) go even
  if nothing repeats them, and a page's unmarked blocks give way to its article
  unless the blocks that nothing repeats are four times as long.

A host's pages are dealt to lots of ``LOT`` pages, so that tasks hold little
and no host is one group.  Lots of one host exchange the runs that they have:
results do not depend on how pages are dealt.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import stash
from corpusloom.llm.url_filters import host_and_path

#: Tokens of a run that counts as repeated (a power of two); pages and tokens of a lot.
RUN, LOT, LOT_TOKENS = 8, 128, 1 << 18
#: Distinct contents of a host from which on what nine tenths of them have in their articles is boilerplate, unless told otherwise.
SITE_WIDE = 20

#: Elements whose content is text and no markup, in the end tag's pattern.
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in "script style iframe xmp noembed noframes textarea title".split()}
#: A quote counts after an equals sign only; nothing here is tried twice.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Inside a line of text, but no part of it.
_MUTE = frozenset("button select svg math canvas object".split())
_CELLS = frozenset("td th tr tbody thead tfoot".split())
_ROWS = frozenset("tr tbody thead tfoot".split())
_BREAKS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements whose ends are often left out, and what ends them.
_ENDED_BY = {
    "p": _BREAKS_P, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "td": _CELLS, "th": _CELLS, "tr": _ROWS,
    "tbody": _ROWS - {"tr"}, "thead": _ROWS - {"tr"}, "option": frozenset({"option", "optgroup"}), "optgroup": frozenset({"optgroup"}),
}
_DROPPED = frozenset("head nav footer aside menu dialog noscript template".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification popup modal overlay "
    "nav navbar navigation menu toolbar breadcrumb breadcrumbs sidebar footer masthead comment comments respond disqus related share sharing social newsletter subscribe subscription pagination pager".split()
)
_TOP_NAMES = frozenset("header topbar".split())
_ARTICLE_NAMES = frozenset("ad ads advert sponsored promo comment comments related".split())
#: What may stand beside these in a name inside an article; other words (``comments-policy``) tell of the article's subject.
_BESIDE = frozenset("area articles bar block body bottom box button buttons center container content count desktop entries feed field footer form header icons inner item items left link links list lists main meta mobile outer page panel post posts region replies reply right row section slot small stories thread title top unit widget widgets wrap wrapper zone".split())
#: Names such as ``has-sidebar`` tell of a page's layout.
_LAYOUT = frozenset("has no not with without".split())
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_HUMP = re.compile(r"([a-z])([A-Z])")

OPEN, ARTICLE, MARKED = 0, 1, 2
#: How firmly a part is marked: an article inside a form is still one, inside a sidebar it is not.
_SOFT, _HARD = 1, 2


def _mark(name: str, values: dict[str, str], inside: bool) -> int:
    if name in _DROPPED or name in _MUTE or (name == "header" and not inside):
        return _HARD
    if name not in ("html", "body"):
        if values:
            names = _ARTICLE_NAMES if name in ("article", "main") else _NAMES if inside else _NAMES | _TOP_NAMES
            for given in f"{values.get('class', '')} {values.get('id', '')}".split():
                parts = set(re.split("[-_]+", _HUMP.sub(r"\1-\2", given).lower()))
                if parts & names and not parts & _LAYOUT and (not inside or all(p in names or p in _BESIDE or p.isdigit() for p in parts)):
                    return _HARD
            if values.get("role", "").lower() in _ROLES or "hidden" in values or "display:none" in re.sub(r"\s", "", values.get("style", "")).lower():
                return _HARD
        if name == "form":
            return _SOFT
    return 0


def blocks(page: str | None) -> list[tuple[int, str]]:
    """The blocks of a page in order: (OPEN, ARTICLE or MARKED, text).  Its time is linear in the page, however broken."""
    page = page or ""
    found: list[tuple[int, str]] = []
    stack: list[tuple[str, int, bool, bool]] = []  # name, mark, article, mute; with what stands above
    opened: dict[str, int] = {}
    held: list[str] = []
    mark, article, mute = 0, False, False
    unclosed: set[str] = set()
    tag, at, end = _TAG, 0, len(page)

    def close() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                found.append((MARKED if mark else ARTICLE if article else OPEN, text))

    def pop() -> None:
        opened[stack.pop()[0]] -= 1

    while at < end:
        start = page.find("<", at)
        if start < 0:
            start = end
        if start > at and not mute:
            held.append(page[at:start])
        if start == end:
            break
        if page.startswith("<!--", start):
            at = page.find("-->", start + 2) + 3
            if at < 3:
                break
            continue
        follows = page[start + 1 : start + 3]
        if follows[:1] in ("!", "?") or (follows[:1] == "/" and len(follows) == 2 and not follows[1].isalpha()):
            at = page.find(">", start) + 1
            if not at:
                break
            continue
        m = tag.match(page, start)
        if m is None:
            letter = follows[1:] if follows[:1] == "/" else follows[:1]
            if not (letter.isascii() and letter.isalpha()):
                if not mute:
                    held.append("<")
                at = start + 1
                continue
            # no end of the tag outside quotes up to the end of the page: from here on quotes mean nothing
            tag = _PLAIN_TAG
            m = tag.match(page, start)
            if m is None:
                break
        at, name = m.end(), m[2].lower()
        if m[1]:
            if name == "br" or (name in _INLINE and not opened.get(name)):
                continue
            if not opened.get(name):
                if name not in _INLINE and not mute:
                    close()
                continue
            if not mute:
                close()
            while stack[-1][0] != name:
                pop()
            pop()
            _, mark, article, mute = stack[-1] if stack else ("", 0, False, False)
            continue
        if name in _RAW and name not in unclosed:
            ending = _RAW[name].search(page, at)
            if ending is not None:
                at = page.find(">", ending.end()) + 1 or end
            elif name in ("textarea", "title"):
                unclosed.add(name)
            else:
                break
            continue
        values = {k.lower(): a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(m[3])} if m[3].strip() else {}
        if name in _INLINE or name in _MUTE:
            if name == "br" and not mute:
                held.append(" ")
            muted = mute or name in _MUTE or (bool(values) and name not in _VOID and not mark and _mark(name, values, article) > 0)
            if muted and name not in _VOID and not (name in _MUTE and m[3].endswith("/")):
                stack.append((name, mark, article, True))
                opened[name] = opened.get(name, 0) + 1
                mute = True
            continue
        if not mute:
            close()
        while stack and name in _ENDED_BY.get(stack[-1][0], ()):
            pop()
            _, mark, article, mute = stack[-1] if stack else ("", 0, False, False)
        if name in _VOID or m[3].endswith("/"):
            continue
        main = name == "main" or values.get("role", "").lower() == "main"
        own = _mark(name, values, article)
        above = 0 if main or (name == "article" and mark == _SOFT) else mark
        mark, article = max(above, own), article or main or name == "article"
        stack.append((name, mark, article, mute))
        opened[name] = opened.get(name, 0) + 1
    close()
    return found


def runs(streams: list[np.ndarray], run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of the suffixes of ``streams`` that have ``run`` tokens: (class, stream, position) of each; equal runs have equal classes."""
    sizes = np.array([len(s) for s in streams], np.int64)
    total = int(sizes.sum())
    if not total:
        return (np.empty(0, np.int64),) * 3
    tokens, page = np.concatenate(streams), np.repeat(np.arange(len(streams)), sizes)
    at = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = sizes[page] - at  # tokens up to the end of the stream
    rank, width = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1, 1
    while width < min(run, total):  # ranks of the suffixes by their first 2 * width tokens
        behind = np.zeros(total, np.int64)
        behind[: total - width] = rank[width:]
        behind[left <= width] = 0
        rank, width = np.unique(rank * (total + 2) + behind, return_inverse=True)[1].astype(np.int64) + 1, 2 * width
    long = left >= run
    return rank[long], page[long], at[long]


def _extremes(classes: np.ndarray, contents: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each class one of its places, its least and greatest content; and the number of the class of each place."""
    order = np.argsort(classes, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], classes[order][1:] != classes[order][:-1]))) if len(order) else np.empty(0, np.int64)
    number = np.empty(len(classes), np.int64)
    number[order] = np.repeat(np.arange(len(edges)), np.diff(np.concatenate((edges, [len(classes)]))))
    if not len(edges):
        return edges, contents, contents, number
    return order[edges], np.minimum.reduceat(contents[order], edges), np.maximum.reduceat(contents[order], edges), number


def _covered(streams: list[np.ndarray], page: np.ndarray, at: np.ndarray, run: int) -> list[np.ndarray]:
    """The tokens of each stream that runs at these places cover."""
    out = []
    bounds = np.searchsorted(page, np.arange(len(streams) + 1))
    for i, stream in enumerate(streams):
        change = np.zeros(len(stream) + 1, np.int64)
        starts = at[bounds[i] : bounds[i + 1]]
        np.add.at(change, starts, 1)
        np.add.at(change, starts + run, -1)
        out.append(np.cumsum(change[:-1]) > 0)
    return out


def repeated(streams: list[np.ndarray], contents: np.ndarray, run: int = RUN) -> list[np.ndarray]:
    """For each stream of tokens those that a run of ``run`` tokens or more covers which a stream of other content has too."""
    classes, page, at = runs(streams, run)
    _, low, high, number = _extremes(classes, contents[page])
    twice = (low != high)[number]
    return _covered(streams, page[twice], at[twice], run)


def _keys(streams: list[np.ndarray], page: np.ndarray, at: np.ndarray, run: int) -> np.ndarray:
    """The 64-bit names by which lots know runs."""
    starts = np.cumsum([0, *map(len, streams)])[page] + at
    tokens, key = np.concatenate(streams).view(np.uint64), np.zeros(len(starts), np.uint64)
    for i in range(run):
        key = (key ^ tokens[starts + i]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


_PARSED = "row long, page_id long, url string, host string, kinds array<byte>, texts array<string>, words array<long>, sizes array<int>, marks array<long>, content long, shape long, usual array<boolean>"


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_64_intdigest
    names = [c.split()[0] for c in _PARSED.split(", ")]
    kinds = (pa.list_(pa.int8()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.list_(pa.bool_()))
    for batch in batches:
        rows = []
        for page in batch["html"]:
            parsed = blocks(page.as_py())
            outside = [t.split() for k, t in parsed if k != ARTICLE]
            rows.append((
                [k for k, _ in parsed], [t for _, t in parsed], [_signed(digest(w)) for words in outside for w in words], [len(t.split()) for _, t in parsed],
                [_signed(digest(t, 1)) for k, t in parsed if k == ARTICLE], _signed(digest("\n".join(t for _, t in parsed), 2)), _signed(digest(bytes(k for k, _ in parsed), 3)), markup_alone(parsed),
            ))
        columns = list(zip(*rows)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch["row"], batch["page_id"], batch["url"], batch["host"], *(pa.array(c, k) for c, k in zip(columns, kinds))], names)


def _lists(table: pa.Table, name: str) -> list[np.ndarray]:
    column = table[name].combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(flat, np.cumsum(ends)[:-1])


_RUNS = "host string, lot int, key long, content long, article boolean"


def _nearly_all(n: np.ndarray, pages: int) -> np.ndarray:
    return 10 * n >= 9 * pages


def _usual_marks(marks: list[np.ndarray], contents: np.ndarray) -> np.ndarray:
    """The blocks that nearly all different contents have."""
    pairs = np.unique(np.stack((np.concatenate(marks), np.repeat(contents, [len(m) for m in marks]))), axis=1)
    every, counts = np.unique(pairs[0], return_counts=True)
    return every[_nearly_all(counts, len(np.unique(contents)))]


def _lot_runs(table: pa.Table, run: int, site_wide: int) -> pa.Table:
    """What a lot of a host with several tells the others.

    Its runs outside articles, with the content of the pages that have them
    (null: several), and the blocks that nearly all its articles have: what
    nearly all of a host's pages have is such a block of some lot.
    """
    names, kinds = [c.split()[0] for c in _RUNS.split(", ")], [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
    streams, contents = _lists(table, "words"), table["content"].to_numpy()
    classes, page, at = runs(streams, run)
    one, low, high, _ = _extremes(classes, contents[page])
    keys = _keys(streams, page[one], at[one], run) if len(one) else np.empty(0, np.int64)
    marks = _usual_marks(_lists(table, "marks"), contents) if table["pages"][0].as_py() >= site_wide else np.empty(0, np.int64)
    size = len(keys) + len(marks)
    content = pa.array(np.concatenate((low, np.zeros(len(marks), np.int64))), mask=np.concatenate((low != high, np.ones(len(marks), bool))))
    columns = [[table["host"][0].as_py()] * size, [table["lot"][0].as_py()] * size, np.concatenate((keys, marks)), content, np.arange(size) >= len(keys)]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


_DECIDED = "of_host string, of_content long, of_shape long, stays array<boolean>"


def decide(kinds: list[int], sizes: list[int], covered: np.ndarray, site_wide: list[bool]) -> list[bool]:
    """Which blocks of a page stay; ``covered`` are its tokens outside articles, ``site_wide`` its article's blocks."""
    unique, of_article, at, articles = [], 0, 0, iter(site_wide)
    for kind, size in zip(kinds, sizes):
        if kind == ARTICLE:
            unique.append(not next(articles))
            of_article += size
        else:
            unique.append(2 * int(covered[at : at + size].sum()) < size)
            at += size
    alone = sum(size for kind, size, once in zip(kinds, sizes, unique) if kind == OPEN and once)
    give_way = ARTICLE in kinds and alone <= 4 * of_article
    return [once and kind != MARKED and not (kind == OPEN and give_way) for kind, once in zip(kinds, unique)]


def markup_alone(parsed: list[tuple[int, str]]) -> list[bool]:
    """The verdict on a page of which nothing is repeated."""
    kinds, sizes = [k for k, _ in parsed], [len(t.split()) for _, t in parsed]
    outside = sum(size for kind, size in zip(kinds, sizes) if kind != ARTICLE)
    return decide(kinds, sizes, np.zeros(outside, bool), [False] * kinds.count(ARTICLE))


def _decide(table: pa.Table, known: pa.Table, run: int, site_wide: int) -> pa.Table:
    """The verdicts on those pages of a lot for which repetition matters; ``known`` are the host's repeated runs and site-wide blocks, if it has several lots."""
    streams, marks, contents = _lists(table, "words"), _lists(table, "marks"), table["content"].to_numpy()
    if table["lots"][0].as_py() < 2:
        covered = repeated(streams, contents, run)
        wide = _usual_marks(marks, contents) if table["pages"][0].as_py() >= site_wide else np.empty(0, np.int64)
    else:
        keys = known["key"].to_numpy()
        classes, page, at = runs(streams, run)
        twice = np.isin(_keys(streams, page, at, run), keys) if len(at) else np.empty(0, bool)
        covered, wide = _covered(streams, page[twice], at[twice], run), keys
    rows = []
    for host, content, shape, kinds, sizes, usual, mark, cover in zip(*(table[c].to_pylist() for c in ("host", "content", "shape", "kinds", "sizes", "usual")), marks, covered):
        stays = decide(kinds, sizes, cover, np.isin(mark, wide).tolist())
        if stays != usual:
            rows.append((host, content, shape, stays))
    columns = list(zip(*rows)) or [()] * 4
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.bool_()))
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in _DECIDED.split(", ")])


def extract(pages: DataFrame, run: int = RUN, lot: int = LOT, site_wide: int = SITE_WIDE) -> DataFrame:
    """One row for each row of ``pages``: ``page_id, url, text, n_chars``.

    The whole html is read; null counts as empty.  White space inside a block
    becomes one space, blocks are joined by line feeds.  Pages of null or bad
    urls form one host.  Repeated rows are pages of their own and equal ones
    have equal results; copies count once in what a host's pages share.  What
    nine tenths of a host's different contents have in their articles goes from
    ``site_wide`` contents on; a host with fewer says too little about that.
    Other columns are not read.
    """
    host, _ = host_and_path()
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), "html")
    parsed = stash(rows.mapInArrow(_parse, _PARSED), "parsed")
    # tables that are written have known sizes: Spark broadcasts them only where they are small
    first = stash(parsed.groupBy("host", "content", "shape").agg(F.min("row").alias("row"), F.max(F.size("words")).alias("tokens")), "first")
    sizes = first.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages")).join(first.groupBy("host").agg(F.sum("tokens").alias("tokens")), "host")
    lots = F.greatest(F.ceil(F.col("pages") / lot), F.ceil(F.col("tokens") / LOT_TOKENS), F.lit(1)).cast("int")
    sizes = stash(sizes.select("host", "pages", lots.alias("lots")), "hosts")
    once = parsed.select("row", "host", "kinds", "sizes", "words", "marks", "content", "shape", "usual").join(first.select("row"), "row", "left_semi")
    dealt = once.join(sizes, "host").withColumn("lot", F.pmod("content", "lots").cast("int"))
    several = dealt.where("lots > 1").select("host", "lot", "words", "marks", "content", "pages")
    own = stash(several.groupBy("host", "lot").applyInArrow(lambda t: _lot_runs(t, run, site_wide), _RUNS), "runs")
    shared = own.where("not article").groupBy("host", "key").agg(F.min("content").alias("low"), F.max("content").alias("high"), F.bool_or(F.col("content").isNull()).alias("twice"))
    shared = shared.where("twice or low <> high").select("host", "key")
    likely = stash(own.where("article").select("host", "key").distinct(), "likely")
    having = once.select("host", "content", F.explode(F.array_distinct("marks")).alias("key")).join(likely, ["host", "key"], "left_semi").distinct()
    having = having.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"))
    wide = having.join(sizes, "host").where(10 * F.col("n") >= 9 * F.col("pages")).select("host", "key")
    known = dealt.where("lots > 1").select("host", "lot").distinct().join(stash(wide, "wide"), "host")
    known = known.unionByName(own.where("not article").select("host", "lot", "key").join(stash(shared, "shared"), ["host", "key"]))
    known = known.select(F.col("host").alias("of_host"), F.col("lot").alias("of_lot"), "key")
    decided = dealt.groupBy("host", "lot").cogroup(known.groupBy("of_host", "of_lot")).applyInArrow(lambda a, b: _decide(a, b, run, site_wide), _DECIDED)
    same = (F.col("host") == F.col("of_host")) & (F.col("content") == F.col("of_content")) & (F.col("shape") == F.col("of_shape"))
    out = parsed.select("page_id", "url", "host", "content", "shape", "texts", "usual").join(stash(decided, "decided"), same, "left")
    text = F.array_join(F.filter("texts", lambda t, i: F.element_at(F.coalesce("stays", "usual"), i + 1)), "\n")
    return out.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
