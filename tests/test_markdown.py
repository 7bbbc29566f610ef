"""Markdown as plain text, Markdown of groups, and cells."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.markdown import plain_inline, plain_text
from corpusloom.operators import render

CASES = {
    "# Title #\n\nFirst.\n": "Title\n\nFirst.",
    "Title\n===\nText\n\nPart\n---\nmore": "Title\n\nText\n\nPart\n\nmore",
    "- one\n- two\n": "- one\n- two",
    "* one\n  goes on\n\n* two\n\nafter": "- one\n  goes on\n- two\n\nafter",
    "3. three\n4. four\n": "3. three\n4. four",
    "1. a\n1. b\n1. c": "1. a\n2. b\n3. c",
    "1. first\n\nbetween\n\n1. second": "1. first\n\nbetween\n\n1. second",
    "- a\n    - b\n        - c\n    - d\n- e": "- a\n  - b\n    - c\n  - d\n- e",
    "- a\n    1. x\n    2. y\n- b": "- a\n  1. x\n  2. y\n- b",
    "| m | n |\n| --- | :-: |\n| 1 | 2 |\n| 3 |  |\n\nend": "m: 1\nn: 2\n\nm: 3\n\nend",
    "a | b\n--|--\n*x* | `y\\|z`": "a: x\nb: y|z",
    "say\n\n```python\ndef f():\n    return 1\n# no\n```\nso": "say\n\ndef f():\n    return 1\n# no\n\nso",
    "~~~\n```\n| a |\n~~~": "```\n| a |",
    "    four\n    more": "four\nmore",
    "> said\n> > twice": "said\ntwice",
    "<div>\n# raw\n</div>\n\n# H": "<div>\n# raw\n</div>\n\nH",
    "a\n\n---\n\nb": "a\n\nb",
    "a  \nb\\\nc": "a\nb\nc",
    "2024. was\na year": "2024. was\n  a year", "It was\n2024. a year": "It was\n2024. a year",
    "": "", "\n\n": "", "x": "x",
}


@pytest.mark.parametrize("source", CASES)
def test_plain_text(source):
    assert plain_text(source) == CASES[source]


def test_plain_inline():
    for source, want in {
        "**a** _b_ `c` ***d***": "a b c d", "snake_case_x 2*3*4": "snake_case_x 234", "[t](http://u \"T\") [http://u](http://u) <http://v>": "t (http://u) http://u http://v",
        "![alt](p.png) ![](q.png)": "alt (p.png) q.png", "\\*no\\* `a*b*c` &amp; &lt;": "*no* a*b*c & <", "`` a`b ``": "a`b", "[a_b_c](http://x/d_e_f)": "a_b_c (http://x/d_e_f)", "C:\\Users": "C:\\Users",
    }.items():
        assert plain_inline(source) == want, source


def test_escaped_text_reads_the_same(spark):
    lines = "# no|## no|#|- no|+ no|* no|1. no|12) no|> no|```|~~~ x|---|***|===|a_b _c_|**b**|`c`|<b>x</b>|&amp; x|[t](http://u)|C:\\Users\\x".split("|")
    rows = spark.createDataFrame([(f"Before.\n{line}\nAfter.",) for line in lines], "t string")
    for r in rows.select("t", render.plain_markdown(T.escaped_markdown("t")).alias("plain")).collect():
        assert r["plain"].split() == r["t"].split(), r["t"]


def test_time_is_linear():
    import time

    began = time.process_time()
    for line in ("- a", "  " * 9 + "- b", "| a | b |", "> q", "*" * 40, "[a" * 20, "`" * 30, "1. x"):
        plain_text("\n".join([line] * 5000))
    assert time.process_time() - began < 20


def test_group_markdown(spark):
    links = f"\n\n## {render.LINKS_HEADING}\n\n1. A — http://a\n2. B — http://b"
    rows = [
        ("f", 1, "*G*", None, "Tytuł: *T* #1\nPlik: a_b.txt", "# X\n\nbody\n\n##### Y" + links),
        ("f", 2, "*G*", " ", "Typ źródła: x\nPlik: p.txt", "plain"),
        ("f", 3, "*G*", None, "Adres: http://u", f"text\n\n## {render.LINKS_HEADING}\n\nnot a list"),
        ("f", 4, "*G*", None, None, None),
        ("f", 5, "*G*", "Given", "Identyfikator źródła: i", links.strip()),
    ]
    body = render.group_markdown(spark.createDataFrame(rows, "file_id string, pos int, group string, title string, header string, text string")).first()["body"]
    pinned = f"### {render.LINKS_HEADING}\n\n1. A — http://a\n2. B — http://b"
    assert body == "\n\n".join([
        "# \\*G\\*", "## \\*T\\* #1", "- Tytuł: \\*T\\* #1\n- Plik: a_b.txt", "### X", "body", "#### Y", pinned,
        "## p.txt", "- Typ źródła: x\n- Plik: p.txt", "plain", "## http://u", "- Adres: http://u", "text", f"### {render.LINKS_HEADING}", "not a list",
        f"## {render.UNTITLED}", "## Given", "- Identyfikator źródła: i", pinned,
    ])


def test_cells(spark):
    rows = spark.createDataFrame([(0.125, "0.0%", True), (1 / 3, None, False), (5.0, "0", None), (1e20, "0%", True), (None, "0%", None)], "v double, f string, b boolean")
    got = rows.select(T.cell_text("v", "double", "f").alias("v"), T.cell_text("b", "boolean").alias("b")).collect()
    assert [r["v"] for r in got][:3] == ["12.5%", "0.333333333333333", "5"] and got[3]["v"].endswith("%") and got[4]["v"] is None
    assert [r["b"] for r in got] == ["prawda", "fałsz", None, "prawda", None]


def test_markdown_words(spark):
    md = "# T\n\nA **b**.\n\n- one\n\n| a | b |\n| --- | --- |\n| 1 | 2 |"
    assert spark.createDataFrame([(md,), (None,)], "t string").select(render.markdown_words(F.col("t"))).collect()[0][0] == len(plain_text(md).split())
