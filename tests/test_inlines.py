"""Inline nodes: what they are, how they are written again, and that their time grows with the text."""

import time

import pytest

from textloom.operators import docx, markdown
from textloom.operators.inlines import parse, render
from textloom.plans.engine import ChunkEngine

REFS = {"ref": ("/x", "T")}


@pytest.mark.parametrize(
    ("text", "again"),
    [
        ("", ""),
        ("plain", "plain"),
        ("_a __b__ c_", "*a **b** c*"),
        ("***x***", "***x***"),
        ("a_b_c 2*3", "a_b_c 2*3"),
        ("*a **b*", "*a **b*"),
        ("``a ` b``", "`a ` b`"),
        ("` a `", "`a`"),
        ("~~s~~ ~t~", "~~s~~ ~t~"),
        ("[t _e_](</u> 'ti')", '[t *e*](/u "ti")'),
        ("![*a*](s.png)", "![*a*](s.png)"),
        ("[ref] [z][REF] [ref][] [no]", '[ref](/x "T") [z](/x "T") [ref](/x "T") [no]'),
        ("[[a](b)](c)", "[[a](b)](c)"),
        ("*a [b*](c)", "*a [b*](c)"),
        ("[x](javascript:y)", "[x](javascript:y)"),
        ("<http://a.b/c> <m@x.yz> <b>q</b>", "<http://a.b/c> <m@x.yz> <b>q</b>"),
        (r"\*a\* &amp; &copy; &nope; \q", r"*a* & © &nope; \q"),
        (r"$a_b_$ \(c_d_\) $5", "$a_b_$ $c_d_$ $5"),
        ("a  \nb\nc", "a\nb\nc"),
    ],
)
def test_canonical(text, again):
    assert render(parse(text, REFS)) == again


def test_kinds_and_attributes():
    link, text, code, hard, last = parse("[*a*](/u \"t\") `c`  \nx", {})
    assert (link.kind, link.attrs, link.children[0].kind) == ("link", {"destination": "/u", "title": "t"}, "emphasis")
    assert (text.text, code.kind, code.attrs, hard.kind, last.text) == (" ", "code_span", {"literal": "c"}, "hard_break", "x")
    assert [n.kind for n in parse("a\nb ![x](y) <br>", {})] == ["text", "soft_break", "text", "image", "text", "inline_html"]


@pytest.mark.parametrize("text", ["[" * 40000, "*a " * 40000, "*" * 30000 + "a" + "*" * 30000, "`a``" * 30000, '[](a "' * 20000, "<!--" * 30000, "$\\$" * 40000, "_a *b " * 30000, "[a" * 20000 + "](b)" * 20000])
def test_time_grows_with_the_text(text):
    start = time.perf_counter()
    assert len(render(parse(text, {}))) <= 2 * len(text)
    assert time.perf_counter() - start < 20


def test_titles_and_quotes():
    t = markdown.parse("# A _b [c][r]_\n\n> *q*\n\n- x `y`\n\n[r]: /z\n")
    markdown.add_inlines(t)
    s = t.root.children[0]
    assert s.title == "A *b [c](/z)*" and [n.kind for n in s.inlines] == ["text", "emphasis"]
    quote, items = s.blocks
    assert quote.children[0].inlines[0].kind == "emphasis"
    assert [n.kind for n in items.children[0].children[0].inlines][-1] == "code_span"


def test_runs_of_word_documents():
    from xml.etree import ElementTree

    w = docx.W[1:-1]
    run = lambda look, text: f"<w:r><w:rPr>{look}</w:rPr><w:t>{text}</w:t></w:r>"
    p = ElementTree.fromstring(f'<w:p xmlns:w="{w}">' + run("<w:b/><w:i/>", "a") + run("<w:b/>", "b") + run("<w:i/>", "c") + run('<w:u w:val="single"/>', "d") + run('<w:rFonts w:ascii="Consolas"/>', "e") + run('<w:b w:val="0"/>', "f") + run("", "") + "</w:p>")
    got = [(n.kind, n.text, [(c.kind, c.text) for c in n.children], n.attrs) for n in docx._inlines(p)]
    assert got == [
        ("strong", "", [("emphasis", "a")], {}), ("strong", "", [("text", "b")], {}), ("emphasis", "c", [], {}), ("text", "d", [], {"underline": "true"}),
        ("code_span", "e", [], {"literal": "e"}), ("text", "f", [], {}),
    ]


def test_column(spark):
    d = spark.createDataFrame([(1, "# *a* b\n\n> x `y`\n", "mine"), (2, None, None), (3, "", "")], "id long, text string, inlines string")
    rows = {r.id: r for r in ChunkEngine().trees(d, inlines=True).collect()}
    assert [(n.ord, n.path, n.kind, n.text) for n in rows[1].inlines] == [(-1, [0], "emphasis", ""), (-1, [0, 0], "text", "a"), (-1, [1], "text", " b"), (0, [0, -1, 0], "text", "x "), (0, [0, -1, 1], "code_span", "y")]
    assert rows[1].inlines_input == "mine" and rows[2].inlines == rows[3].inlines == []
    assert "inlines" not in ChunkEngine().trees(d.drop("inlines")).columns
