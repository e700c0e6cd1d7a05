"""Splitting one document: literal expectations with a tokenizer of one token a character."""

import pytest

from textloom.functions.tokens import Approx, Characters
from textloom.model import Block
from textloom.operators import html, html_tables, markdown, pieces
from textloom.operators.splitting import Incremental, render, splitter
from textloom.options import BlockOption, SplitOptions


class FloorTen:
    def count(self, text):
        return len(text) // 10


def chunks(text, tok=None, parse=markdown.parse, **options):
    o = SplitOptions(**({"topology": "sibling", "ideal_ratio": 1.0, "merge_below_ratio": 0.0} | options))
    s = splitter(o, tok or Characters())
    return [(render(d.entries, d.path), s.total(d), d) for d in s.split(parse(text).root)], s


def bodies(text, **options):
    return [b for b, _, d in chunks(text, **options)[0] if b.strip()]


MODES = pytest.mark.parametrize("exact", [False, True])


@MODES
def test_heading_counts_towards_the_budget(exact):
    got, _ = chunks("# A\n\nBody", max_tokens=9, exact=exact)
    assert [(b, n) for b, n, _ in got] == [("Body", 9)]
    got, _ = chunks("# A\n\nBody", max_tokens=7, exact=exact)
    assert [(b, n) for b, n, _ in got] == [("Bo", 7), ("dy", 7)]


@MODES
def test_small_tails_merge(exact):
    text = "# A\n\nalpha1\n\nbravo2"
    assert bodies(text, max_tokens=30, ideal_ratio=0.5, exact=exact) == ["alpha1", "bravo2"]
    assert bodies(text, max_tokens=30, ideal_ratio=0.5, merge_below_ratio=0.967, exact=exact) == ["alpha1\n\nbravo2"]
    got, _ = chunks("# A\n\n" + "x " * 31 + "\n\ny", max_tokens=60, merge_below_ratio=0.167, exact=exact)
    assert [n for _, n, _ in got] == [60, 13] and got[1][0] == "x x x\n\ny"


@MODES
def test_siblings_pack(exact):
    assert bodies("# Parent\n\n## One\n\nA\n\n## Two\n\nB", max_tokens=40, ideal_ratio=0.8, merge_below_ratio=0.975, exact=exact) == ["## One\n\nA\n\n## Two\n\nB"]
    text = "# Root\n\n## Scope\n\n### A\n\nAlpha body.\n\n### B\n\nBeta body."
    assert bodies(text, max_tokens=80, exact=exact) == ["## Scope\n\n### A\n\nAlpha body.\n\n### B\n\nBeta body."]


@MODES
def test_merged_own_heading(exact):
    (_, _, d), *more = chunks("# First\n\na\n\n# Second\n\nb", max_tokens=200, exact=exact)[0]
    assert not more and d.own is None
    (body, _, d), *more = chunks("# Root\n\n## A\n\na\n\n## B\n\nb", max_tokens=200, exact=exact)[0]
    assert not more and d.own == (1, "Root") and body == "## A\n\na\n\n## B\n\nb"


@MODES
def test_list_pieces(exact):
    text = "- alpha alpha alpha alpha\n- beta beta beta beta\n- gamma gamma gamma gamma"
    assert bodies(text, max_tokens=20, exact=exact) == ["- alpha alpha", "alpha alpha", "- beta beta beta", "beta", "- gamma gamma", "gamma gamma"]
    assert bodies(text, max_tokens=20, exact=exact, blocks=(BlockOption("list", split=False),)) == [text]


@MODES
def test_table_pieces(exact):
    text = "| A | B |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\n| 5 | 6 |\n| 7 | 8 |"
    got, _ = chunks(text, max_tokens=31, exact=exact, blocks=(BlockOption("table", isolated=True),))
    assert [d.kind for *_, d in got] == ["table"] * 4 and all(b.startswith("| A | B |\n|---|---|\n") for b, *_ in got)
    got, _ = chunks(text, max_tokens=31, exact=exact, blocks=(BlockOption("table", isolated=True, repeat_header=False),))
    assert sum(b.startswith("| A") for b, *_ in got) == 1


@MODES
def test_code_pieces_keep_their_fence(exact):
    code = "print('a')\nprint('b')\nprint('c')"
    got = bodies(f"```python\n{code}\n```", max_tokens=28, exact=exact)
    assert len(got) == 3 and all(b.startswith("```python\n") and b.endswith("\n```") for b in got)
    assert "\n".join(b[len("```python\n") : -4] for b in got) == code


def test_long_url_stays_whole():
    text = "See https://example.com/a/very/long/path/that/never/ends for more."
    assert bodies(text, max_tokens=30) == [text]


@pytest.mark.parametrize(("ratio", "n"), [(0.0, 7), (0.5, 6)])
def test_approximate_tokens_by_section(ratio, n):
    got, _ = chunks("# A\n\n" + "x " * 200, tok=Approx(), topology="section", exact=True, max_tokens=40, ideal_ratio=0.5, merge_below_ratio=ratio)
    assert len(got) == n


def test_incremental_sums_floors():
    (_, n, d), *_ = chunks("# H\n\naaaaa\n\nbbbbb", tok=FloorTen(), max_tokens=100)[0]
    assert n == 0 and FloorTen().count(render(d.entries, d.path)) == 1


def test_subtree_measure():
    s = Incremental(SplitOptions(topology="sibling"), Characters())
    tree = markdown.parse("# Root\n\n## Scope\n\n### A\n\nAlpha body.\n\n### B\n\nBeta body.")
    assert s.measure(tree.root).children[0].children[0].subtree == 37


@MODES
def test_demoted_headings(exact):
    text = "# H1\n\n## H2\n\n### H3"
    got, _ = chunks(text, max_tokens=200, max_heading_level=0, exact=exact)
    assert [b for b, *_ in got] == [text] and got[0][2].path == ()


def test_hard_cuts():
    calls = 0

    def count(t):
        nonlocal calls
        calls += 1
        return len(t)

    got = pieces.hard("x" * 4096, 64, count)
    assert "".join(got) == "x" * 4096 and max(map(len, got)) <= 64 and calls < 2000


def test_sentences_before_words():
    assert pieces.text_pieces("One two. Three four. Five.", 14, len) == ["One two.", "Three four.", "Five."]
    assert pieces.text_pieces("一。 二。", 3, len) == ["一。", "二。"]


@pytest.mark.parametrize("topology", ["section", "subtree", "sibling"])
@MODES
def test_no_word_is_lost(topology, exact):
    text = "\n\n".join(f"{'#' * (1 + i % 4)} T{i}\n\n" + " ".join(f"w{i}x{j}" for j in range(i * 7 % 40)) for i in range(30))
    got, _ = chunks(text, topology=topology, exact=exact, max_tokens=90, ideal_ratio=0.8, merge_below_ratio=0.2)
    words = " ".join(b for b, *_ in got).split()
    assert sorted(w for w in words if "x" in w) == sorted(w for w in text.split() if "x" in w)


def test_markdown_tree():
    t = markdown.parse("---\ntitle: Guide\nauthor: Ada\n---\n\nintro\n\n# Overview `x`\n\n> quote\n> more\nlazy\n\n1. one\n2. two\n\n   more\n\n```py\n# no heading\n```\n\n    indented\n\n### _Deep_ [l][ref]\n\n***\n\n<div>\n<table></table>\n</div>\n\n[ref]: /target 'T'\n")
    assert t.title == "Guide" and t.metadata["author"] == "Ada" and t.references == {"ref": ("/target", "T")}
    assert [b.kind for b in t.root.blocks] == ["front_matter", "paragraph"]
    one = t.root.children[0]
    assert one.title == "Overview `x`"
    assert [(b.kind, b.start) for b in one.blocks] == [("blockquote", 10), ("list", 14), ("code_fence", 19), ("code_block", 23)]
    assert one.blocks[0].text.endswith("lazy") and one.blocks[1].items == ["1. one", "2. two\n\n   more"] and one.blocks[1].attrs["tight"] == "false"
    assert one.blocks[2].attrs == {"info": "py", "language": "py", "literal": "# no heading"} and one.blocks[3].text == "    indented"
    deep = one.children[0]
    assert deep.level == 3 and deep.title == '*Deep* [l](/target "T")' and [b.kind for b in deep.blocks] == ["html_table"]


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("Title\n=====", ["paragraph"]), ("---\n\nParagraph.", ["paragraph"]), ("a\n- b", ["paragraph", "list"]), ("a\n2. b", ["paragraph"]), ("$$\nx\n$$\n\ntext", ["math_block", "paragraph"]),
        ("\\[\nx\n\\] (1)", ["math_block_eqno"]), ("\\[ x \\]", ["math_block"]), ("| a | b |\n| - | - |\n| 1 | 2 |\n\nx", ["table", "paragraph"]), ("a\n```\ncode", ["paragraph", "code_fence"]), ("<b>x</b> y", ["paragraph"]),
        ("- a\n- b\n* c", ["list", "list"]), ("", []), ("\n \n", []), ("> a\n\n> b", ["blockquote", "blockquote"]), ("<!-- c -->\ntext", ["html_block", "paragraph"]),
    ],
)
def test_markdown_blocks(text, kinds):
    assert [b.kind for b in markdown.parse(text).root.blocks] == kinds


@pytest.mark.parametrize(("args", "title"), [((None,), "One"), (("",), ""), (("T",), "T")])
def test_markdown_titles(args, title):
    assert markdown.parse("## Two\n\n# One", *args).title == title
    assert markdown.parse("## Two").title == "Anonymous"


def test_html_tree():
    page = "<html><head><title> My  Page </title><meta name='Author' content='Ada'></head><body><h1>T <b>x</b></h1><p>one<p>two<br>three<ul><li>a<li>b</li><li>c</li></ul><pre>def f():\n    return 1</pre><blockquote>q</blockquote><script>no</script>loose<table id=t><tr><td>1</td></tr></table></body></html>"
    t = html.parse(page)
    assert t.title == "My Page" and t.metadata == {"title": "My Page", "author": "Ada"}
    blocks = t.root.children[0].blocks
    assert [(b.kind, b.text) for b in blocks] == [
        ("paragraph", "one"), ("paragraph", "two three"), ("list", "- b\n- c"), ("code_block", "```\ndef f():\n    return 1\n```"), ("blockquote", "> q"), ("paragraph", "loose"), ("html_table", "<table id=t><tr><td>1</td></tr></table>")
    ]
    assert html.parse("<p>x</p>", "").title == "Anonymous" and html.parse(page, "").title == "My Page"


def test_html_tables():
    table = "<table class=x><caption>Cap</caption><tr><th>A</th><th colspan=2>B|</th></tr><tr><td>1</td><td>2<br>3</td><td>4</td></tr><tr><td>5</td><td colspan=2>6</td></tr></table>"
    (t,) = html_tables.extract(f"<div>{table}</div><table><tr>")
    assert (t.caption, len(t.headers), len(t.rows), t.html) == ("Cap", 1, 2, table)
    assert html_tables.to_pipe(t) == "*Cap*\n| A | B\\| |\n| --- | --- |\n| 1 | 2\n3 | 4 |\n| 5 | 6 | 6 |"
    got = pieces.html_table_pieces(Block("html_table", table), 130, True, len)
    assert len(got) == 2 and all(p.startswith("<table class=x>\n<caption>Cap</caption>\n<tr><th>") and p.endswith("\n</table>") for p in got)
    assert len(html_tables.extract("<table><tr><td><table></table></td></tr></table>")) == 2
