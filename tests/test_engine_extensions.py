"""Parsers, splitters and block kinds of one's own, child blocks as a relation, and clashing columns."""

import pytest

from textloom.model import Block, Section, Tree
from textloom.operators.markdown import BlockSpec, MarkdownConfig
from textloom.operators.splitting import splitter
from textloom.options import BlockOption, SplitOptions
from textloom.plans.engine import ChunkEngine


def docs(spark, text, **more):
    return spark.createDataFrame([(1, text)], "doc_id long, text string").selectExpr("*", "'markdown' as format", *(f"'{v}' as `{k}`" for k, v in more.items()))


def test_block_kinds_reach_splitting(spark):
    def note(lines, i):
        return next((k - i + 1 for k in range(i + 1, len(lines)) if lines[k] == ":::"), None) if lines[i].startswith(":::") else None

    engine = ChunkEngine(SplitOptions(blocks=(BlockOption("note", isolated=True),)), markdown=MarkdownConfig(specs=(BlockSpec("note", note),)))
    got = engine.split(docs(spark, "# A\n\none\n\n::: x\ntwo\n:::\n\nthree")).collect()
    assert [(r.chunk_type, r.body) for r in got] == [("paragraph", "one"), ("note", "::: x\ntwo\n:::"), ("paragraph", "three")]
    assert ChunkEngine(markdown=MarkdownConfig(setext=True)).split(docs(spark, "T\n=\n\nx")).first().own_heading.title == "T"


def test_parser_of_ones_own(spark):
    def parser(source, title, metadata):
        root = Section(0, "mine")
        root.blocks = [Block("paragraph", x) for x in source.split(";")]
        return Tree(root, title or "mine", metadata)

    got = ChunkEngine(parsers={"markdown": parser}).split(docs(spark, "a;b")).first()
    assert (got.body, got.document_title) == ("a\n\nb", "mine")
    with pytest.raises(ValueError, match="unknown formats"):
        ChunkEngine(parsers={"pdf": parser})


def test_splitter_of_ones_own(spark):
    def make(options, tokenizer):
        inner = splitter(options, tokenizer)
        split = inner.split
        inner.split = lambda root: split(root)[::-1]
        return inner

    text = "# A\n\none\n\n# B\n\ntwo"
    assert [r.body for r in ChunkEngine(splitter=make).split(docs(spark, text)).collect()] == ["two", "one"]


def test_children_are_a_relation(spark):
    got = ChunkEngine().trees(docs(spark, "# A\n\n> - x\n>   y\n")).first()
    assert [(c.section, c.ord, c.path, c.kind, c.start, c.end) for c in got.children] == [(1, 0, [0], "list", 3, 4), (1, 0, [0, 0], "list_item", 3, 4), (1, 0, [0, 0, 0], "paragraph", 3, 4)]


def test_clashing_columns(spark, tmp_path):
    names = "title drafts error body chunk_id _n _d _h body_input sections blocks children references".split()
    d = docs(spark, "# A\n\none", **{n: f"own {n}" for n in names})
    for name, out in (("s", ChunkEngine().split(d)), ("k", ChunkEngine(on_error="keep").split(d)), ("t", ChunkEngine().trees(d))):
        assert len({c.lower() for c in out.columns}) == len(out.columns)
        out.write.parquet(str(tmp_path / name))
        values = [v for v in spark.read.parquet(str(tmp_path / name)).first() if isinstance(v, str)]
        assert all(f"own {n}" in values for n in names)


@pytest.mark.parametrize(
    ("markup", "text"),
    [
        ("a<br>b<br/>c", "a\nb\n\nc"), ("<p class='x>y'>a &amp; b</P><i>c</i>", "\na & b\nc"), ("x<!-- <p> -->y<!DOCTYPE z>", "xy"), ("<script>a < b && '<p>' &lt;</script>!", "a < b && '<p>' &lt;!"), ("1 < 2 &copy; &unknown;", "1 < 2 © &unknown;"), ("", ""),
    ],
)
def test_text_of_markup(markup, text):
    from textloom.functions.text import html_text

    assert html_text(markup) == text
