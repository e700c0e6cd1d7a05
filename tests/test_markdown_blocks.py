"""Containers' children, block kinds of one's own, configuration, and time on long texts."""

import random
import time

import pytest

from textloom.model import Block
from textloom.operators import markdown
from textloom.operators.markdown import BlockSpec, MarkdownConfig, Parser, _Open


@pytest.mark.parametrize("body", ["lazy", "> a", "\n".join(["> a", "lazy"]), "\n".join(["> - a", "lazy", "> > b"]), "\\[ x", "$$", "- item", "a | b", "    - x", "[ref", "<!--", "> ```", "1. a"])
def test_long_texts_take_time_in_proportion(body):
    lines = 30_000
    text = "> start\n" + "\n".join([body] * (lines // (body.count("\n") + 1)))
    began = time.perf_counter()
    markdown.parse(text)
    assert time.perf_counter() - began < 15


def slow_open(lines, config=MarkdownConfig()):
    if not lines or not lines[-1].strip(" \t"):
        return False
    blocks = Parser(config).parse(lines, 0)
    if not blocks:
        return False
    kind, _, end, inner = blocks[-1]
    return end == len(lines) and (kind == "paragraph" or kind in ("list", "blockquote") and bool(inner) and slow_open(inner[-1][2], config))


@pytest.mark.parametrize("seed", range(60))
def test_open_paragraphs_line_by_line(seed):
    r = random.Random(seed)
    some = ["text", "- a", "> q", "> - x", "```", "    code", "", "| a | b |", "| - | - |", "1. one", "2. two", "# h", "***", "[a]: /b", "<div>", "  more", "> ", "-", "> > deep", "<!-- c", "\\[ x", "y \\]", "$$ m", "a $$", "===", "- - z"]
    config = MarkdownConfig(setext=seed % 2 == 0)
    for _ in range(20):
        lines, is_open = [], _Open(config)
        for _ in range(r.randrange(1, 14)):
            lines.append(r.choice(some))
            if r.random() < 0.7:
                assert is_open(lines) == slow_open(lines, config), lines


def tree(blocks):
    return [(b.kind, b.text, b.start, b.end, tree(b.children)) for b in blocks]


def test_children_of_containers():
    t = markdown.parse("> # not a section\n> text\n>\n> - a\n>   b\n\n1. one\n\n   ```py\n   x\n   ```\n2. two\n")
    assert not t.root.children
    assert tree(t.root.blocks) == [
        ("blockquote", "> # not a section\n> text\n>\n> - a\n>   b", 1, 5, [
            ("paragraph", "> # not a section", 1, 1, []), ("paragraph", "> text", 2, 2, []),
            ("list", "> - a\n>   b", 4, 5, [("list_item", "> - a\n>   b", 4, 5, [("paragraph", "> - a\n>   b", 4, 5, [])])]),
        ]),
        ("list", "1. one\n\n   ```py\n   x\n   ```\n2. two", 7, 12, [
            ("list_item", "1. one\n\n   ```py\n   x\n   ```", 7, 11, [("paragraph", "1. one", 7, 7, []), ("code_fence", "   ```py\n   x\n   ```", 9, 11, [])]),
            ("list_item", "2. two", 12, 12, [("paragraph", "2. two", 12, 12, [])]),
        ]),
    ]


def admonition(lines, i):
    if not lines[i].startswith(":::"):
        return None
    return next((k - i + 1 for k in range(i + 1, len(lines)) if lines[k] == ":::"), None)


def test_block_kinds_of_ones_own():
    text = "a\n\n::: note\nhere\n\n- x\n:::\n\nb"
    plain = markdown.parse(text, config=MarkdownConfig(specs=(BlockSpec("note", admonition),)))
    assert [(b.kind, b.start, b.end) for b in plain.root.blocks] == [("paragraph", 1, 1), ("note", 3, 7), ("paragraph", 9, 9)] and plain.root.blocks[1].attrs == {"source": "note"}

    def handler(c):
        return Block("note", c.text, c.start + 1, c.end, children=c.children(c.start + 1, c.end - 1))

    made = markdown.parse(text, config=MarkdownConfig(specs=(BlockSpec("note", admonition, handler),)))
    assert tree(made.root.blocks)[1][4] == [("paragraph", "here", 4, 4, []), ("list", "- x", 6, 6, [("list_item", "- x", 6, 6, [("paragraph", "- x", 6, 6, [])])])]
    dropped = markdown.parse(text, config=MarkdownConfig(specs=(BlockSpec("note", admonition, lambda c: None),)))
    assert [b.kind for b in dropped.root.blocks] == ["paragraph", "paragraph"]
    inside = markdown.parse("> ::: n\n> t\n> :::\n", config=MarkdownConfig(specs=(BlockSpec("note", admonition, handler),)))
    assert inside.root.blocks[0].children[0].kind == "note"
    with pytest.raises(ValueError, match="doesn't declare"):
        markdown.parse(text, config=MarkdownConfig(specs=(BlockSpec("note", admonition, lambda c: Block("other", c.text)),)))


@pytest.mark.parametrize(("specs", "error"), [([BlockSpec("", admonition)], ValueError), ([BlockSpec("a", admonition)] * 2, ValueError), ([BlockSpec("table", admonition)], ValueError), ([BlockSpec("a", "x")], TypeError), ([BlockSpec("a", admonition, 3)], TypeError)])
def test_specs_are_validated(specs, error):
    with pytest.raises(error):
        MarkdownConfig(specs=tuple(specs))


def test_rules_decide_the_kinds():
    text = "---\na: b\n---\n\nT\n===\n\n| a |\n| - |\n\n$$x$$"
    kinds = lambda **o: [b.kind for b in markdown.parse(text, config=MarkdownConfig(**o)).root.blocks]
    assert kinds() == ["front_matter", "paragraph", "table", "math_block"]
    assert kinds(tables=False, math=False, front_matter=False) == ["paragraph"] * 4
    assert markdown.parse(text, config=MarkdownConfig(setext=True)).root.children[0].title == "T"
    assert "table" not in MarkdownConfig(tables=False).kinds and "note" in MarkdownConfig(specs=(BlockSpec("note", admonition),)).kinds
