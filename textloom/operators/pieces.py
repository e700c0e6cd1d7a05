"""Cutting one block that is too large into pieces within a budget."""

from __future__ import annotations

import re
from collections.abc import Callable

from textloom.functions.text import URL
from textloom.model import Block
from textloom.operators import html_tables
from textloom.options import BlockOption

#: Where sentences end, and what a cell of a table's second line is.
SENTENCE = re.compile(r"(?<=[.!?。！？])\s+")
DELIMITER = re.compile(r":?-+(?::?-+)*:?")

Count = Callable[[str], int]


def pack(parts: list[str], limit: int, join: str, count: Count) -> list[str]:
    """Greedy: each piece takes parts as long as the joined text fits."""
    out: list[str] = []
    for p in parts:
        joined = out[-1] + join + p if out else p
        if out and count(joined) <= limit:
            out[-1] = joined
        else:
            out.append(p)
    return out


def hard(text: str, limit: int, count: Count) -> list[str]:
    """Longest fitting prefixes, found by doubling and bisection; at least one character each."""
    out, at = [], 0
    while at < len(text):
        fits, step = at, 1
        while (end := min(len(text), at + step)) > fits and count(text[at:end]) <= limit:
            fits, step = end, step * 2
        lo, hi = fits, min(len(text), at + step)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if count(text[at:mid]) <= limit else (lo, mid)
        end = max(lo, at + 1)
        if piece := text[at:end].strip():
            out.append(piece)
        at = end
    return out


def text_pieces(text: str, limit: int, count: Count) -> list[str]:
    """Paragraphs, lines, sentences or words: the first of these whose parts all fit; else hard cuts.

    A text with a URL that alone is over the limit stays whole.
    """
    if count(text) <= limit or any(count(u) > limit for u in URL.findall(text)):
        return [text]
    strip = lambda parts: [s for p in parts if (s := p.strip())]
    levels = (
        (lambda: strip(text.split("\n\n")), "\n\n"),
        (lambda: strip(text.split("\n")), "\n"),
        (lambda: strip(SENTENCE.split(text)), " "),
        (lambda: [p for p in text.split(" ") if p], " "),
    )
    for cut, join in levels:
        parts = cut()
        if len(parts) > 1 and all(count(p) <= limit for p in parts):
            return pack(parts, limit, join, count)
    return hard(text, limit, count)


def code_pieces(block: Block, limit: int, count: Count) -> list[str]:
    """The code cut as text, each piece in a fence of its own."""
    info = (block.attrs.get("info") or block.attrs.get("language") or "").strip()
    fence = f"```{info}".rstrip()
    frame = count(f"{fence}\n\n```")
    if frame >= limit:
        return [block.text]
    return [f"{fence}\n{p}\n```" for p in text_pieces(block.attrs.get("literal", ""), limit - frame, count)]


def _row_groups(rows: list[str], limit: int, render: Callable[[list[str], bool], str], count: Count, recheck: bool) -> list[str]:
    """Rows grouped greedily; ``render(rows, first)`` makes a piece. A row that fits nowhere is a piece alone.

    ``recheck``: a row that opens a group because the last one is full is measured alone at once.
    """
    out: list[str] = []
    group: list[str] = []
    for row in rows:
        grown = render([*group, row], not out)
        if count(grown) <= limit:
            group = [*group, row]
            continue
        if not group:
            out.append(grown)
            continue
        out.append(render(group, not out))
        group = [row]
        if recheck and count(alone := render(group, not out)) > limit:
            out.append(alone)
            group = []
    return [*out, render(group, not out)] if group else out


def table_pieces(block: Block, limit: int, repeat: bool, count: Count) -> list[str]:
    """A pipe table by rows, its two header lines before each piece or before the first."""
    lines = [line.rstrip() for line in block.text.splitlines() if line.strip()]
    cells = [c.strip() for c in lines[1].strip().strip("|").split("|")] if len(lines) > 2 else []
    if not cells or not all(c and DELIMITER.fullmatch(c) for c in cells):
        return text_pieces(block.text, limit, count)
    return _row_groups(lines[2:], limit, lambda rows, first: "\n".join([*(lines[:2] if repeat or first else []), *rows]), count, True) or [block.text]


def html_table_pieces(block: Block, limit: int, repeat: bool, count: Count) -> list[str]:
    """Each table by data rows, between its own tags, with caption and header rows."""
    out: list[str] = []
    for t in html_tables.extract(block.text):
        if not t.rows:
            out.append(t.html)
            continue
        head = [t.open_tag or "<table>", *([t.caption_html] if t.caption else [])]
        headers = [r.html for r in t.headers]
        out += _row_groups([r.html for r in t.rows], limit, lambda rows, first, head=head, headers=headers: "\n".join([*head, *(headers if repeat or first else []), *rows, "</table>"]), count, False)
    return out or [block.text]


def list_pieces(block: Block, limit: int, count: Count) -> list[str]:
    """Items packed by lines; if a pack is too large, item by item."""
    items = [i for i in block.items if i]
    if len(items) < 2:
        return text_pieces(block.text, limit, count)
    packed = pack(items, limit, "\n", count)
    if all(count(p) <= limit for p in packed):
        return packed
    return [p for i in items for p in text_pieces(i, limit, count)]


def block_pieces(block: Block, budget: int, options: dict[str, BlockOption], count: Count) -> list[str] | None:
    """Pieces of a block, or None where blocks of its kind stay whole."""
    o = options.get(block.kind.lower()) or BlockOption(block.kind)
    if not o.split:
        return None
    limit = o.max_tokens or budget
    if block.kind in ("code_block", "code_fence"):
        return code_pieces(block, limit, count)
    if block.kind == "list" and block.items:
        return list_pieces(block, limit, count)
    if block.kind == "table":
        return table_pieces(block, limit, o.repeat_header, count)
    if block.kind == "html_table":
        return html_table_pieces(block, limit, o.repeat_header, count)
    return text_pieces(block.text, limit, count)
