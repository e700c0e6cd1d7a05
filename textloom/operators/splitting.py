"""One document's tree to drafts of chunks: three topologies, two ways of counting.

A document is split inside one task, from its own row alone; a corpus is split without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from textloom.model import SEP, Block, Heading, Path, Section, heading_text, join_blocks, render_path, shared_prefix
from textloom.operators.pieces import block_pieces
from textloom.options import SplitOptions, options_by_kind

#: Characters of a text's end whose growth by a separator stands for the whole text's.
TAIL = 8


@dataclass
class Entry:
    path: Path
    body: str
    start: int | None = None
    end: int | None = None


@dataclass
class Draft:
    entries: list[Entry]
    path: Path
    own: Heading | None
    head: int
    body: int
    origin: str
    kind: str = "paragraph"


@dataclass
class Measured:
    """A section with what incremental counting knows about it."""

    node: Section
    children: list[Measured] = field(default_factory=list)
    whole: bool = True  # no isolated block below
    body: int = 0
    subtree: int = 0  # without the own title
    tail: str = ""


def render(entries: list[Entry], outer: Path) -> str:
    """Entries with their headings, as far as these are neither outer nor the previous entry's."""
    if len(entries) == 1 and entries[0].path == outer:
        return entries[0].body
    out, before = [], outer
    for e in entries:
        shared = shared_prefix(before, e.path)
        keep = max(len(shared), len(outer))
        out.append(join_blocks([render_path(e.path[keep:]), e.body]))
        before = e.path
    return join_blocks(out)


def _lines(blocks: list[Block]) -> tuple[int | None, int | None]:
    starts = [b.start for b in blocks if b.start is not None]
    ends = [b.end for b in blocks if b.end is not None]
    return min(starts, default=None), max(ends, default=None)


def limit_depth(root: Section, deepest: int) -> Section:
    """A copy in which deeper sections are paragraphs of the nearest section that stays."""

    def demoted(s: Section) -> list[Block]:
        own = Block("paragraph", heading_text(s.level, s.title), s.start, s.start, attrs={"demoted_heading_level": str(s.level)})
        return [own, *s.blocks, *(b for c in s.children for b in demoted(c))]

    def copied(s: Section, path: Path) -> Section:
        out = replace(s, path=path, blocks=list(s.blocks), children=[])
        for c in s.children:
            if c.level > deepest:
                out.blocks += demoted(c)
            else:
                out.children.append(copied(c, (*path, (c.level, c.title))))
        return out

    return copied(root, root.path)


class Splitter:
    """Splits trees under a budget; subclasses count."""

    def __init__(self, options: SplitOptions, tokenizer) -> None:
        self.o, self.blocks = options, options_by_kind(options.blocks)
        self._raw, self._known = tokenizer.count, {}
        if getattr(tokenizer, "native", False):  # counted faster than looked up
            self.count = tokenizer.count
        self.isolated = {k for k, b in self.blocks.items() if b.isolated}
        self.sep = self.count(SEP)

    def count(self, text: str) -> int:
        n = self._known.get(text)
        if n is None:
            if len(self._known) > 20_000:
                self._known.clear()
            n = self._known[text] = self._raw(text)
        return n

    def head(self, path: Path) -> int:
        return self.count(render_path(path)) if path else 0

    def total(self, d: Draft) -> int:
        return d.head + self.sep + d.body

    def footprint(self, d: Draft) -> int:
        return self.total(d) if self.o.heading_sensitive else self.sep + d.body

    def fits(self, d: Draft) -> bool:
        return self.footprint(d) <= self.o.ideal

    # what the two ways of counting differ in
    def measure(self, s: Section) -> Measured:
        raise NotImplementedError

    def draft(self, entries: list[Entry], path: Path, own: Heading | None, origin: str, kind: str = "paragraph", estimate: int | None = None) -> Draft:
        raise NotImplementedError

    def merged(self, a: Draft, b: Draft, path: Path) -> tuple[list[Entry], int]:
        raise NotImplementedError

    def body_drafts(self, m: Measured) -> list[Draft]:
        raise NotImplementedError

    def own_draft(self, m: Measured) -> Draft:
        s = m.node
        return self.draft([Entry(s.path, join_blocks(b.text for b in s.blocks), *_lines(s.blocks))], s.path, s.path[-1] if s.path else None, "section", estimate=m.body)

    def split(self, root: Section) -> list[Draft]:
        self._known.clear()
        if self.o.max_heading_level is not None:
            root = limit_depth(root, self.o.max_heading_level)
        return {"section": self._sections, "subtree": self._subtrees, "sibling": self._siblings}[self.o.topology](self.measure(root))

    def merge(self, a: Draft, b: Draft, path: Path) -> Draft:
        entries, body = self.merged(a, b, path)
        own = next((d.own for d in (a, b) if path and d.path == path and d.own == path[-1]), None)
        return Draft(entries, path, own, self.head(path), body, "merge", a.kind)

    def merge_tails(self, drafts: list[Draft], path: Path) -> list[Draft]:
        """From the right, small drafts of a section go into the one before, as far as both stay in the limit."""
        if self.o.merge_below <= 0:
            return drafts
        out = list(drafts)
        for i in range(len(out) - 1, 0, -1):
            a, b = out[i - 1], out[i]
            if a.path == b.path == path and b.entries and self.footprint(b) < self.o.merge_below and a.kind == b.kind == "paragraph":
                both = self.merge(a, b, path)
                if self.footprint(both) <= self.o.max_tokens:
                    out[i - 1 : i + 1] = [both]
        return out

    def direct(self, m: Measured) -> list[Draft]:
        """The section's own blocks, without its children's."""
        s = m.node
        if not s.blocks and s.level <= 0:
            return []
        d = self.own_draft(m)
        return [d] if self.fits(d) and not self._has_isolated(s) else self.body_drafts(m)

    def _has_isolated(self, s: Section) -> bool:
        return any(b.kind in self.isolated for b in s.blocks)

    def entries_below(self, s: Section) -> list[Entry]:
        own = [Entry(s.path, join_blocks(b.text for b in s.blocks), *_lines(s.blocks))] if s.blocks or (not s.children and s.level > 0) else []
        return own + [e for c in s.children for e in self.entries_below(c)]

    def single(self, m: Measured) -> Draft | None:
        """The whole subtree as one draft, if nothing in it must stand alone."""
        if not m.whole:
            return None
        if m.node.level == 0 and not m.node.blocks and len(m.children) == 1:
            m = m.children[0]
        path = m.node.path
        return self.draft(self.entries_below(m.node), path, path[-1] if path else None, "section", estimate=m.subtree)

    def _fitting(self, m: Measured) -> Draft | None:
        d = self.single(m)
        return d if d is not None and self.fits(d) else None

    def _sections(self, m: Measured) -> list[Draft]:
        return self.merge_tails(self.direct(m), m.node.path) + [d for c in m.children for d in self._sections(c)]

    def _subtrees(self, m: Measured) -> list[Draft]:
        s = m.node
        if not (s.blocks or m.children or s.level > 0):
            return []
        if whole := self._fitting(m):
            return [whole]
        return self.merge_tails(self.direct(m), s.path) + [d for c in m.children for d in self._subtrees(c)]

    def _siblings(self, m: Measured) -> list[Draft]:
        s = m.node
        if not (s.blocks or m.children or s.level > 0):
            return []
        if whole := self._fitting(m):
            return [whole]
        if not m.children:
            return self.merge_tails(self.direct(m), s.path)
        out: list[Draft] = []
        open_: Draft | None = None

        def add(d: Draft) -> Draft:
            if open_ is None:
                return d
            both = self.merge(open_, d, s.path)
            if self.fits(both):
                return both
            out.append(open_)
            return d

        def barrier(drafts: list[Draft]) -> None:
            if open_ is not None:
                out.append(open_)
            out.extend(drafts)

        if s.blocks:
            own = self.own_draft(m)
            if self.fits(own) and not self._has_isolated(s):
                open_ = add(own)
            else:
                barrier(self.direct(m))
        for c in m.children:
            if d := self._fitting(c):
                open_ = add(d)
            else:
                barrier(self._siblings(c))
                open_ = None
        barrier([])
        return self.merge_tails(out, s.path)

    def _piece_drafts(self, s: Section, b: Block, budget: int, kind: str, whole_origin: str = "fragment") -> list[Draft]:
        own = s.path[-1] if s.path else None
        pieces = block_pieces(b, budget, self.blocks, self.count)
        texts, origin = ([b.text], whole_origin) if pieces is None else (pieces, "text_piece")
        return [self.draft([Entry(s.path, t, b.start, b.end)], s.path, own, origin, kind, estimate=self.count(t)) for t in texts]


class Exact(Splitter):
    """Every candidate is rendered and counted."""

    def measure(self, s: Section) -> Measured:
        children = [self.measure(c) for c in s.children]
        return Measured(s, children, not self._has_isolated(s) and all(c.whole for c in children))

    def draft(self, entries, path, own, origin, kind="paragraph", estimate=None) -> Draft:
        return Draft(entries, path, own, self.head(path), self.count(render(entries, path)), origin, kind)

    def merged(self, a: Draft, b: Draft, path: Path) -> tuple[list[Entry], int]:
        entries = [*a.entries, *b.entries]
        return entries, self.count(render(entries, path))

    def body_drafts(self, m: Measured) -> list[Draft]:
        s, o = m.node, self.o
        own = s.path[-1] if s.path else None
        fixed = (self.head(s.path) if o.heading_sensitive else 0) + self.sep
        if not s.blocks or (o.heading_sensitive and fixed >= o.max_tokens):
            return [replace(self.own_draft(m), origin="fragment")]
        budget = max(0, (o.max_tokens if fixed >= o.ideal else o.ideal) - fixed)
        out: list[Draft] = []
        group: list[Entry] = []
        made = lambda entries: self.draft(entries, s.path, own, "fragment")

        def flush() -> None:
            if group and render(group, s.path):
                b = Entry(s.path, join_blocks(e.body for e in group), *_lines([Block("", "", e.start, e.end) for e in group]))
                out.append(made([b]))
            group.clear()

        for b in s.blocks:
            if b.kind in self.isolated:
                flush()
                out += self._piece_drafts(s, b, budget, b.kind)
                continue
            e = Entry(s.path, b.text, b.start, b.end)
            if b.text and not self.fits(made([e])):
                flush()
                out += self._piece_drafts(s, b, budget, "paragraph")
                continue
            if group and not self.fits(made([*group, e])):
                flush()
            group.append(e)
        flush()
        return out


class Incremental(Splitter):
    """Sections are measured once; candidates are sums of what is known."""

    def delta(self, text: str) -> int:
        """Tokens that a separator after ``text`` adds, by the end of the text."""
        if not text:
            return 0
        end = text.rstrip("\n")[-TAIL:]
        return self.count(end + SEP) - self.count(end)

    def measure(self, s: Section) -> Measured:
        children = [self.measure(c) for c in s.children]
        texts = [b.text for b in s.blocks if b.text]
        body = sum(self.count(t + SEP) for t in texts[:-1]) + (self.count(texts[-1]) if texts else 0)
        subtree, tail = body, texts[-1] if texts else ""
        for c in children:
            title = heading_text(c.node.level, c.node.title)
            subtree += self.delta(tail) + self.count(title) + c.subtree
            if title and (c.node.blocks or c.children):
                subtree += self.delta(title)
            tail = c.tail
        if not tail and s.level > 0:
            tail = "#" * s.level + " " + s.title
        return Measured(s, children, not self._has_isolated(s) and all(c.whole for c in children), body, subtree, tail)

    def draft(self, entries, path, own, origin, kind="paragraph", estimate=None) -> Draft:
        return Draft(entries, path, own, self.head(path), estimate or 0, origin, kind)

    @staticmethod
    def _end(d: Draft) -> str:
        if not d.entries:
            return ""
        e = d.entries[-1]
        return e.body or ("#" * e.path[-1][0] + " " + e.path[-1][1] if e.path else "")

    def _below(self, d: Draft, path: Path) -> tuple[int, str, bool]:
        """(tokens, end, presence) of a draft once its headings below ``path`` are part of the body."""
        inner = d.path[len(path) :]
        exposed = render_path(inner)
        present = any(e.body or e.path != d.path for e in d.entries)
        n = self.head(inner) + d.body + (self.delta(exposed) if exposed and present else 0)
        return n, self._end(d) if present else exposed, bool(exposed) or present

    def merged(self, a: Draft, b: Draft, path: Path) -> tuple[list[Entry], int]:
        n, end, there = self._below(a, path)
        k, _, too = self._below(b, path)
        return [*a.entries, *b.entries], n + k + (self.delta(end) if there and too else 0)

    def body_drafts(self, m: Measured) -> list[Draft]:
        s, o = m.node, self.o
        own = s.path[-1] if s.path else None
        fixed = (self.head(s.path) if s.level > 0 and o.heading_sensitive else 0) + self.sep
        if not s.blocks or fixed >= o.max_tokens:
            return [replace(self.own_draft(m), origin="fragment")]
        budget = max(0, (o.max_tokens if o.heading_sensitive and fixed >= o.ideal else o.ideal) - fixed)
        out: list[Draft] = []
        group: list[Block] = []
        size = 0

        def flush() -> None:
            if body := join_blocks(b.text for b in group):
                out.append(self.draft([Entry(s.path, body, *_lines(group))], s.path, own, "fragment", estimate=size))
            group.clear()

        for b in s.blocks:
            if b.kind in self.isolated:
                flush()
                out += self._piece_drafts(s, b, budget, b.kind)
                continue
            n = self.count(b.text)
            grown = size - self.count(group[-1].text) + self.count(group[-1].text + SEP) + n if group else n
            if group and grown > budget:
                flush()
                grown = n
            if n <= budget:
                group.append(b)
                size = grown
                continue
            out += self._piece_drafts(s, b, budget, "paragraph")
        flush()
        return out


def splitter(options: SplitOptions, tokenizer) -> Splitter:
    return (Exact if options.exact else Incremental)(options, tokenizer)
