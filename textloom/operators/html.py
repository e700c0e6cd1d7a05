"""HTML to a tree of sections, on the standard library's event parser."""

from __future__ import annotations

import re
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

from textloom.functions.text import clean
from textloom.model import Block, Inline, Outline, Tree

#: The tags that matter.
HEADINGS = {f"h{i}": i for i in range(1, 7)}
BLOCKS = {"p": "paragraph", "pre": "code_block", "blockquote": "blockquote"}
#: A character reference that ends as it should.
CLOSED = re.compile(r"&(?:#\d+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")
INLINES = {"strong": "strong", "b": "strong", "em": "emphasis", "i": "emphasis", "code": "code_span", "a": "link"}


class _Open:
    """A block, heading or item whose text is still coming in."""

    def __init__(self, kind: str, line: int) -> None:
        self.kind, self.line, self.parts = kind, line, []
        self.kinds: list[str] = []  # of the parts

    def text(self) -> str:
        return clean("".join(self.parts))

    def inlines(self) -> list[Inline]:
        return [Inline(k, t) for k, t in zip(self.kinds, self.parts, strict=True)]


class _Builder(HTMLParser):
    def __init__(self, source: str, metadata: dict[str, str], closed: bool = False) -> None:
        super().__init__(convert_charrefs=True)
        self.source, self.meta, self.out = source, metadata, Outline()
        self.starts = [0]
        for line in source.splitlines(keepends=True):
            self.starts.append(self.starts[-1] + len(line))
        self.title: list[str] | None = None
        self.feeds = [0, *(m.end() for m in re.finditer("\n", source))] if closed else []  # where lines begin, as the parser counts them
        self.from_ = 0  # where the title begins
        self.head = self.hidden = self.depth = 0  # open heads, scripts and styles, tables
        self.body = False
        self.heading = self.block = self.item = None
        self.lists: list[tuple[bool, int, list[str]]] = []
        self.within: list[str] = []  # kinds of the inline tags that are open
        self.table = (0, 0)

    @property
    def line(self) -> int:
        return self.getpos()[0]

    def place(self) -> int:
        line, column = self.getpos()
        return min(len(self.source), self.starts[line - 1] + column) if line <= len(self.starts) else len(self.source)

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("head", "body", "script", "style", "title", "meta"):
            self._about(tag, {k.lower(): v or "" for k, v in attrs})
        elif self.head or self.hidden:
            return
        elif tag == "table":
            if not self.depth:
                self.close_block()
                self.table = (self.place(), self.line)
            self.depth += 1
        elif self.depth:
            return
        elif tag in HEADINGS:
            self.close_block()
            self.heading = _Open(tag, self.line)
        elif tag in ("ul", "ol"):
            self.close_block()
            self.lists.append((tag == "ol", self.line, []))
        elif tag == "li":
            self.item = _Open("list_item", self.line)  # an item that is still open is lost with its text
        elif tag in BLOCKS and self.item is None:
            self.close_block()
            self.block = _Open(BLOCKS[tag], self.line)
        elif tag == "br":
            self.add("\n")
        elif tag == "img":
            self.add({k.lower(): v or "" for k, v in attrs}.get("alt", ""), "image")
        elif tag in INLINES:
            self.within.append(INLINES[tag])

    def _about(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "head":
            self.head += 1
        elif tag == "body":
            self.body = True
        elif tag == "title":
            self.title = []
            if self.feeds:
                self.from_ = self._at() + len(self.get_starttag_text() or "")
        elif tag == "meta":
            key = attrs.get("name") or attrs.get("property")
            if key and attrs.get("content"):
                self.meta.setdefault(key.lower(), attrs["content"])
        else:
            self.hidden += 1

    def handle_endtag(self, tag: str) -> None:
        if tag == "head":
            self.head = max(0, self.head - 1)
        elif tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "title":
            if title := clean(self._title()):
                self.meta.setdefault("title", title)
            self.title = None
        elif self.head or self.hidden:
            return
        elif self.depth:
            if tag == "table":
                self.depth -= 1
                if not self.depth:
                    self.close_table()
        elif self.heading is not None and tag == self.heading.kind:
            if title := self.heading.text():
                self.out.heading(HEADINGS[tag], title, self.heading.line, self.heading.inlines())
            self.heading = None
        elif self.block is not None and tag in BLOCKS:
            self.close_block()
        elif self.item is not None and tag == "li":
            if self.lists and (text := self.item.text()):
                self.lists[-1][2].append(text)
            self.item = None
        elif tag in ("ul", "ol") and self.lists:
            ordered, line, items = self.lists.pop()
            if items:
                mark = "1." if ordered else "-"
                self.out.block(Block("list", "\n".join(f"{mark} {i}" for i in items), line, self.line, list(items), {"ordered": str(ordered).lower()}))
        elif tag in INLINES and self.within:
            self.within.pop()

    def _at(self) -> int:
        line, column = self.getpos()
        return self.feeds[line - 1] + column

    def _title(self) -> str:
        """The title's text; where only closed references count, from the source, if that has no markup there."""
        raw = self.source[self.from_ : self._at()] if self.feeds and self.title is not None else "<"
        return "".join(self.title or ()) if "<" in raw else CLOSED.sub(lambda m: unescape(m[0]) if m[0][1] == "#" else html5.get(m[0][1:], m[0]), raw)

    def handle_data(self, data: str) -> None:
        if self.title is not None:
            self.title.append(data)
        elif not (self.head or self.hidden or self.depth):
            self.add(data)

    def add(self, text: str, kind: str | None = None) -> None:
        if not text:
            return
        target = self.heading or self.item or self.block
        if target is None and text.strip() and self.body:
            target = self.block = _Open("paragraph", self.line)
        if target is not None:
            target.parts.append(text)
            target.kinds.append(kind or (self.within[-1] if self.within else "text"))

    def close_block(self) -> None:
        done, self.block = self.block, None
        if done is None or not (text := done.text()):
            return
        attrs = {}
        if done.kind == "blockquote":
            text = "\n".join(f"> {line}" for line in text.splitlines())
        elif done.kind == "code_block":
            attrs["literal"] = "".join(done.parts).strip("\n")
            text = f"```\n{attrs['literal']}\n```"
        self.out.block(Block(done.kind, text, done.line, self.line, attrs=attrs, inlines=done.inlines()))

    def close_table(self) -> None:
        end = self.source.find(">", self.place()) + 1 or len(self.source)
        if html := self.source[self.table[0] : end].strip():
            self.out.block(Block("html_table", html, self.table[1], self.line, attrs={"literal": html}))


def parse(source: str, title: str | None = None, metadata: dict[str, str] | None = None, closed: bool = False) -> Tree:
    """``title`` counts if it isn't empty; else the page's own, else its first h1.

    Browsers resolve ``&amp`` without a semicolon too; with ``closed`` the page's title keeps such references as they are written.
    """
    b = _Builder(source, dict(metadata or {}), closed)
    b.feed(source)
    b.close()
    b.close_block()
    own = b.meta.get("title")
    found = title or (own.strip() if isinstance(own, str) and own.strip() else None) or b.out.first_h1() or "Anonymous"
    b.out.root.title = found
    return Tree(b.out.root, found, b.meta)
