"""What parsing hands to splitting: a tree of sections with blocks. Lives inside one task only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

SEP = "\n\n"
Heading = tuple[int, str]
Path = tuple[Heading, ...]


@dataclass
class Inline:
    """A piece of running text: a kind, and either text or children."""

    kind: str
    text: str = ""
    children: list[Inline] = field(default_factory=list)
    attrs: dict[str, str] = field(default_factory=dict)


@dataclass
class Block:
    kind: str
    text: str
    start: int | None = None
    end: int | None = None
    items: list[str] = field(default_factory=list)  # texts of a list's items
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Block] = field(default_factory=list)  # of quotes, lists and list items
    inlines: list[Inline] = field(default_factory=list)


@dataclass
class Section:
    level: int
    title: str
    path: Path = ()
    start: int | None = None
    blocks: list[Block] = field(default_factory=list)
    children: list[Section] = field(default_factory=list)
    inlines: list[Inline] = field(default_factory=list)  # of the title
    source: str = ""  # the title as written


@dataclass
class Tree:
    root: Section
    title: str = ""
    metadata: dict[str, str] = field(default_factory=dict)
    references: dict[str, tuple[str, str]] = field(default_factory=dict)


class Outline:
    """Grows a tree from headings and blocks in document order."""

    def __init__(self) -> None:
        self.root = Section(0, "")
        self._open = [self.root]

    def heading(self, level: int, title: str, line: int | None, inlines: list[Inline] | None = None) -> None:
        while len(self._open) > 1 and self._open[-1].level >= level:
            self._open.pop()
        parent = self._open[-1]
        section = Section(level, title, (*parent.path, (level, title)), line, inlines=inlines or [], source=title)
        parent.children.append(section)
        self._open.append(section)

    def block(self, block: Block) -> None:
        self._open[-1].blocks.append(block)

    def retitle(self, change: Callable[[Section], str]) -> None:
        """Change every section's title, and the paths with it."""
        todo = list(self.root.children)
        for s in todo:
            s.title = change(s)
        todo = [(s, ()) for s in todo]
        while todo:
            s, above = todo.pop()
            s.path = (*above, (s.level, s.title))
            for c in s.children:
                c.title = change(c)
                todo.append((c, s.path))

    def first_h1(self) -> str | None:
        return next((s.title for s in self.root.children if s.level == 1 and s.title), None)


def heading_text(level: int, title: str) -> str:
    return f"{'#' * level} {title.strip()}" if level > 0 else title.strip()


def render_path(path: Path) -> str:
    return SEP.join(heading_text(*h) for h in path)


def join_blocks(texts) -> str:
    return SEP.join(t for t in texts if t)


def shared_prefix(a: Path, b: Path) -> Path:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return a[:n]
