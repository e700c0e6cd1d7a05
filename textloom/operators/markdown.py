"""Markdown to a tree of sections: CommonMark blocks, pipe tables, math blocks and front matter.

Parsed are block kinds and line ranges, children of quotes and lists, titles' inline
text, references and metadata. By default setext headings are off, as an underlined line is one paragraph. Time is
proportional to a text's length (times ``DEEPEST`` at most, for containers in containers).

Defined results: an empty text is a root without blocks; ties of reference labels go to the first; a text is parsed whole, however long.
"""

from __future__ import annotations

import html as htmllib
import re
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass

from textloom.model import Block, Outline, Section, Tree
from textloom.operators import inlines

HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?[ \t]*$")
CLOSING = re.compile(r"(?:^|[ \t]+)#+[ \t]*$")
RULE = re.compile(r" {0,3}([-_*])[ \t]*(?:\1[ \t]*){2,}$")
FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})(.*)$")
QUOTE = re.compile(r" {0,3}>")
BULLET = re.compile(r"( {0,3})([-+*])(?=[ \t]|$)")
ORDERED = re.compile(r"( {0,3})(\d{1,9})([.)])(?=[ \t]|$)")
REFERENCE = re.compile(r""" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*\n?[ \t]*(<[^<>\n]*>|\S+)(?:(?:[ \t]*\n[ \t]*|[ \t]+)("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*(?=\n|$)""")
DELIMITER = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
#: The patterns of bracket math, with and without an equation number.
MATH = re.compile(r"\\\[([\s\S]+?)\\\](?:\s*?\(([^)$\r\n]+?)\))?")
MATH_EQNO = re.compile(r"\\\[(?:(?!\\\]|\\\[)[\s\S])+?\\\]\s*?\(([^)$\r\n]+?)\)")
#: Fixed values of the CommonMark specification: tags that open an HTML block of type 6.
HTML_TAGS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
).split()
_ATTR = r"""(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)*"""
HTML_STARTS: tuple[tuple[re.Pattern, re.Pattern | None], ...] = (
    (re.compile(r"<(?:script|pre|style|textarea)(?=\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r"<!--"), re.compile(r"-->")),
    (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile(r"<![A-Z]"), re.compile(r">")),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf"</?(?:{'|'.join(HTML_TAGS)})(?=\s|/?>|$)", re.I), None),
    (re.compile(rf"(?:<[A-Za-z][A-Za-z0-9-]*{_ATTR}\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)\s*$"), None),
)
SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
TABLE_TAG = re.compile(r"<table\b[^>]*>", re.I)

#: A line of front matter without structure: a word, and a value in quotes or of words.
PLAIN_PAIR = re.compile(r"""[A-Za-z_][A-Za-z0-9_]*: (?:'[ -&(-~]*'|"[ !#-\[\]-~]*"|[A-Za-z0-9]+(?:[ ._/-][A-Za-z0-9]+)*)""")
#: A line of front matter that needs no YAML: a name that isn't a truth value or null, and a text in quotes without escapes.
QUOTED_PAIR = re.compile(r"""(?!(?i:yes|no|true|false|on|off|null): )([A-Za-z_][A-Za-z0-9_]{0,99}): (?:'([ -&(-~]*)'|"([ !#-\[\]-~]*)")""")
#: What stands before and after front matter.
FRONT = re.compile(r"-{3,}[ \t]*")

#: Lines that are read for one reference definition.
REFERENCE_LINES = 6
#: Containers deeper than this have no children of their own.
DEEPEST = 20
#: The kinds of blocks that each rule gives; the others are always there.
RULES = {"tables": ("table",), "math": ("math_block", "math_block_eqno"), "front_matter": ("front_matter",)}
ALWAYS = ("paragraph", "blockquote", "list", "list_item", "html_table", "code_block", "code_fence", "html_block")


@dataclass(frozen=True)
class BlockContext:
    """What a block handler sees: the lines, where its block begins and ends, the block's text, and a way to parse children."""

    lines: list[str]
    start: int
    end: int
    text: str
    children: Callable[[int, int], list[Block]]


@dataclass(frozen=True)
class BlockSpec:
    """A block kind of one's own.

    ``match(lines, index)`` gives the number of lines of a block that begins there, or None. ``handler`` makes the block, or None to
    drop it; without one the block is its text, its attributes name the spec.
    """

    kind: str
    match: Callable[[list[str], int], int | None]
    handler: Callable[[BlockContext], Block | None] | None = None


@dataclass(frozen=True)
class MarkdownConfig:
    """Which rules are on, and block kinds of one's own, which come before all rules. Validated on the driver."""

    setext: bool = False
    tables: bool = True
    math: bool = True
    front_matter: bool = True
    specs: tuple[BlockSpec, ...] = ()

    def __post_init__(self) -> None:
        kinds = [s.kind for s in self.specs]
        if any(not isinstance(k, str) or not k.strip() for k in kinds):
            raise ValueError("a block spec needs a kind")
        if len(set(kinds)) < len(kinds):
            raise ValueError("two block specs have one kind")
        if taken := sorted(set(kinds) & {*ALWAYS, *(k for r in RULES.values() for k in r), "heading"}):
            raise ValueError(f"block kinds that are there already: {', '.join(taken)}")
        if any(not callable(s.match) or s.handler is not None and not callable(s.handler) for s in self.specs):
            raise TypeError("match and handler of a block spec must be callable")

    @property
    def kinds(self) -> tuple[str, ...]:
        """The block kinds that documents may have under this configuration."""
        return (*ALWAYS, *(k for rule, kinds in RULES.items() if getattr(self, rule) for k in kinds), *(s.kind for s in self.specs))


def _indent(line: str) -> int:
    n = 0
    for c in line:
        if c == " ":
            n += 1
        elif c == "\t":
            n += 4 - n % 4
        else:
            break
    return n


def _dedent(line: str, width: int) -> str:
    """The line without ``width`` columns of leading white space."""
    at = 0
    for i, c in enumerate(line):
        if at >= width or c not in " \t":
            return " " * (at - width) + line[i:] if at > width else line[i:]
        at += 4 - at % 4 if c == "\t" else 1
    return " " * max(0, at - width)


def _blank(line: str) -> bool:
    return not line.strip(" \t")


def _html_start(line: str, interrupts: bool) -> int | None:
    if _indent(line) > 3:
        return None
    s = line.lstrip(" ")
    if not s.startswith("<"):
        return None
    for i, (start, _) in enumerate(HTML_STARTS[: 6 if interrupts else 7]):
        if start.match(s):
            return i
    return None


def _marker(line: str) -> tuple[str, str, int] | None:
    """(type, number, columns up to the content's least indent) of a list marker."""
    m = ORDERED.match(line) or BULLET.match(line)
    if not m or RULE.match(line):
        return None
    end = m.end()
    rest = line[end:]
    kind, number = (m[3], m[2]) if m.re is ORDERED else (m[2], "")
    gap = _indent(rest) if not _blank(rest) else 1
    return kind, number, end + (gap if gap <= 4 else 1)


def _interrupts(line: str) -> bool:
    """Whether a line ends a paragraph by starting another block."""
    if _indent(line) > 3:
        return False
    if FENCE.match(line) and not ("`" in FENCE.match(line)[3] and FENCE.match(line)[2][0] == "`"):
        return True
    if QUOTE.match(line) or RULE.match(line) or HEADING.match(line) or _html_start(line, True) is not None:
        return True
    if m := _marker(line):
        empty = _blank(line[m[2] :]) and _blank((ORDERED.match(line) or BULLET.match(line)).string[(ORDERED.match(line) or BULLET.match(line)).end() :])
        return not empty and m[1] in ("", "1")
    return False


def _cells(line: str) -> int:
    s = line.strip().removeprefix("|")
    s = s[:-1] if s.endswith("|") and not s.endswith("\\|") else s
    return len(re.findall(r"(?<!\\)\|", s)) + 1


class _Open:
    """Whether the last block of growing lines is a paragraph that a lazy line may continue.

    A line of plain text keeps an open paragraph open, or opens one in the containers whose markers stand before it; only other lines are parsed, from the last
    block on.
    """

    def __init__(self, config: MarkdownConfig) -> None:
        self.config, self.known, self.seen, self.base, self.top = config, False, 0, 0, False
        self.unclosed = False  # math that would take in all up to its closing line

    def _plain(self, line: str) -> bool:
        bare = True  # a line without markers goes on with the paragraph, others may begin a block
        for _ in range(DEEPEST):
            if m := QUOTE.match(line):
                line = line[m.end() :].removeprefix(" ")
            elif m := _marker(line):
                line = line[m[2] :]
            else:
                break
            bare = False
        if _blank(line) or _interrupts(line) or DELIMITER.match(line) or self.config.setext and SETEXT.match(line):
            return False
        return bare or not (_indent(line) > 3 or line.lstrip(" ").startswith(("[", "\\[", "$$", "<")))

    def _defines(self, lines: list[str]) -> bool:
        """Whether what looks like a paragraph may become math or a reference definition by its new lines."""
        if self.config.math and (self.unclosed or not self.top) and any("\\]" in x or x.rstrip().endswith("$$") for x in lines[self.seen :]):
            self.base = 0 if self.unclosed else self.base
            return True
        if self.top and len(lines) - self.base > REFERENCE_LINES + 1:
            return False
        return any(re.match(r"(?:[ >]|[-+*] |\d+[.)] )*\[", x) for x in lines[max(0, self.seen - REFERENCE_LINES) :])

    def __call__(self, lines: list[str]) -> bool:
        if not lines or _blank(lines[-1]):
            return False
        if not self._defines(lines) and self.known and not self.config.specs and all(map(self._plain, lines[self.seen :])):
            self.seen = len(lines)
            return True
        blocks = Parser(self.config).parse(lines, self.base)
        self.unclosed = self.base > 0 and self.unclosed or any(kind == "paragraph" and lines[start].lstrip(" ").startswith(("\\[", "$$")) for kind, start, *_ in blocks)
        self.known = False
        if blocks:
            kind, start, end, inner = blocks[-1]
            self.top = kind == "paragraph"
            self.base = inner[-1][0] if kind == "list" and inner else start
            self.known = end == len(lines) and (kind == "paragraph" or (kind in ("list", "blockquote") and bool(inner) and _Open(self.config)(inner[-1][2])))
        self.seen = len(lines)
        return self.known


class Parser:
    """Parses lines into blocks. Containers keep their own lines, for their extent and children."""

    def __init__(self, config: MarkdownConfig = MarkdownConfig()) -> None:
        self.config, self.setext = config, config.setext
        self._of: list[str] | None = None
        self._folded: dict[str, tuple[str, str]] = {}
        self.references: dict[str, tuple[str, str]] = {}
        self._seen: set[str] = set()

    def _table(self, lines: list[str], i: int) -> int | None:
        """End of a pipe table that begins at line i."""
        if not self.config.tables:
            return None
        if i + 1 >= len(lines) or "|" not in lines[i] + lines[i + 1] or _indent(lines[i]) > 3 or _indent(lines[i + 1]) > 3:
            return None
        if not DELIMITER.match(lines[i + 1]) or _cells(lines[i]) != _cells(lines[i + 1]) or ("|" not in lines[i + 1] and ":" not in lines[i + 1]):
            return None
        j = i + 2
        while j < len(lines) and not _blank(lines[j]) and _indent(lines[j]) < 4 and not _interrupts(lines[j]):
            j += 1
        return j

    def _quote(self, lines: list[str], i: int) -> tuple[int, list]:
        inner, j, is_open = [], i, _Open(self.config)
        while j < len(lines):
            if m := QUOTE.match(lines[j]):
                rest = lines[j][m.end() :]
                inner.append(_dedent(rest, 1) if rest[:1] in (" ", "\t") else rest)
            elif _blank(lines[j]) or _interrupts(lines[j]) or not is_open(inner):
                break
            else:
                inner.append(lines[j].lstrip())
            j += 1
        return j, [(i, j, inner)]

    def _list(self, lines: list[str], i: int) -> tuple[int, list]:
        """(end, items as (start, end, own lines)) of a list; a list's range takes in blank lines after it."""
        kind = _marker(lines[i])[0]
        items, j = [], i
        while j < len(lines) and (m := _marker(lines[j])) and m[0] == kind and (_indent(lines[j]) < 4):
            start, width = j, m[2]
            inner = [_dedent(" " * (len(lines[j]) - len(lines[j][width:])) + lines[j][width:], width)]
            j += 1
            empty, is_open = _blank(inner[0]), _Open(self.config)
            while j < len(lines):
                if _blank(lines[j]):
                    if empty and j == start + 1:
                        break
                    inner.append("")
                elif _indent(lines[j]) >= width:
                    inner.append(_dedent(lines[j], width))
                elif _blank(inner[-1]) or _marker(lines[j]) and _indent(lines[j]) < width or _interrupts(lines[j]) or not is_open(inner):
                    break
                else:
                    inner.append(lines[j].lstrip())
                j += 1
            while j < len(lines) and _blank(lines[j]):
                j += 1
            items.append((start, j, inner))
            if j < len(lines) and RULE.match(lines[j]):
                break
        return j, items

    def parse(self, lines: list[str], first: int) -> list[tuple[str, int, int, list]]:
        """(kind, start, end, items) of the blocks, by index; headings as ``h1`` .. ``h6``."""
        out: list[tuple[str, int, int, list]] = []
        i, n = first, len(lines)
        while i < n:
            line = lines[i]
            if _blank(line):
                i += 1
                continue
            hooked = next(((spec, many) for spec in self.config.specs if (many := spec.match(lines, i))), None)
            if hooked:
                out.append((hooked[0].kind, i, min(n, i + hooked[1]), []))
            elif (end := self._table(lines, i)) is not None:
                out.append(("table", i, end, []))
            elif _indent(line) > 3:
                j = last = i
                while j < n and (_blank(lines[j]) or _indent(lines[j]) > 3):
                    last = last if _blank(lines[j]) else j
                    j += 1
                out.append(("code_block", i, last + 1, []))
            elif self.config.math and (found := self._math(lines, i)) is not None:
                out.append(found)
            elif (m := FENCE.match(line)) and not (m[2][0] == "`" and "`" in m[3]):
                close = re.compile(rf" {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*$")
                end = next((j + 1 for j in range(i + 1, n) if close.match(lines[j])), n)
                out.append(("code_fence", i, end, []))
            elif QUOTE.match(line):
                end, inner = self._quote(lines, i)
                out.append(("blockquote", i, end, inner))
            elif RULE.match(line):
                out.append(("rule", i, i + 1, []))
            elif _marker(line):
                end, items = self._list(lines, i)
                out.append(("list", i, end, items))
            elif (end := self._reference(lines, i)) is not None:
                i = end
                continue
            elif (t := _html_start(line, False)) is not None:
                out.append(("html_block", i, self._html_end(lines, i, t), []))
            elif m := HEADING.match(line):
                out.append((f"h{len(m[1])}", i, i + 1, []))
            else:
                end = i + 1
                while end < n and not _blank(lines[end]) and not _interrupts(lines[end]) and self._table(lines, end) is None:
                    if self.setext and SETEXT.match(lines[end]):
                        break
                    end += 1
                if self.setext and end < n and (m := SETEXT.match(lines[end])):
                    out.append(("h1" if m[1][0] == "=" else "h2", i, end + 1, ["setext"]))
                else:
                    out.append(("paragraph", i, end, []))
            i = max(out[-1][2], i + 1)
        return out

    @staticmethod
    def _html_end(lines: list[str], i: int, t: int) -> int:
        stop = HTML_STARTS[t][1]
        for j in range(i, len(lines)):
            if stop is None and _blank(lines[j]):
                return j
            if stop is not None and stop.search(lines[j]):
                return j + 1
        return len(lines)

    def _closing(self, lines: list[str], i: int, mark: str) -> int | None:
        """The first line from i on that closes math of this mark; found once for all lines."""
        if self._of is not lines:
            self._of = lines
            self._closers = {"\\]": [k for k, x in enumerate(lines) if "\\]" in x], "$$": [k for k, x in enumerate(lines) if x.rstrip().endswith("$$")]}
        found = self._closers[mark]
        at = bisect_left(found, i)
        return found[at] if at < len(found) else None

    def _math(self, lines: list[str], i: int) -> tuple[str, int, int, list] | None:
        s = lines[i].lstrip(" ")
        if s.startswith("\\["):
            close = i - 1
            for _ in range(2):  # brackets right behind each other close nothing; the next ones do
                if (close := self._closing(lines, close + 1, "\\]")) is None:
                    return None
                more = next((k for k in range(close + 1, len(lines)) if not _blank(lines[k])), close)  # a number may follow on the next line with text
                text = "\n".join([s, *lines[i + 1 : more + 1]])
                for kind, pattern in (("math_block_eqno", MATH_EQNO), ("math_block", MATH)):
                    if m := pattern.match(text):
                        end = m.end() if kind == "math_block_eqno" else text.index("\\]", m.start(1)) + 2
                        return kind, i, i + text.count("\n", 0, end) + 1, []
        if s.startswith("$$"):
            one = s.rstrip()
            if len(one) > 4 and one.endswith("$$"):
                return "math_block", i, i + 1, []
            end = self._closing(lines, i + 1, "$$")
            if end is not None:
                return "math_block", i, end + 1, []
        return None

    def _reference(self, lines: list[str], i: int) -> int | None:
        """End of a link reference definition that begins at line i."""
        if not lines[i].lstrip(" ").startswith("["):
            return None
        m = REFERENCE.match("\n".join(lines[i : i + REFERENCE_LINES]))
        if not m or not m[1].strip():
            return None
        key = " ".join(m[1].split()).casefold()
        if key not in self._seen:
            self._seen.add(key)
            self.references[m[1]] = (m[2].strip("<>"), (m[3] or "  ")[1:-1].strip())
        return i + m[0].count("\n") + 1

    # inline text of headings

    def targets(self) -> inlines.Targets:
        if len(self._folded) < len(self.references):
            self._folded = {inlines.fold_label(k): v for k, v in self.references.items()}
        return self._folded

    def title(self, section: Section) -> str:
        """Canonical Markdown of a section's title: escapes and entities resolved, emphasis by asterisks, links inline. Its nodes stay with the section."""
        section.inlines = inlines.parse(section.source, self.targets())
        return inlines.render(section.inlines).strip()


def add_inlines(tree: Tree) -> None:
    """Nodes of all titles and paragraphs, also those in quotes and lists."""
    targets = {inlines.fold_label(k): v for k, v in tree.references.items()}
    sections = [tree.root]
    for s in sections:
        s.inlines = s.inlines or inlines.parse(s.source, targets)
        sections += s.children
        blocks = list(s.blocks)
        for b in blocks:
            if b.kind == "paragraph" and not b.inlines:
                text = re.sub(r"(?m)^(?: {0,3}>)+", "", b.text) if b.text.startswith(">") else b.text
                b.inlines = inlines.parse("\n".join(x.lstrip() for x in text.split("\n")).strip(), targets)
            blocks += b.children


def _front_matter(lines: list[str]) -> tuple[int, dict | None]:
    """(lines of the front matter, its mapping if it is one)."""
    if not lines or not FRONT.fullmatch(lines[0]):
        return 0, None
    end = next((i for i, s in enumerate(lines[1:], 1) if FRONT.fullmatch(s)), None)
    if end is None:
        return 0, None
    quoted = [QUOTED_PAIR.fullmatch(s) for s in lines[1:end]]
    if quoted and all(quoted):
        return end + 1, {m[1]: m[m.lastindex] for m in quoted}
    try:
        import yaml

        # the C scanner, where there is one, reads plain "key: value" lines as the Python one does
        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader) if all(map(PLAIN_PAIR.fullmatch, lines[1:end])) else yaml.SafeLoader
        found = yaml.load("\n".join(lines[1:end]), loader)
    except Exception:  # whatever isn't YAML has no metadata
        found = None
    return end + 1, found if isinstance(found, dict) else None


def parse(source: str, title: str | None = None, metadata: dict[str, str] | None = None, config: MarkdownConfig = MarkdownConfig()) -> Tree:
    """``title`` wins if given, even empty; then the front matter's, the first h1, "Anonymous"."""
    # a block's text is cut by all line ends that Python knows, its place counts line feeds
    lines = source.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "�").split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    slices = source.splitlines()
    text = lambda a, b: "\n".join(slices[a:b]).strip("\n")
    p, out = Parser(config), Outline()
    specs = {s.kind: s for s in config.specs}

    def made(kind: str, a: int, b: int, items: list, own: list[str], at: int, depth: int) -> Block | None:
        """The block of lines ``own[a:b]``, of which ``own[0]`` is line ``at`` of the source."""
        block = Block(kind, text(a + at, b + at), a + at + 1, b + at)
        if kind in specs:
            if specs[kind].handler is None:
                block.attrs = {"source": kind}
                return block
            found = specs[kind].handler(BlockContext(own, a, b, block.text, lambda x, y: below(own[x:y], at + x, depth)))
            if found is not None and found.kind != kind:
                raise ValueError(f"the handler of block kind {kind!r} made a block of kind {found.kind!r}, which it doesn't declare")
            return found
        if kind == "code_fence":
            m = FENCE.match(own[a])
            info = htmllib.unescape(m[3].strip())
            closed = b - a > 1 and re.match(rf" {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*$", own[b - 1])
            body = [_dedent(x, min(len(m[1]), _indent(x))) for x in own[a + 1 : b - 1 if closed else b]]
            block.attrs = {"info": info, "language": info.split()[0] if info else "", "literal": "\n".join(body).rstrip("\n")}
        elif kind == "code_block":
            block.attrs = {"literal": "\n".join(_dedent(x, 4) for x in own[a:b]).rstrip("\n")}
        elif kind == "html_block":
            block.attrs = {"literal": block.text}
            if TABLE_TAG.search(block.text):
                block.kind = "html_table"
        elif kind == "blockquote":
            block.children = below(items[0][2], at + items[0][0], depth)
        elif kind == "list":
            block.items = [t for s, e, _ in items if (t := text(s + at, e + at))]
            m = ORDERED.match(own[a])
            loose = any(_blank(x) for s, e, _ in items for x in "\n".join(own[s:e]).strip("\n").split("\n")) or any(_blank(own[e - 1]) for _, e, _ in items[:-1])
            block.attrs = {"ordered": str(bool(m)).lower(), "tight": str(not loose).lower(), "start": m[2] if m else "", "bullet": "" if m else own[a].strip()[0]}
            block.children = [Block("list_item", t, s + at + 1, e + at, children=below(inner, s + at, depth)) for s, e, inner in items if (t := text(s + at, e + at))]
        return block

    def below(own: list[str], at: int, depth: int) -> list[Block]:
        """The blocks of a container; headings are paragraphs there."""
        if depth >= DEEPEST:
            return []
        found = (made("paragraph" if re.fullmatch("h[1-6]", kind) else kind, a, b, items, own, at, depth + 1) for kind, a, b, items in p.parse(own, 0) if kind != "rule")
        return [b for b in found if b is not None and b.text]

    first, front = _front_matter(lines) if config.front_matter else (0, None)
    if first:
        out.block(Block("front_matter", text(0, first), 1, first))
    for kind, a, b, items in p.parse(lines, first):
        if kind in ("h1", "h2", "h3", "h4", "h5", "h6"):
            raw = "\n".join(x.strip() for x in lines[a : b - 1]) if items else CLOSING.sub("", HEADING.match(lines[a])[2] or "")
            out.heading(int(kind[1]), raw, a + 1)
        elif kind != "rule" and (block := made(kind, a, b, items, lines, 0, 0)) is not None and block.text:
            out.block(block)
    out.retitle(p.title)  # once all references are known
    meta = dict(metadata or {})
    for k, v in (front or {}).items():
        meta.setdefault(str(k), v if isinstance(v, str) else v.isoformat() if hasattr(v, "isoformat") else str(v))
    own_title = (front or {}).get("title")
    found = title if title is not None else (own_title.strip() if isinstance(own_title, str) and own_title.strip() else None) or out.first_h1() or "Anonymous"
    out.root.title = found
    return Tree(out.root, found, meta, p.references)
