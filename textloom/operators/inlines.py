"""Inline Markdown to nodes and back: one scan with stacks of delimiters and brackets, as CommonMark defines them.

Defined results: an empty text has no nodes; what opens and never closes is text; nesting has no limit, and neither scan nor
rendering recurses. Every search that fails is remembered, so a text's time grows with its length.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable
from dataclasses import dataclass
from urllib.parse import quote

from textloom.model import Inline

#: Nothing in a text without these is anything but text.
SPECIAL = re.compile(r"[\\`*_~\[\]<&$!\n]")
PLAIN = re.compile(r"[^\\`*_~\[\]<&$!\n]+")
PUNCTUATION = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
ESCAPED = re.compile(r"""\\([!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~])""")
AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*)>")
EMAIL = re.compile(r"<([A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*)>")
TAG = re.compile(r"""</[A-Za-z][A-Za-z0-9-]*\s*>|<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w:.-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)*\s*/?>|<\?[^<>]*\?>|<![A-Za-z][^>]*>""")
TARGET = re.compile(r"""\(\s*(?:(<(?:\\.|[^<>\\\n])*>|(?:\\.|[^\s()\\<]|\((?:\\.|[^\s()\\])*\))(?:\\.|[^\s()\\]|\((?:\\.|[^\s()\\])*\))*)(?:\s+("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|\((?:\\.|[^()\\])*\)))?)?\s*\)""", re.S)
LABEL = re.compile(r"\[((?:\\.|[^\[\]\\]){0,999})\]", re.S)
#: Fixed value: schemes that no link may have.
REFUSED = re.compile(r"(?:vbscript|javascript|file|data(?!:image/(?:gif|png|jpeg|webp);)):", re.I)

Targets = dict[str, tuple[str, str]]


@dataclass
class _Mark:
    """A run of ``*`` or ``_``, or a ``~~``, that may open or close."""

    char: str
    n: int
    opens: bool
    closes: bool
    size: int
    serial: int


@dataclass
class _Bracket:
    at: int  # among the entries
    begin: int  # of the label, in the text
    image: bool
    live: bool = True


def fold_label(label: str) -> str:
    return " ".join(label.split()).casefold()


def _plain(s: str) -> str:
    return ENTITY.sub(lambda m: html.unescape(m[0]), ESCAPED.sub(lambda m: f"&#{ord(m[1])};", s))


def _address(s: str) -> str:
    return quote(re.sub(r"%(?![0-9A-Fa-f]{2})", "%25", s), safe=";/?:@&=+$,-_.!~*'()#%")


def _is_punctuation(c: str) -> bool:
    return c in PUNCTUATION or unicodedata.category(c)[0] == "P"


def _flanks(before: str, after: str, char: str) -> tuple[bool, bool]:
    """Whether a run between these two characters may open and close; the text's ends count as blanks."""
    b, a = before.isspace() or not before, after.isspace() or not after
    bp, ap = not b and _is_punctuation(before), not a and _is_punctuation(after)
    left, right = not a and (not ap or b or bp), not b and (not bp or a or ap)
    return (left and (not right or bp), right and (not left or ap)) if char == "_" else (left, right)


def _joined(entries: Iterable[Inline | _Mark]) -> list[Inline]:
    """Nodes only: a mark that is left is text, neighbouring texts are one."""
    out: list[Inline] = []
    for e in entries:
        node = Inline("text", e.char * e.n) if isinstance(e, _Mark) else e
        if node.kind == "text" and out and out[-1].kind == "text":
            out[-1] = Inline("text", out[-1].text + node.text)
        elif node.kind != "text" or node.text:
            out.append(node)
    return out


def _emphasis(entries: list[Inline | _Mark]) -> list[Inline]:
    """Closing marks take the nearest opening ones and what lies between."""
    done: list[Inline | _Mark] = []
    openers: list[int] = []  # places in done
    floor: dict[tuple, int] = {}  # serials below this one hold no opener for such a closer
    for e in entries:
        if isinstance(e, Inline):
            done.append(e)
            continue
        while e.n and e.closes:
            key = (e.char, e.opens, e.size % 3)
            k = next(_matching(done, openers, e, floor.get(key, -1)), None)
            if k is None:
                floor[key] = e.serial
                break
            at, opener = openers[k], done[openers[k]]
            used = 2 if e.char == "~" or min(opener.n, e.n) >= 2 else 1
            kind = "strikethrough" if e.char == "~" else ("emphasis", "strong")[used - 1]
            node = Inline(kind, children=_joined(done[at + 1 :]))
            opener.n -= used
            e.n -= used
            del done[at + (opener.n > 0) :], openers[k + (opener.n > 0) :]
            done.append(node)
        if e.n:
            if e.opens:
                openers.append(len(done))
            done.append(e)
    return _joined(done)


def _matching(done: list, openers: list[int], e: _Mark, floor: int) -> Iterable[int]:
    for k in range(len(openers) - 1, -1, -1):
        o = done[openers[k]]
        if o.serial < floor:
            return
        odd = e.char != "~" and (o.closes or e.opens) and (o.size + e.size) % 3 == 0 and (o.size % 3 or e.size % 3)
        if o.char == e.char and not odd:
            yield k


class _Scan:
    def __init__(self, text: str, targets: Targets) -> None:
        self.text, self.targets = text, targets
        self.entries: list[Inline | _Mark] = []
        self.brackets: list[_Bracket] = []
        self.ticks: dict[int, list[int]] | None = None
        self.absent: set[str] = set()  # what was searched for in vain from some place on

    def say(self, s: str) -> None:
        self.entries.append(Inline("text", s))

    def find(self, what: str, at: int) -> int:
        """Where it is from ``at`` on, or -1; a vain search is made once."""
        if what in self.absent:
            return -1
        found = self.text.find(what, at)
        if found < 0:
            self.absent.add(what)
        return found

    def run(self) -> list[Inline]:
        text, i = self.text, 0
        steps = {"\\": self.escape, "`": self.code, "*": self.mark, "_": self.mark, "~": self.mark, "[": self.open, "!": self.open, "]": self.close, "<": self.angle, "&": self.entity, "$": self.math, "\n": self.line}
        while i < len(text):
            if m := PLAIN.match(text, i):
                self.say(m[0])
                i = m.end()
            else:
                i = steps[text[i]](i)
        return _emphasis(self.entries)

    def escape(self, i: int) -> int:
        follows = self.text[i + 1 : i + 2]
        if follows == "(" and (end := self.find("\\)", i + 3)) > 0:
            return self.formula(self.text[i + 2 : end], end + 2)
        if follows == "\n":
            self.entries.append(Inline("hard_break", "\n"))
            return self.unindent(i + 2)
        self.say(follows if follows in PUNCTUATION else "\\" + follows)
        return i + 1 + len(follows)

    def formula(self, literal: str, end: int) -> int:
        self.entries.append(Inline("math_inline", literal, attrs={"literal": literal}))
        return end

    def math(self, i: int) -> int:
        end = i
        while (end := self.find("$", end + 1)) > 0:
            slashes = 0
            while self.text[end - 1 - slashes] == "\\":
                slashes += 1
            if slashes % 2 == 0:
                break
        if end > i + 1:
            return self.formula(self.text[i + 1 : end], end + 1)
        self.say("$")
        return i + 1

    def code(self, i: int) -> int:
        if self.ticks is None:
            self.ticks = {}
            for m in re.finditer("`+", self.text):
                self.ticks.setdefault(len(m[0]), []).append(m.start())
        n = 1
        while self.text[i + n : i + n + 1] == "`":
            n += 1
        places = self.ticks.get(n, [])
        k = bisect_left(places, i + n)
        if k == len(places):
            self.say("`" * n)
            return i + n
        s = self.text[i + n : places[k]].replace("\n", " ")
        if len(s) > 2 and s[0] == s[-1] == " " and s.strip(" "):
            s = s[1:-1]
        self.entries.append(Inline("code_span", s, attrs={"literal": s}))
        return places[k] + n

    def mark(self, i: int) -> int:
        char, end = self.text[i], i
        while end < len(self.text) and self.text[end] == char:
            end += 1
        opens, closes = _flanks(self.text[i - 1 : i] if i else "", self.text[end : end + 1], char)
        n = end - i
        if char == "~":  # pairs; an odd one is text
            self.say("~" * (n % 2))
            self.entries.extend(_Mark("~", 2, opens, closes, 2, i + 2 * k) for k in range(n // 2))
        else:
            self.entries.append(_Mark(char, n, opens, closes, n, i))
        return end

    def line(self, i: int) -> int:
        last = self.entries[-1] if self.entries else None
        kind = "soft_break"
        if isinstance(last, Inline) and last.kind == "text" and last.text.endswith(" "):
            kind = "hard_break" if last.text.endswith("  ") else kind
            last.text = last.text.rstrip(" ")
        self.entries.append(Inline(kind, "\n"))
        return self.unindent(i + 1)

    def unindent(self, i: int) -> int:
        while self.text[i : i + 1] in (" ", "\t"):
            i += 1
        return i

    def entity(self, i: int) -> int:
        m = ENTITY.match(self.text, i)
        self.say(html.unescape(m[0]) if m else "&")
        return m.end() if m else i + 1

    def angle(self, i: int) -> int:
        if (m := AUTOLINK.match(self.text, i)) and not REFUSED.match(m[1]) or (m := EMAIL.match(self.text, i)):
            mail = m.re is EMAIL
            self.entries.append(Inline("autolink", children=[Inline("text", m[1])], attrs={"destination": ("mailto:" if mail else "") + _address(m[1]), "title": "", "literal": m[1], "syntax": "autolink"}))
            return m.end()
        end = 0
        if self.text.startswith("<!--", i):
            end = self.find("-->", i + 4) + 3
        elif m := TAG.match(self.text, i):
            end = m.end()
        if end <= i:
            self.say("<")
            return i + 1
        self.entries.append(Inline("inline_html", self.text[i:end]))
        return end

    def open(self, i: int) -> int:
        image = self.text[i] == "!"
        if image and self.text[i + 1 : i + 2] != "[":
            self.say("!")
            return i + 1
        end = i + 1 + image
        self.brackets.append(_Bracket(len(self.entries), end, image))
        self.say(self.text[i:end])
        return end

    def close(self, i: int) -> int:
        if not self.brackets:
            self.say("]")
            return i + 1
        b = self.brackets.pop()
        found = self.target(b, i) if b.live else None
        if found is None:
            self.say("]")
            return i + 1
        destination, title, end = found
        children = _emphasis(self.entries[b.at + 1 :])
        del self.entries[b.at :]
        self.entries.append(Inline("image" if b.image else "link", children=children, attrs={"destination": _address(destination), "title": title}))
        if not b.image:  # no link inside a link
            for x in reversed(self.brackets):
                if not x.image:
                    if not x.live:
                        break
                    x.live = False
        return end

    def target(self, b: _Bracket, i: int) -> tuple[str, str, int] | None:
        """(destination, title, end) of what closes at i."""
        if m := TARGET.match(self.text, i + 1):
            destination = _plain((m[1] or "")[1:-1] if (m[1] or "").startswith("<") else m[1] or "")
            if not REFUSED.match(destination):
                return destination, _plain((m[2] or "  ")[1:-1]), m.end()
        m = LABEL.match(self.text, i + 1)
        label, end = (m[1], m.end()) if m and m[1].strip() else (self.text[b.begin : i] if i - b.begin < 1000 else "", m.end() if m else i + 1)
        known = self.targets.get(fold_label(label))
        return (*map(_plain, known), end) if known and not REFUSED.match(known[0]) else None


def parse(text: str, targets: Targets) -> list[Inline]:
    """The nodes of a text; ``targets`` are (destination, title) by folded label."""
    if not SPECIAL.search(text):
        return [Inline("text", text)] if text else []
    return _Scan(text, targets).run()


#: What surrounds the children of a node.
AROUND = {"emphasis": "*", "strong": "**", "strikethrough": "~~"}


def render(nodes: list[Inline]) -> str:
    """Canonical Markdown: emphasis by asterisks, links inline, breaks as line feeds."""
    out: list[str] = []
    todo: list[Inline | str] = list(reversed(nodes))
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.kind == "code_span":
            out.append(f"`{n.attrs.get('literal', n.text)}`")
        elif n.kind == "math_inline":
            out.append(f"${n.attrs.get('literal', n.text)}$")
        elif n.kind == "autolink":
            out.append(f"<{n.attrs['literal']}>")
        elif n.kind in ("link", "image"):
            title = n.attrs["title"].strip()
            tail = f"]({n.attrs['destination']}" + (f' "{title}"' if title else "") + ")"
            todo += [tail, *reversed(n.children), "![" if n.kind == "image" else "["]
        elif n.children:
            around = AROUND.get(n.kind, "")
            todo += [around, *reversed(n.children), around]
        else:
            out.append(n.text)
    return "".join(out)
