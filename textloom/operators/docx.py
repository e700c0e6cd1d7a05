"""Word documents to a tree of sections, by the standard library's zip and XML readers."""

from __future__ import annotations

import io
import re
import zipfile
from functools import lru_cache
from xml.etree import ElementTree

from textloom.model import Block, Inline, Outline, Tree

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PARAGRAPH, TABLE, RUN, RUN_LOOK, FONTS, VALUE = f"{W}p", f"{W}tbl", f"{W}r", f"{W}rPr", f"{W}rFonts", f"{W}val"
TEXT, TAB, BREAKS = f"{W}t", f"{W}tab", (f"{W}br", f"{W}cr")
LOOK, STYLE = f"{W}pPr", f"{W}pStyle"
#: Paragraph styles and fonts with a meaning.
BULLETS = ("List Bullet", "List Bullet 2", "List Bullet 3", "List Bullet 4", "List Bullet 5", "List Continue", "List Continue 2", "List Continue 3", "List Continue 4", "List Continue 5")
NUMBERS = ("List Number", "List Number 2", "List Number 3", "List Number 4", "List Number 5", "List Number Field")
QUOTES = ("Quote", "Intense Quote")
MONOSPACE = ("Courier New", "Consolas", "Courier", "monospace")
HEADING = re.compile(r"(?:Heading|heading|标题)(.*)$")


def _inside(node, outer: str, inner: str):
    """The first ``inner`` in one of the node's ``outer``, as ``find("outer/inner")`` has it, by direct look-ups."""
    return next((found for x in node.findall(outer) if (found := x.find(inner)) is not None), None)


@lru_cache(8)
def _styles(xml: bytes) -> dict[str, tuple[str, str]]:
    """Style id -> (name, font), read-only. Built-in heading names are written in lower case in the file.

    Files by one writer mostly have the same styles, so the last few are kept.
    """
    out = {}
    for s in ElementTree.fromstring(xml).iter(f"{W}style"):
        name, font = s.find(f"{W}name"), _inside(s, RUN_LOOK, FONTS)
        value = name.get(VALUE, "") if name is not None else ""
        out[s.get(f"{W}styleId", "")] = (re.sub(r"^heading (?=\d)", "Heading ", value), font.get(f"{W}ascii", "") if font is not None else "")
    return out


def _text(node) -> str:
    parts = []
    for x in node.iter():
        tag = x.tag
        if tag == TEXT:
            parts.append(x.text or "")
        elif tag == TAB:
            parts.append("\t")
        elif tag in BREAKS:
            parts.append("\n")
    return "".join(parts)


def _is_code(p) -> bool:
    runs = p.findall(RUN)
    fonts = [_inside(r, RUN_LOOK, FONTS) for r in runs]
    return bool(runs) and all(f is not None and f.get(f"{W}ascii") in MONOSPACE for f in fonts)


def _on(properties, name: str) -> bool:
    x = properties.find(f"{W}{name}") if properties is not None else None
    return x is not None and x.get(f"{W}val", "true") not in ("0", "false", "off", "none")


def _inlines(p) -> list[Inline]:
    """A node for each run with text, by its own font."""
    out = []
    for r in p.findall(RUN):
        text, look = _text(r), r.find(RUN_LOOK)
        font = look.find(f"{W}rFonts") if look is not None else None
        bold, italic = _on(look, "b"), _on(look, "i")
        if not text:
            continue
        if bold:
            out.append(Inline("strong", children=[Inline("emphasis" if italic else "text", text)]))
        elif italic:
            out.append(Inline("emphasis", text))
        elif _on(look, "u"):
            out.append(Inline("text", text, attrs={"underline": "true"}))
        elif font is not None and font.get(f"{W}ascii") in MONOSPACE:
            out.append(Inline("code_span", text, attrs={"literal": text}))
        else:
            out.append(Inline("text", text))
    return out


def _table(t) -> str:
    rows = []
    for tr in t.findall(f"{W}tr"):
        cells: list[str] = []
        for tc in tr.findall(f"{W}tc"):
            span = _inside(tc, f"{W}tcPr", f"{W}gridSpan")
            text = " ".join("\n".join(_text(p) for p in tc.findall(f"{W}p")).split("\n")).strip()
            cells += [text] * (int(span.get(f"{W}val", "1")) if span is not None else 1)
        rows.append(cells)
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def parse(content: bytes, title: str | None = None, metadata: dict[str, str] | None = None, inlines: bool = True) -> Tree:
    """Line numbers are those of elements that give a block; ``title`` wins if given, even empty. Runs are read as nodes where ``inlines`` are asked for."""
    running = _inlines if inlines else lambda e: []
    z = zipfile.ZipFile(io.BytesIO(content))
    names, out, n = set(z.namelist()), Outline(), 0
    styles = _styles(z.read("word/styles.xml")) if "word/styles.xml" in names else {}
    meta = dict(metadata or {})
    if "docProps/core.xml" in names:
        for x in ElementTree.fromstring(z.read("docProps/core.xml")):
            key = {"title": "title", "creator": "author"}.get(x.tag.rpartition("}")[2])
            if key and x.text:
                meta.setdefault(key, x.text)
    body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    for e in body if body is not None else ():
        if e.tag == TABLE:
            n += 1
            if text := _table(e):
                out.block(Block("table", text, n, n))
        if e.tag != PARAGRAPH:
            continue
        style = _inside(e, LOOK, STYLE)
        name = styles.get(style.get(VALUE, ""), (style.get(VALUE, ""), ""))[0] if style is not None else "Normal"
        raw = _text(e)
        text = raw.strip()
        if m := HEADING.match(name):
            if text:
                n += 1
                level = int(m[1]) if m[1].strip().isdigit() else 1
                out.heading(max(1, level), text, n, running(e))
        elif name in BULLETS or name in NUMBERS:
            n += 2  # a list and its item each count
            mark = "1." if name in NUMBERS else "-"
            out.block(Block("list", f"{mark} {text}", n, n, [text], {"ordered": str(name in NUMBERS).lower()}, inlines=running(e)))
        elif name in QUOTES:
            n += 1
            out.block(Block("blockquote", f"> {text}" if text else "", n, n, inlines=running(e)))
        elif _is_code(e):
            n += 1
            out.block(Block("code_block", f"```\n{raw}\n```", n, n, attrs={"literal": raw}))
        elif text:
            n += 1
            out.block(Block("paragraph", text, n, n, inlines=running(e)))
    own = meta.get("title", "").strip()
    found = title if title is not None else own or out.first_h1() or "Anonymous"
    out.root.title = found
    return Tree(out.root, found, meta)
