"""Tables inside HTML: extraction, and rendering as pipe tables."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_I, _IS = re.IGNORECASE, re.IGNORECASE | re.DOTALL
#: The tags that make a table.
TABLE = re.compile(r"<table\b[^>]*>", _I)
TABLE_MARK = re.compile(r"<table\b[^>]*>|(</table\s*>)", _I)
ROW = re.compile(r"<tr\b[^>]*>", _I)
ROW_END = re.compile(r"</tr\s*>", _I)
CELL = re.compile(r"<(th|td)\b[^>]*>(.*?)</\1\s*>", _IS)
CAPTION = re.compile(r"<caption\b[^>]*>(.*?)</caption\s*>", _IS)
SPAN = {name: re.compile(rf"\b{name}\s*=\s*[\"']?(\d+)", _I) for name in ("rowspan", "colspan")}
BREAK = re.compile(r"<br\s*/?>", _I)
TAG = re.compile(r"<[^>]+>")


@dataclass(frozen=True)
class Cell:
    text: str
    html: str
    header: bool
    row_span: int
    col_span: int


@dataclass(frozen=True)
class Row:
    cells: tuple[Cell, ...]
    html: str

    @property
    def header(self) -> bool:
        return any(c.header for c in self.cells)


@dataclass(frozen=True)
class Table:
    headers: tuple[Row, ...]
    rows: tuple[Row, ...]
    html: str
    caption: str
    open_tag: str
    caption_html: str


def strip_tags(html: str) -> str:
    """Breaks become line ends, other tags a space; white space shrinks line by line."""
    return "\n".join(" ".join(line.split()) for line in TAG.sub(" ", BREAK.sub("\n", html)).split("\n"))


def _close(html: str, start: int) -> int | None:
    depth = 0
    for m in TABLE_MARK.finditer(html, start):
        depth += -1 if m[1] else 1
        if not depth:
            return m.end()
    return None


def _row(html: str) -> Row:
    span = lambda name, s: int(m[1]) if (m := SPAN[name].search(s)) else 1
    return Row(tuple(Cell(strip_tags(m[2].strip()), m[0], m[1].lower() == "th", span("rowspan", m[0]), span("colspan", m[0])) for m in CELL.finditer(html)), html)


def extract(html: str) -> list[Table]:
    """All closed tables in the order in which they open, nested ones too."""
    out = []
    for opened in TABLE.finditer(html):
        end = _close(html, opened.start())
        if end is None:
            continue
        own = html[opened.start() : end]
        rows = [_row(own[m.start() : e.end()]) for m in ROW.finditer(own) if (e := ROW_END.search(own, m.start()))]
        c = CAPTION.search(own)
        out.append(Table(tuple(r for r in rows if r.header), tuple(r for r in rows if not r.header), own, strip_tags(c[1].strip()) if c else "", opened[0], c[0] if c else ""))
    return out


def to_pipe(t: Table) -> str:
    """A pipe table: caption in emphasis, first header row (else first row), spanned cells repeated below."""
    lines = [f"*{t.caption}*"] if t.caption else []
    if not t.rows:
        return "\n".join(lines)
    escape = lambda s: s.replace("|", "\\|").strip()
    line = lambda cells: "| " + " | ".join(cells) + " |"
    head, body = (t.headers[0], t.rows) if t.headers else (t.rows[0], t.rows[1:])
    lines.append(line([escape(c.text) for c in head.cells]))
    lines.append(line(["-" * max(3, min(len(c.text), 10) if c.col_span > 1 else len(c.text)) for c in head.cells]))
    return "\n".join(lines + [line([escape(c.text) for c in r.cells for _ in range(max(1, c.col_span))]) for r in body])


TABLE_TYPE = "array<struct<caption:string,html:string,n_headers:int,n_rows:int,cells:array<array<string>>,pipe:string>>"


def contains_table(html: Column) -> Column:
    return html.rlike(r"(?i)<table\b[^>]*>")


def tables(html: Column) -> Column:
    """Tables of an HTML column; texts without one never leave the JVM."""

    @F.udf(TABLE_TYPE, useArrow=True)
    def found(s: str | None):
        return [(t.caption, t.html, len(t.headers), len(t.rows), [[c.text for c in r.cells] for r in (*t.headers, *t.rows)], to_pipe(t)) for t in extract(s or "")]

    return F.when(contains_table(html), found(html)).otherwise(F.array().cast(TABLE_TYPE))
