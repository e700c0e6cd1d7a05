"""Queries on documents that hold every kind of block, with the SQL that states what must come out."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.options import SplitOptions
from textloom.plans.engine import ChunkEngine
from textloom.plans.queries import _TURNS, conversations_markdown, query, read, spread


def _sql(s: str) -> str:
    """A string with ``@`` for a row's name, as SQL over the column ``name``."""
    parts = ["'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for p in s.split("@")]
    return "(" + " || name || ".join(parts) + ")"


def _rows(table: str, key: str, name: str, columns: str, rows: list[tuple]) -> str:
    """SQL: these rows for each row of a table."""
    value = lambda v: "NULL" if v is None else _sql(v) if isinstance(v, str) else f"CAST({v} AS BIGINT)"
    own = " UNION ALL ".join(f"SELECT {key}, " + ", ".join(f"{value(v)} AS {c}" for c, v in zip(columns.split(), r, strict=True)) + " FROM t" for r in rows)
    return f"WITH t AS (SELECT {key}, {name} AS name FROM {table}) {own}"


def _named(spark: SparkSession, sf_dir: str, table: str, key: str, name: str, text: str, fmt: str) -> DataFrame:
    d = spread(read(spark, sf_dir, table).select(key, name))
    return d.select(key, F.replace(F.lit(text), F.lit("@"), F.col(name)).alias("text"), F.lit(fmt).alias("format"))


MARKDOWN = r"""---
brand: '@'
---

intro @

> quote @
lazy

- one @
- two

  more

1) first

~~~py extra
  x = '@'
~~~

    indented @

\[ a @

b \]

\[ c \] (7)

$$
@
$$

***

<div>@</div>

<TABLE><tr><td>@</td></tr></TABLE>

| k | v |
|:-|-|
| a | @ |
Title
====="""
#: ord, kind, text, start, end, literal
MARKDOWN_BLOCKS = [
    (0, "front_matter", "---\nbrand: '@'\n---", 1, 3, None),
    (1, "paragraph", "intro @", 5, 5, None),
    (2, "blockquote", "> quote @\nlazy", 7, 8, None),
    (3, "list", "- one @\n- two\n\n  more", 10, 14, None),
    (4, "list", "1) first", 15, 16, None),
    (5, "code_fence", "~~~py extra\n  x = '@'\n~~~", 17, 19, "  x = '@'"),
    (6, "code_block", "    indented @", 21, 21, "indented @"),
    (7, "math_block", "\\[ a @\n\nb \\]", 23, 25, None),
    (8, "math_block_eqno", "\\[ c \\] (7)", 27, 27, None),
    (9, "math_block", "$$\n@\n$$", 29, 31, None),
    (10, "html_block", "<div>@</div>", 35, 35, "<div>@</div>"),
    (11, "html_table", "<TABLE><tr><td>@</td></tr></TABLE>", 37, 37, "<TABLE><tr><td>@</td></tr></TABLE>"),
    (12, "table", "| k | v |\n|:-|-|\n| a | @ |\nTitle\n=====", 39, 43, None),
]


def _blocks(trees: DataFrame, key: str) -> DataFrame:
    b = trees.select(key, F.explode("blocks").alias("b"))
    return b.select(key, F.col("b.ord").cast("long").alias("ord"), "b.kind", "b.text", F.col("b.start").cast("long").alias("start"), F.col("b.end").cast("long").alias("end"), F.col("b.attrs")["literal"].alias("literal"))


@query(_rows("part", "p_partkey", "p_brand", "ord kind text start end literal", MARKDOWN_BLOCKS).replace(" AS end", ' AS "end"'))
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of block, its text, lines and literal."""
    return _blocks(ChunkEngine().trees(_named(spark, sf_dir, "part", "p_partkey", "p_brand", MARKDOWN, "markdown")), "p_partkey")


CONTAINERS = "> # no section @\n> text\n>\n> - a\n>   b\n\n1. one\n\n   ```py\n   @\n   ```\n2. two @\n"
CHILDREN = [
    (0, "0", "paragraph", "> # no section @", 1, 1), (0, "1", "paragraph", "> text", 2, 2), (0, "2", "list", "> - a\n>   b", 4, 5), (0, "2/0", "list_item", "> - a\n>   b", 4, 5), (0, "2/0/0", "paragraph", "> - a\n>   b", 4, 5),
    (1, "0", "list_item", "1. one\n\n   ```py\n   @\n   ```", 7, 11), (1, "0/0", "paragraph", "1. one", 7, 7), (1, "0/1", "code_fence", "   ```py\n   @\n   ```", 9, 11), (1, "1", "list_item", "2. two @", 12, 12), (1, "1/0", "paragraph", "2. two @", 12, 12),
]


@query(_rows("part", "p_partkey", "p_brand", "ord path kind text start end", CHILDREN).replace(" AS end", ' AS "end"'))
def child_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks inside quotes and lists; a heading there is a paragraph."""
    t = ChunkEngine().trees(_named(spark, sf_dir, "part", "p_partkey", "p_brand", CONTAINERS, "markdown"))
    c = t.select("p_partkey", F.explode("children").alias("c"))
    return c.select("p_partkey", F.col("c.ord").cast("long").alias("ord"), F.array_join(F.col("c.path").cast("array<string>"), "/").alias("path"), "c.kind", "c.text", F.col("c.start").cast("long").alias("start"), F.col("c.end").cast("long").alias("end"))


HTML = """<!DOCTYPE html><html><head><title> The  @ </title><meta name="Author" content="Ada"><style>p {}</style></head>
<body>loose @ text
<h1>First <em>@</em></h1>
<p>one<br>two <img src="x" alt="alt @"> three
<blockquote>said
again</blockquote>
<pre>def f():
    return '@'</pre>
<script>no()</script>
<h2>Second</h2>
<ul><li>a @</li><li><b>b</b></li></ul>
<ol><li>x</li></ol>
<table><caption>c</caption><tr><td><p>@</p></td></tr></table>
</body></html>"""
#: section's title, ord, kind, text, start, literal
HTML_BLOCKS = [
    ("The @", 0, "paragraph", "loose @ text", 2, None),
    ("First @", 0, "paragraph", "one two alt @ three", 4, None),
    ("First @", 1, "blockquote", "> said again", 5, None),
    ("First @", 2, "code_block", "```\ndef f():\n    return '@'\n```", 7, "def f():\n    return '@'"),
    ("Second", 0, "list", "- a @\n- b", 11, None),
    ("Second", 1, "list", "1. x", 12, None),
    ("Second", 2, "html_table", "<table><caption>c</caption><tr><td><p>@</p></td></tr></table>", 13, "<table><caption>c</caption><tr><td><p>@</p></td></tr></table>"),
]


@query(_rows("part", "p_partkey", "p_brand", "section ord kind text start literal", HTML_BLOCKS))
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of block of a page, by section."""
    t = ChunkEngine().trees(_named(spark, sf_dir, "part", "p_partkey", "p_brand", HTML, "html"))
    b = t.select("p_partkey", "sections", F.explode("blocks").alias("b"))
    return b.select("p_partkey", F.expr("sections[b.section].title").alias("section"), F.col("b.ord").cast("long").alias("ord"), "b.kind", "b.text", F.col("b.start").cast("long").alias("start"), F.col("b.attrs")["literal"].alias("literal"))


_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
#: style (or font after a colon), text
WORD = [("Title", "Cover @"), ("Heading1", "One @"), ("", "plain @"), ("ListBullet", "item @"), ("ListNumber", "step"), ("Quote", "said @"), (":Consolas", "x = '@'"), ("", " "), ("Heading2", "Two"), ("", "end")]
WORD_BLOCKS = [
    ("Deed @", 0, "paragraph", "Cover @", 1), ("One @", 0, "paragraph", "plain @", 3), ("One @", 1, "list", "- item @", 5), ("One @", 2, "list", "1. step", 7), ("One @", 3, "blockquote", "> said @", 8),
    ("One @", 4, "code_block", "```\nx = '@'\n```", 9), ("Two", 0, "paragraph", "end", 11), ("Two", 1, "table", "| k | v |\n| --- | --- |\n| @ | @ |", 12),
]


def word_file(name: str) -> bytes:
    """A Word document with a paragraph of each style, a table with a merged cell and properties."""
    esc = lambda s: s.replace("@", name).replace("&", "&amp;").replace("<", "&lt;")
    out = io.BytesIO()
    styles = {"Title": "Title", "Heading1": "heading 1", "Heading2": "heading 2", "ListBullet": "List Bullet", "ListNumber": "List Number", "Quote": "Quote"}
    body = ""
    for style, text in WORD:
        font = f'<w:rPr><w:rFonts w:ascii="{style[1:]}"/></w:rPr>' if style.startswith(":") else ""
        own = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style and not font else ""
        body += f'<w:p>{own}<w:r>{font}<w:t xml:space="preserve">{esc(text)}</w:t></w:r></w:p>'
    cell = lambda s, span=1: f'<w:tc><w:tcPr><w:gridSpan w:val="{span}"/></w:tcPr><w:p><w:r><w:t>{esc(s)}</w:t></w:r></w:p></w:tc>'
    body += f"<w:tbl><w:tr>{cell('k')}{cell('v')}</w:tr><w:tr>{cell('@', 2)}</w:tr></w:tbl>"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f"<w:document {_W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {_W}>" + "".join(f'<w:style w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in styles.items()) + "</w:styles>")
        z.writestr("docProps/core.xml", f'<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{esc("Deed @")}</dc:title><dc:creator>Ada</dc:creator></c>')
    return out.getvalue()


def word_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([word_file(x) for x in b.column(1).to_pylist()], pa.binary())], names=["p_partkey", "content"])

    return spread(read(spark, sf_dir, "part").select("p_partkey", "p_brand")).mapInArrow(run, "p_partkey long, content binary")


@query(_rows("part", "p_partkey", "p_brand", "section ord kind text start", WORD_BLOCKS))
def word_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word files, known by their first bytes: styles, code, table, properties."""
    t = ChunkEngine().trees(word_documents(spark, sf_dir))
    b = t.select("p_partkey", "sections", F.explode("blocks").alias("b"))
    return b.select("p_partkey", F.expr("sections[b.section].title").alias("section"), F.col("b.ord").cast("long").alias("ord"), "b.kind", "b.text", F.col("b.start").cast("long").alias("start"))


@query(f"""WITH {_TURNS}, c AS (SELECT *, len(string_split(text, chr(10))) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM t),
l AS (SELECT *, 5 + coalesce(sum(n + 3) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM c)
SELECT conv_id, 'chunk-' || lpad(CAST(i AS VARCHAR), 4, '0') AS chunk_id, CAST(first AS BIGINT) AS start_line, CAST(first + n - 1 AS BIGINT) AS end_line, CAST(strlen(h1 || '    ## ' || h2) // 3 + strlen(text) // 3 AS BIGINT) AS estimate, 'talk ' || conv_id AS document_path FROM l""".replace("strlen(h1 || '    ## ' || h2)", "strlen(h1 || '  ## ' || h2)"))
def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line ranges, estimates and paths of chunks, counted incrementally."""
    d = conversations_markdown(spark, sf_dir).withColumn("source_path", F.concat(F.lit("talk "), "conv_id"))
    c = ChunkEngine(SplitOptions("section", max_tokens=100_000)).split(d)
    return c.select("conv_id", "chunk_id", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.col("estimated_token_count").cast("long").alias("estimate"), "document_path")


@query(f"""WITH {_TURNS} SELECT conv_id, 'Conversation ' || conv_id AS own_title, 1::BIGINT AS section_level, md5(string_agg('## ' || h2 || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS body_md5, count(*) AS n_turns FROM t GROUP BY conv_id""")
def demoted_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Below the deepest heading level, headings are paragraphs of the section that stays."""
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))
    c = ChunkEngine(SplitOptions("section", max_tokens=1_000_000, max_heading_level=1)).split(conversations_markdown(spark, sf_dir))
    return c.select("conv_id", "own_heading.title", "section_level", F.md5(F.col("body").cast("binary")).alias("body_md5")).withColumnRenamed("title", "own_title").withColumn("section_level", F.col("section_level").cast("long")).join(turns, "conv_id")


_TAILS = """SELECT c_custkey, w // 21 + CASE WHEN w % 21 > 0 THEN 1 ELSE 0 END AS plain, w // 21 + CASE WHEN w % 21 > 0 THEN 1 ELSE 0 END - CASE WHEN w >= 21 AND w % 21 BETWEEN 1 AND 19 THEN 1 ELSE 0 END AS merged FROM (SELECT c_custkey, c_custkey % 300 + 1 AS w FROM customer)"""


@query(_TAILS)
def merged_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of chunks of texts of two-letter words, without and with merging of small tails."""
    c = spread(read(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", F.expr("array_join(array_repeat('ab', int(c_custkey % 300 + 1)), ' ')").alias("text"), F.lit("markdown").alias("format"))
    n = lambda ratio, exact: ChunkEngine(SplitOptions("section", exact=exact, max_tokens=40, ideal_ratio=0.5, merge_below_ratio=ratio)).split(c).groupBy("c_custkey")
    return n(0.0, True).agg(F.count(F.lit(1)).alias("plain")).join(n(0.5, True).agg(F.count(F.lit(1)).alias("merged")), "c_custkey")


# sums of parts, not of the joined text: the last word more or less still fits
@query(_TAILS.replace("BETWEEN 1 AND 19", "BETWEEN 1 AND 20"))
def merged_tails_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by incremental counting."""
    c = spread(read(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", F.expr("array_join(array_repeat('ab', int(c_custkey % 300 + 1)), ' ')").alias("text"), F.lit("markdown").alias("format"))
    n = lambda ratio: ChunkEngine(SplitOptions("section", max_tokens=40, ideal_ratio=0.5, merge_below_ratio=ratio)).split(c).groupBy("c_custkey")
    return n(0.0).agg(F.count(F.lit(1)).alias("plain")).join(n(0.5).agg(F.count(F.lit(1)).alias("merged")), "c_custkey")


@query("""SELECT p_partkey, 'markdown' AS format, p_brand || ' [**' || p_type || '** `' || p_size || '`](/parts/' || p_partkey || ' "Part") *' || p_name || '*' AS title,
  '-1:0:text:' || p_brand || ' |-1:1:link:|-1:1.0:strong:|-1:1.0.0:text:' || p_type || '|-1:1.1:text: |-1:1.2:code_span:' || p_size || '|-1:2:text: |-1:3:emphasis:|-1:3.0:text:' || p_name
  || '|0:0:strong:|0:0.0:text:a |0:0.1:emphasis:|0:0.1.0:text:' || p_name || '|0:1:soft_break:' || chr(10) || '|0:2:math_inline:' || p_size || '_i|0:3:text: & *' AS nodes FROM part
UNION ALL SELECT p_partkey, 'html', p_brand || ' ' || p_type, '-1:0:text:' || p_brand || ' |-1:1:strong:' || p_type || '|0:0:text:see |0:1:link:' || p_name || '|0:2:image:pic' FROM part""")
def inline_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of titles and paragraphs made of parts: emphasis, links, code, math and breaks, nested; inline tags of HTML."""
    p = spread(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"))
    md = F.format_string("# %s [__%s__ `%d`](/parts/%d 'Part') _%s_\n\n**a *%s***\n$%d_i$ &amp; \\*", "p_brand", "p_type", "p_size", "p_partkey", "p_name", "p_name", "p_size")
    html = F.format_string("<body><h1>%s <b>%s</b></h1><p>see <a href='/x'>%s</a><img alt=pic></p></body>", "p_brand", "p_type", "p_name")
    made = F.explode(F.create_map(F.lit("markdown"), md, F.lit("html"), html)).alias("format", "text")
    t = ChunkEngine().trees(p.select("p_partkey", made), inlines=True)
    node = lambda n: F.concat_ws(":", n["ord"], F.array_join(n["path"].cast("array<string>"), "."), n["kind"], n["text"])
    return t.select("p_partkey", "format", F.col("sections")[1]["title"].alias("title"), F.array_join(F.transform("inlines", node), "|").alias("nodes"))
