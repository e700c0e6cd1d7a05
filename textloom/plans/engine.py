"""Corpora of documents to chunks: detection, parsing, splitting and finishing as one map-only plan.

Detection and finishing (normalizing, transforming, dropping, counting, numbering) are Catalyst
expressions; parsing and splitting are one Arrow pass over rows. No step shuffles, so the same plan runs on a stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import headings as H
from textloom.functions import text as X
from textloom.functions.tokens import approx_tokens, tokenizer
from textloom.model import Tree
from textloom.operators import docx, html, markdown
from textloom.operators.splitting import render, splitter
from textloom.options import SplitOptions
from textloom.shipping import ship

_HEADING = "struct<level:int,title:string>"
_DRAFT = f"struct<body:string,headings:array<{_HEADING}>,own:{_HEADING},kind:string,origin:string,estimate:int,level:int,start:int,end:int>"
PARSED = f"title string, metadata map<string,string>, references map<string,struct<destination:string,title:string>>, drafts array<{_DRAFT}>, error string"
SECTION = f"struct<id:int,parent:int,level:int,title:string,path:array<{_HEADING}>,index:int,start:int>"
BLOCK = "struct<section:int,ord:int,kind:string,text:string,start:int,end:int,items:array<string>,attrs:map<string,string>>"
CHILD = "struct<section:int,ord:int,path:array<int>,kind:string,text:string,start:int,end:int>"
INLINE = "struct<section:int,ord:int,path:array<int>,kind:string,text:string,attrs:map<string,string>>"
TREE = f"title string, metadata map<string,string>, references map<string,struct<destination:string,title:string>>, sections array<{SECTION}>, blocks array<{BLOCK}>, children array<{CHILD}>, error string"


#: (text or bytes, title, metadata) -> tree.
DocumentParser = Callable[[object, str | None, dict[str, str]], Tree]


def parse(fmt: str, text: str | None, content: bytes | None, title: str | None, metadata: dict | None, config: markdown.MarkdownConfig | None = None, parsers: Mapping[str, DocumentParser] | None = None, inlines: bool = False) -> Tree:
    if parsers and fmt in parsers:
        return parsers[fmt](content if text is None else text, title, metadata or {})
    if fmt == "docx":
        if content is None:
            raise TypeError("a word document must be bytes")
        return docx.parse(content, title, metadata, inlines)
    if fmt == "binary":
        raise ValueError("Unable to infer format from non-DOCX binary input")
    if fmt not in ("markdown", "html"):
        raise ValueError(f"Unsupported input format: {fmt}")
    if text is None:
        try:
            text = (content or b"").decode()
        except UnicodeDecodeError as e:
            raise ValueError("Non-DOCX bytes must contain valid UTF-8") from e
    return html.parse(text, title, metadata) if fmt == "html" else markdown.parse(text, title, metadata, config or markdown.MarkdownConfig())


#: In what parsers hand to Arrow, a struct is a tuple of its fields in order.
def _pairs(m: dict[str, str]) -> list[tuple[str, str]]:
    return [(str(k), str(v)) for k, v in m.items()] if m else []


#: What is parsed before its results are handed on: rows, and bytes of documents.
SLICE_ROWS, SLICE_BYTES = 256, 1 << 20


def _slices(batch: pa.RecordBatch, columns: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of ``SLICE_ROWS`` rows at most, and ``SLICE_BYTES`` but for a row that is larger alone; an empty batch as it is."""
    sizes = [sum(x) for x in zip(*(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_pylist() for c in columns), strict=True)]
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and (i - start >= SLICE_ROWS or held + n > SLICE_BYTES):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


#: Names of the columns that an engine adds.
RESULTS = frozenset(
    "title references drafts error sections blocks children inlines chunk_id chunk_type body token_count estimated_token_count headings_token_count body_token_count ancestor_headings own_heading section_level document_path start_line end_line _n _d _h _b _s".split()
)


@dataclass(frozen=True)
class ChunkEngine:
    """Splits a DataFrame of documents.

    Input columns (all optional but one of ``text`` and ``content``): ``text`` string, ``content`` binary,
    ``format``, ``source_path``, ``document_title``, ``metadata`` (map of overrides). All others are passed through.
    An input column with the name of a result's comes back as ``<name>_input``.
    ``on_error``: ``fail`` raises at the first bad document, ``keep`` gives it a row with ``error``.
    ``markdown``: rules and block kinds of Markdown. ``parsers``: parsers of one's own by format, instead of the engine's.
    ``splitter``: (options, tokenizer) -> an object whose ``split(root)`` gives drafts and whose ``total(draft)`` counts them.

    Defined results: an empty text has no chunks where empty ones are skipped; repeated rows are split one by one; an empty table
    gives an empty result; a document is split whole, in memory proportional to it.
    """

    options: SplitOptions = field(default_factory=SplitOptions)
    tokenizer: tuple = ("approx",)
    normalize: Callable[[Column], Column] = X.normalize
    transform: Callable[[Column], Column] = X.transform
    on_error: str = "fail"
    markdown: markdown.MarkdownConfig = field(default_factory=markdown.MarkdownConfig)
    parsers: Mapping[str, DocumentParser] = field(default_factory=dict)
    splitter: Callable = splitter

    def __post_init__(self) -> None:
        tokenizer(*self.tokenizer)  # unknown names and missing packages show on the driver
        if self.on_error not in ("fail", "keep"):
            raise ValueError("on_error must be fail or keep")
        if unknown := set(self.parsers) - {"markdown", "html", "docx"}:
            raise ValueError(f"parsers for unknown formats: {', '.join(sorted(unknown))}")

    def prepare(self, docs: DataFrame) -> DataFrame:
        """``docs`` with all input columns, the format detected."""
        types = {"text": "string", "content": "binary", "format": "string", "source_path": "string", "document_title": "string", "metadata": "map<string,string>"}
        d = docs
        for name, kind in types.items():
            if name not in docs.columns:
                d = d.withColumn(name, F.lit(None).cast(kind))
        content = F.col("content") if "content" in docs.columns else None
        for c in docs.columns:  # an input column of a result's name stays, under another one
            if c.lower() in RESULTS and c not in types:
                new = f"{c}_input"
                while new.lower() in {x.lower() for x in d.columns}:
                    new += "_input"
                d = d.withColumnRenamed(c, new)
        return d.withColumn("format", X.detect(F.col("text"), F.col("source_path"), F.col("format"), content, strict=self.on_error == "fail"))

    def _map(self, docs: DataFrame, schema: str, row: Callable) -> DataFrame:
        ship(docs.sparkSession)
        keep = self.on_error == "keep"
        extra = T.StructType.fromDDL(schema)
        inputs = ("format", "text", "content", "document_title", "metadata")
        rest = [c for c in docs.columns if c not in ("text", "content", "document_title", "metadata")]
        out = T.StructType([docs.schema[c] for c in rest] + list(extra))
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(extra)
        names = extra.names

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (part for whole in batches for part in _slices(whole, ("text", "content"))):
                made = []
                for values in zip(*(b.column(c).to_pylist() for c in inputs), strict=True):
                    try:
                        made.append((*row(*values), None))
                    except Exception as e:
                        if not keep:
                            raise
                        made.append((*([None] * (len(names) - 1)), f"{type(e).__name__}: {e}"))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), arrow, strict=True)] if made else [pa.array([], f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *columns], names=[*rest, *names])

        return docs.mapInArrow(run, out)

    def trees(self, docs: DataFrame, inlines: bool = False) -> DataFrame:
        """One row per document: title, metadata, references, ``sections`` and ``blocks`` as arrays.

        ``children`` has the blocks inside quotes, lists and blocks of one's own: of which section's which block, and the path of places below it.
        With ``inlines`` there is a column of that name too: the nodes of titles (``ord`` -1) and of blocks, parents first. A node's path is its
        place below the block; in a block's children, the child's path and -1 come first.
        """
        config, parsers = self.markdown, dict(self.parsers)

        def row(fmt, text, content, title, metadata):
            t = parse(fmt, text, content, title, dict(metadata or {}), config, parsers, inlines)
            sections, blocks, children, nodes = [], [], [], []
            if inlines and fmt == "markdown" and fmt not in parsers:
                markdown.add_inlines(t)

            def running(section: int, top: int, found: list, place: tuple[int, ...]) -> None:
                todo = [(n, (*place, i)) for i, n in reversed(list(enumerate(found)))]
                while todo:
                    n, at = todo.pop()
                    nodes.append((section, top, at, n.kind, n.text, _pairs(n.attrs)))
                    if n.children:
                        todo += [(c, (*at, i)) for i, c in reversed(list(enumerate(n.children)))]

            def inside(section: int, top: int, b, place: tuple[int, ...]) -> None:
                for i, c in enumerate(b.children):
                    children.append((section, top, (*place, i), c.kind, c.text, c.start, c.end))
                    running(section, top, c.inlines if inlines else [], (*place, i, -1))
                    inside(section, top, c, (*place, i))

            def walk(s, parent: int, index: int) -> None:
                me = len(sections)
                sections.append((me, parent, s.level, s.title, s.path, index, s.start))
                blocks.extend((me, i, b.kind, b.text, b.start, b.end, b.items, _pairs(b.attrs)) for i, b in enumerate(s.blocks))
                running(me, -1, s.inlines if inlines else [], ())
                for i, b in enumerate(s.blocks):
                    running(me, i, b.inlines if inlines else [], ())
                    inside(me, i, b, ())
                for i, c in enumerate(s.children):
                    walk(c, me, i)

            walk(t.root, -1, 0)
            return t.title, _pairs(t.metadata), list(t.references.items()), sections, blocks, children, *([nodes] if inlines else [])

        return self._map(self.prepare(docs), TREE.replace(", error", f", inlines array<{INLINE}>, error") if inlines else TREE, row)

    def drafts(self, docs: DataFrame) -> DataFrame:
        """One row per document with its drafts, before finishing."""
        options, name, config, parsers, make = self.options, self.tokenizer, self.markdown, dict(self.parsers), self.splitter

        def row(fmt, text, content, title, metadata):
            t = parse(fmt, text, content, title, dict(metadata or {}), config, parsers)
            s = make(options, tokenizer(*name))
            out = [
                (
                    render(d.entries, d.path), d.path, d.own, d.kind, d.origin, s.total(d), max((a for e in d.entries for a, _ in e.path), default=0),
                    min((e.start for e in d.entries if e.start is not None), default=None), max((e.end for e in d.entries if e.end is not None), default=None),
                )
                for d in s.split(t.root)
            ]
            return t.title, _pairs(t.metadata), list(t.references.items()), out

        return self._map(self.prepare(docs), PARSED, row)

    def _count(self, text: Column) -> Column:
        if self.tokenizer[0] == "approx":
            return approx_tokens(text)
        name = self.tokenizer

        @F.pandas_udf(T.IntegerType())
        def count(s: pd.Series) -> pd.Series:
            t = tokenizer(*name)
            return s.map(t.count, na_action="ignore").astype("Int32")

        return count(text)

    def split(self, docs: DataFrame) -> DataFrame:
        """One row per chunk: the documents' other columns, then the chunk's fields."""
        d = self.drafts(docs)
        reserved = {"title", "metadata", "references", "drafts", "error"}
        rest = [c for c in d.columns if c not in reserved and c != "source_path"]
        finished = F.transform("drafts", lambda x: x.withField("body", self.transform(self.normalize(x["body"]))))
        if self.options.skip_empty:
            finished = F.filter(finished, lambda x: x["body"].rlike(r"(?U)[^\s\x{1c}-\x{1f}]"))
        error = ["error"] if self.on_error == "keep" else []
        explode = F.posexplode_outer if self.on_error == "keep" else F.posexplode
        c = d.select(*rest, "title", "source_path", *error, explode(finished).alias("_n", "_d"))
        body, path = F.col("_d.body"), F.col("_d.headings")
        c = c.withColumn("_h", self._count(H.render(path))).withColumn("_b", self._count(body)).withColumn("_s", self._count(F.lit("\n\n")))
        total = F.col("_h") + F.col("_s") + F.col("_b")
        return c.select(
            *rest,
            F.when(F.col("_n").isNotNull(), F.format_string("chunk-%04d", F.col("_n") + 1)).alias("chunk_id"),
            F.col("_d.kind").alias("chunk_type"), body.alias("body"), total.alias("token_count"),
            (total if self.options.exact else F.col("_d.estimate")).alias("estimated_token_count"), F.col("_h").alias("headings_token_count"), F.col("_b").alias("body_token_count"),
            F.when(F.col("_d.own").isNotNull(), F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))).otherwise(path).alias("ancestor_headings"),
            F.col("_d.own").alias("own_heading"), F.col("_d.level").alias("section_level"), F.col("title").alias("document_title"), F.col("source_path").alias("document_path"),
            F.col("_d.start").alias("start_line"), F.col("_d.end").alias("end_line"), *error,
        )
