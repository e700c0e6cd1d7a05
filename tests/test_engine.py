"""The engine over DataFrames: sources, detection, errors, streaming, JSON, command line."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from textloom.functions import headings, packing, text, tokens
from textloom.operators import docx, pieces
from textloom.options import BlockOption, SplitOptions, from_json, from_mapping, from_short, options_by_kind
from textloom.plans import queries
from textloom.plans.engine import ChunkEngine
from textloom.sources import documents
from textloom.streaming import chunks as stream

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def word_file(*body, title="Report"):
    styles = "".join(f'<w:style w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in (("H1", "heading 1"), ("H2", "heading 2"), ("LB", "List Bullet"), ("Q", "Quote")))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/styles.xml", f"<w:styles {W}>{styles}</w:styles>")
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{''.join(body)}</w:body></w:document>")
        z.writestr("docProps/core.xml", f'<c:p xmlns:c="c" xmlns:d="d"><d:title>{title}</d:title><d:creator>Ada</d:creator></c:p>')
    return out.getvalue()


def para(t, style=None, font=None):
    s = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    f = f'<w:rPr><w:rFonts w:ascii="{font}"/></w:rPr>' if font else ""
    return f"<w:p>{s}<w:r>{f}<w:t>{t}</w:t></w:r></w:p>"


TABLE = "<w:tbl><w:tr>" + "".join(f"<w:tc>{para(x)}</w:tc>" for x in "ab") + f"</w:tr><w:tr><w:tc>{para('1')}</w:tc></w:tr></w:tbl>"
WORD = word_file(para("Intro", "H1"), para("Text"), para("item", "LB"), para("said", "Q"), para("x = 1", None, "Consolas"), para("Deep", "H2"), TABLE)


def test_docx_tree():
    t = docx.parse(WORD)
    assert t.title == "Report" and t.metadata == {"title": "Report", "author": "Ada"}
    one = t.root.children[0]
    assert [(b.kind, b.text, b.start) for b in one.blocks] == [("paragraph", "Text", 2), ("list", "- item", 4), ("blockquote", "> said", 5), ("code_block", "```\nx = 1\n```", 6)]
    assert one.children[0].blocks[0].text == "| a | b |\n| --- | --- |\n| 1 |  |"
    assert docx.parse(WORD, "").title == "" and docx.parse(word_file(para("Intro", "H1"), title="")).title == "Intro"


def test_bytes_of_all_formats(spark):
    d = spark.createDataFrame([(1, bytearray(WORD)), (2, bytearray(b"<h1>T</h1><p>x")), (3, bytearray("# T\n\nä".encode()))], "id int, content binary")
    got = {r.id: (r.format, r.document_title, r.body) for r in ChunkEngine().split(d).where("chunk_id = 'chunk-0001'").collect()}
    assert got[1][:2] == ("docx", "Report") and got[2] == ("html", "T", "x") and got[3] == ("markdown", "T", "ä")


def test_suffix_wins_over_content(spark):
    d = spark.createDataFrame([(1, "<h1>x</h1>", "captured.md"), (2, "<h1>x</h1>", "a.unknown"), (3, "# x", "B.HTM"), (4, "# x", None)], "id int, text string, source_path string")
    assert {r.id: r.format for r in ChunkEngine().prepare(d).collect()} == {1: "markdown", 2: "html", 3: "html", 4: "markdown"}
    with pytest.raises(Exception, match="Unsupported input format"):
        ChunkEngine().prepare(d.withColumn("format", F.lit("pdf"))).collect()


def test_errors_fail_or_stay(spark):
    d = spark.createDataFrame([(1, bytearray(b"\xff\xfe"), "docx"), (2, bytearray(b"# T\n\nb"), "markdown")], "id int, content binary, format string")
    got = {r.id: (r.body, r.error) for r in ChunkEngine(on_error="keep").split(d).collect()}
    assert got[2] == ("b", None) and got[1][0] is None and "BadZipFile" in got[1][1]
    with pytest.raises(Exception, match="BadZipFile"):
        ChunkEngine().split(d).collect()


def test_bad_formats_and_bytes_stay_as_errors(spark):
    d = spark.createDataFrame([(1, bytearray(b"x"), "pdf"), (2, bytearray(b"\xff\xfe"), None), (3, bytearray(b"\xff"), "markdown"), (4, bytearray(b"b"), None)], "id int, content binary, format string")
    got = {r.id: (r.body, r.error) for r in ChunkEngine(on_error="keep").split(d).collect()}
    assert got[4] == ("b", None) and [got[i][0] for i in (1, 2, 3)] == [None] * 3
    assert "Unsupported input format: pdf" in got[1][1] and "non-DOCX binary input" in got[2][1] and "valid UTF-8" in got[3][1]
    with pytest.raises(Exception, match="non-DOCX binary input"):
        ChunkEngine().split(d.where("id = 2")).collect()


def test_empty_documents_and_tables(spark):
    d = spark.createDataFrame([(1, ""), (2, None), (3, " \n "), (4, "x")], "id int, text string")
    assert [r.id for r in ChunkEngine().split(d).collect()] == [4]
    assert ChunkEngine().split(d.limit(0)).count() == 0 and ChunkEngine().trees(d.limit(0)).count() == 0


def test_metadata_titles_and_lines(spark):
    d = spark.sql("select 1 id, '---\\ntitle: A\\nauthor: Ada\\n---\\n\\n# G\\n\\nbody\\n\\nmore' text, map('author', 'Eve') metadata, 'markdown' format")
    t = ChunkEngine().trees(d).first()
    assert t.title == "A" and t.metadata == {"title": "A", "author": "Eve"}
    c = {r.own_heading and r.own_heading.title: r for r in ChunkEngine().split(d).collect()}
    assert (c["G"].start_line, c["G"].end_line, c["G"].section_level, c["G"].ancestor_headings) == (8, 10, 1, []) and c[None].start_line == 1


def test_other_tokenizers_agree_with_their_counts(spark):
    d = spark.createDataFrame([(1, "# A\n\n" + "word " * 60)], "id int, text string")
    for c in ChunkEngine(SplitOptions("sibling", max_tokens=80), ("characters",)).split(d).collect():
        assert c.body_token_count == len(c.body) and c.token_count <= 80 and c.headings_token_count == 3
    with pytest.raises(ValueError, match="Unsupported tokenizer"):
        ChunkEngine(tokenizer=("none",))


def test_plan_has_no_shuffle(spark):
    d = spark.range(10).select("id", F.lit("# A\n\nb").alias("text"))
    assert "Exchange" not in ChunkEngine().split(d)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [4, 9, 20, 60])
def test_native_pieces_equal_the_fold(spark, limit):
    texts = ["a b. c d! e", "one two three four five six seven. Eight nine?\nten eleven twelve thirteen", "x\n\ny " * 20, "see https://example.com/" + "a" * 80 + " ok", "é ü ö " * 15, ""]
    count = tokens.Approx().count
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    for r in d.select("id", "text", packing.pieces(F.col("text"), limit).alias("p")).collect():
        assert r.p is None or list(r.p) == pieces.text_pieces(r.text, limit, count)


def test_native_pieces_cut_words_that_are_too_long(spark):
    texts = ["x" * 10_000, "short " + "é漢😀" * 300 + " end", "a\n" + "y" * 500, " " * 300 + "z" * 200, " " * 300]
    d = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", packing.pieces(F.col("t"), 64).alias("p"))
    got = {r.i: r.p for r in d.collect()}
    assert got == {i: pieces.text_pieces(t, 64, lambda s: len(s.encode()) // 3) for i, t in enumerate(texts)}
    assert len(got[0]) == 52 and "".join(got[0]) == texts[0]


def test_text_functions(spark):
    dirty = "﻿# Title\r\n\r\n**bold**  \r\n\0"
    d = spark.createDataFrame([(dirty,)], "t string")
    assert d.select(text.transform(text.normalize(F.col("t")))).first()[0] == "# Title\n\n**bold**  "
    plain = "# Title\n\nA **bold** and [soft](http://x) link. Keep snake_case.\n\n```py\nprint('x')\n```"
    html = "<p>one<br>two</p> *x*"
    got = spark.createDataFrame([(plain,), (html,)], "t string").select(text.plain_text(F.col("t"))).collect()
    assert got[0][0] == "Title\n\nA bold and soft link. Keep snake_case.\n\nprint('x')" and got[1][0] == "one\ntwo\n x"


def test_heading_functions(spark):
    d = spark.sql("select array(struct(1 as level, ' A ' as title), struct(7 as level, 'B' as title)) p, array(struct(1 as level, ' A ' as title)) q")
    r = d.select(headings.render(F.col("p")), headings.common(F.array("p", "q")), headings.ancestor(F.array("p", "p")), headings.deepest(F.col("p")), headings.common(F.array().cast(f"array<{headings.PATH}>"))).first()
    assert r[0] == "# A\n\n####### B" and [x.title for x in r[1]] == [" A "] and [x.level for x in r[2]] == [1] and r[3] == 7 and r[4] == []


def test_options():
    assert from_short(["table:isolated:60", "list:nosplit"], '{"list": {"max_tokens": 5}}') == [BlockOption("table", True, max_tokens=60), BlockOption("list", max_tokens=5)]
    assert from_json("") is None and SplitOptions.named("exact-sibling").exact
    for bad in (lambda: from_short(["nope"]), lambda: from_short(["list:x"]), lambda: from_json("{"), lambda: from_mapping({"list": {"repeat_header": True}}), lambda: SplitOptions.named("tree"), lambda: options_by_kind([BlockOption("a"), BlockOption("a")])):
        with pytest.raises(ValueError, match=".+"):
            bad()
    for bad in ({"max_tokens": 0}, {"ideal_ratio": 0.0}, {"merge_below_ratio": 1.0}, {"max_heading_level": -1}):
        with pytest.raises(ValueError, match=next(iter(bad))):
            SplitOptions(**bad)
    for bad in (lambda: BlockOption("a", max_tokens=True), lambda: BlockOption("a", isolated=1), lambda: from_json("[1]"), lambda: from_mapping({"a": 1})):
        with pytest.raises(TypeError, match=".+"):
            bad()


def test_files_json_and_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("# A\n\nbody\n\n[r]: /t 'T'")
    (tmp_path / "in/b.docx").write_bytes(WORD)
    (tmp_path / "in/c.txt").write_text("<p>raw</p>")
    d = documents.read_files(spark, str(tmp_path / "in"), titled=True)
    assert {r.document_title for r in ChunkEngine().split(d).collect()} == {"a.md", "b.docx", "c.txt"}
    from textloom import cli

    assert cli.main([str(tmp_path / "in"), str(tmp_path / "out"), "--splitter", "sibling", "--max-tokens", "50"]) == 0
    got = {x["document"]: x for r in spark.read.text(str(tmp_path / "out")).collect() for x in [json.loads(r[0])]}
    assert got["A"]["reference_definitions"] == {"r": {"destination": "/t", "title": "T"}} and got["A"]["chunks"][0]["body"] == "body" and set(got["A"]["chunks"][0]) == set(documents.CHUNK)
    assert got["Report"]["metadata"]["author"] == "Ada" and got["Anonymous"]["chunks"][0]["body"] == "<p>raw</p>"


def test_stream_equals_batch(spark, tmp_path):
    d = spark.range(20).select("id", F.concat(F.lit("# T\n\n"), F.repeat(F.lit("word "), F.col("id").cast("int"))).alias("text"))
    d.write.parquet(str(tmp_path / "in"))
    engine = ChunkEngine(SplitOptions(max_tokens=20))
    q = stream.write_chunks(engine, stream.read_stream(spark, str(tmp_path / "in"), d.schema), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    q.awaitTermination()
    rows = lambda x: sorted((r.id, r.chunk_id, r.body) for r in x.collect())
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(engine.split(d))


def test_sibling_query_takes_every_conversation(spark, tmp_path):
    word = "word "  # 5 bytes; the budget of a chunk is 1200 tokens of 3 bytes, and its target 80 % of that
    turns = [("a", [10, 10]), ("b", [400] * 6), ("c", [10, 5000, 10]), ("d", [3000])]  # fits whole; packs; one turn above every limit; nothing else
    rows = [(c, i, "user", (word * n).strip()) for c, t in turns for i, n in enumerate(t)]
    spark.createDataFrame(rows, "conv_id string, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: (r.n_chunks, r.n_turns) for r in queries.chunk_conversations_sibling(spark, str(tmp_path)).collect()}
    # 960 tokens hold one turn of 400 words, or 570 words below the headings: 9 pieces of the turn of 5000, 6 of the one of 3000
    assert got == {"a": (1, 2), "b": (6, 6), "c": (1 + 9 + 1, 3), "d": (6, 1)}


def test_json_of_documents_without_chunks_and_in_order_of_chunks(spark):
    d = spark.createDataFrame([(1, "# A\n\ntext", "markdown"), (2, "", "markdown"), (3, "  \n", "markdown")], "id long, text string, format string")
    got = {r.id: json.loads(r.json) for r in documents.document_json(ChunkEngine(), d, ["id"]).collect()}
    assert {i: (g["chunk_count"], len(g["chunks"])) for i, g in got.items()} == {1: (1, 1), 2: (0, 0), 3: (0, 0)}
    many = spark.createDataFrame([(1, "t", f"chunk-{i}") for i in (10_000, 9_999, 10_001)], "id long, document_title string, chunk_id string")
    ids = [c["chunk_id"] for c in json.loads(documents.chunk_json(many, ["id"]).first().json)["chunks"]]
    assert ids == ["chunk-9999", "chunk-10000", "chunk-10001"]
