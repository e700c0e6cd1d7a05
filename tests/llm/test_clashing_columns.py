"""Extra columns of any name: none is lost, names stay distinct, and a writer accepts the result."""

import pytest
from pyspark.sql import functions as F

from textloom.llm import chat, mixing, ngram_join, pii, quality_classifier, quality_rules, secrets, sentencepiece_lattice, token_counts, topk
from textloom.llm.entry import tokenizer_path

NAMES = (
    "n_words n_bytes n_tokens over_limit ids n_pieces round_trip spans spans_input pii kept base_failed rejected_by row t s h c d n m k j p r o w g id th sid _row _t _words _m _g _h _c _id _k _s _si _sh _spans _key "
    "_new size target taken unit mask sources copies node root tok hash owner repo owners documents found judged none _none_ turns formatted"
).split()
PASSING = {
    "rules": lambda d: quality_rules.judge(d, rules=list(quality_rules.RULES)),
    "scan": secrets.scan,
    "redact": secrets.redact,
    "mix": mixing.mix,
    "keep_one": ngram_join.keep_one,
    "pii": lambda d: pii.pseudonymize(d, "key"),
    "tokens": lambda d: token_counts.count_tokens(d, tokenizer_path("byte_bpe_50k.json")),
    "pieces": lambda d: sentencepiece_lattice.encode(d, tokenizer_path("piece_bpe_32k.model"), head=10),
}


@pytest.fixture(scope="module")
def docs(spark):
    text = "token=Abc123defgh born 1984-02-29 " + " ".join(f"word{i}" for i in range(60))
    d = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    return d.select("*", *(F.lit(f"own {n}").alias(n) for n in NAMES), F.lit("own dot").alias("a.b"))


@pytest.mark.parametrize("name", PASSING)
def test_operators_that_pass_columns_through(docs, name, tmp_path):
    got = PASSING[name](docs)
    assert len({c.lower() for c in got.columns}) == len(got.columns)
    got.write.parquet(str(tmp_path / "out"))
    rows = docs.sparkSession.read.parquet(str(tmp_path / "out")).collect()
    assert rows
    for r in rows:
        values = [v for v in r if isinstance(v, str)]
        assert all(f"own {n}" in values for n in NAMES) and "own dot" in values
        assert all(r[n] == f"own {n}" for n in NAMES if n in r and f"{n}_input" not in r.asDict() and f"{n}_input_input" not in r.asDict())


def test_operators_that_ignore_other_columns(docs, spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int").withColumn("_label", F.lit("x")).withColumn("_text", F.lit("y"))
    assert [c for c, _ in ngram_join.join(docs).dtypes] == ["doc_id", "n_shingles", "component_id"] and ngram_join.join(docs).count() == 1
    assert mixing.copies(docs).count() == 1
    more = docs.withColumn("_label", F.lit("x")).withColumn("_text", F.lit("y"))
    assert quality_classifier.score(more, quality_classifier.train(more, labels)).count() == 1
    vectors = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>").selectExpr("*", "1 as q", "2 as b", "3 as kind", "4 as score", "5 as rank")
    assert topk.search(vectors, F.col("vec_id") == 0).count() == 1
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string").selectExpr("*", "1 as t", "2 as turns", "3 as formatted", "4 as _parts")
    assert chat.digest(chat.render(chat.gather(turns))).count() == 1
