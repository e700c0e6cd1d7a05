"""The pipeline's stages, each on the one before, against what their operators and brute force say."""

import random

from test_ngram_join import brute

import corpus_pipeline
from textloom.llm import quality_rules

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(11)
    vocab = ["".join(r.choice("aeioustrnl") for _ in range(r.randrange(2, 9))) for _ in range(500)]
    rows = []
    for i in range(60):
        w = [r.choice(vocab) for _ in range(r.randrange(60, 160))]
        if i % 5 == 0:
            w.insert(20, f"token=Secret{i}Value{r.randrange(10**9)}xyz")
        rows.append(" ".join(w))
    rows += [" ".join(["zz", *x.split()[1:]]) for x in rows[:10]] + rows[10:20]
    rows += [None, "", "too short", "BAD!! WORDS!! " * 60, "same words again " * 60, "x### y%%% " * 80]
    return [(i, t, "en", f"src{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(rows)]


def run_stages(spark, docs, tmp_path):
    out = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{i}"))
        docs = spark.read.parquet(str(tmp_path / f"out{i}"))
        out.append((name, docs))
    return out


def test_stages(spark, tmp_path):
    from sentencepiece import SentencePieceProcessor

    from textloom.llm.entry import tokenizer_path

    rows = corpus()
    docs = spark.createDataFrame(rows, DOC)
    (_, good), (_, unique), (_, masked), (_, mixed), (_, coded) = run_stages(spark, docs, tmp_path)
    assert all(d.columns == docs.columns for d in (good, unique, masked, mixed))
    kept = {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == kept and len(kept) >= 75
    alive = [(r.doc_id, r.text) for r in good.collect()]
    assert {r.doc_id for r in unique.collect()} == {root for _, root in brute(alive).values()} and unique.count() == len(alive) - 20
    texts = {r.doc_id: r.text for r in masked.collect()}
    assert len(texts) == unique.count() and not any("Secret" in t for t in texts.values()) and sum("[assign]" in t for t in texts.values()) == 12
    assert all(texts[i] == t for i, t in ((r.doc_id, r.text) for r in unique.collect()) if "token=" not in t)
    assert 0 < mixed.count() <= 3 * masked.count() and {r.text for r in mixed.collect()} <= set(texts.values())
    sp = SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = coded.collect()
    assert len(got) == mixed.count() and all(list(r.ids) == sp.encode(r.text) and r.round_trip for r in got)


def test_run_and_empty_tables(spark, tmp_path):
    spark.createDataFrame(corpus(), DOC).write.parquet(str(tmp_path / "a/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "a")).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None
    empty = spark.createDataFrame([], DOC)
    assert [d.count() for _, d in run_stages(spark, empty, tmp_path)] == [0] * 5
