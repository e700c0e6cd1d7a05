"""Top-k search, SentencePiece, token counts and the classifier against their definitions."""

import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import quality_classifier, sentencepiece_lattice, token_counts, topk
from textloom.llm.entry import tokenizer_path

BPE, SP = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def best(rows, queries, k=5):
    ok = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i in queries:
        own = min(([tuple(v) for j, v in ok if j == i]), default=None)
        if own is None:
            continue
        scored = sorted(((-int(sum(a * b for a, b in zip(own, v, strict=False))), j) for j, v in ok if j != i))[:k]
        out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)}
    return out


@pytest.mark.parametrize("block", [16384, 60])
def test_topk_is_exact(spark, block):
    r = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in r.normal(0, 0.15, 12)]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(50, None), (100, [1.0, None]), (150, [float("nan")] * 12), (2000, [float("inf")] * 12), (None, rows[1][1]), (2001, []), (2050, [0.5] * 3), (2100, [0.0] * 12)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = topk.search(d, F.col("vec_id") % 50 == 0, vector_block=block).collect()
    assert {tuple(x) for x in got} == best([(i, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v in rows], {i for i, _ in rows if i is not None and i % 50 == 0})


def test_topk_small_and_empty(spark):
    d = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (0, [1.0])], "vec_id long, embedding array<float>")
    assert [tuple(x) for x in topk.search(d, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.search(d.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_threshold_search_stops_early():
    r = np.random.default_rng(0)
    v = np.zeros((4000, 8))
    v[:, 0] = np.arange(4000)
    v[:, 1:] = r.integers(0, 3, (4000, 7))
    block, q = topk.Block(np.arange(4000), v.astype(np.int64)), np.array([9, 1, 0, 0, 0, 0, 0, -1])
    s = v @ q
    assert block.search(q, -1) == sorted(((int(x), i) for i, x in enumerate(s)), key=lambda z: (-z[0], z[1]))[:5]
    assert block.stopped == 1 and block.met < 2000


def test_threshold_search_ends_by_the_bound_or_with_all_met():
    r = np.random.default_rng(2)
    v = r.integers(-60, 60, (3000, 24))
    block = topk.Block(np.arange(3000), v)
    for i in range(20):
        met, stopped = block.met, block.stopped
        got = block.search(v[i], i)
        assert got == sorted(((int(s), j) for j, s in enumerate(v @ v[i]) if j != i), key=lambda z: (-z[0], z[1]))[:5]
        assert block.stopped > stopped or block.met - met == 2999


ODD = [None, "", " ", "a", "<|endoftext|>", "x<|endoftext|> y", "don't we'll", "  two  spaces \n\n\ttabs", "é ü 中文 🎉🎊", "\x1c\x1d\x85​_²", "a" * 500, " " * 40 + "x", "word " * 300, "</s><s><unk>", "▁ mark"]


def random_texts(seed, n):
    r = random.Random(seed)
    al = list("abcdefetohn  ___..²m2019é\n\t🎉中'ls")
    return ["".join(r.choice(al) for _ in range(r.randrange(60))) for _ in range(n)]


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    texts = ODD + random_texts(2, 800)
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, "a")], "doc_id long, text string").withColumn("n_tokens_", F.lit(1))
    got = token_counts.count_tokens(d.drop("n_tokens_"), BPE).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        t = texts[r.doc_id] or ""
        n = len(tok.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 512), t
    assert token_counts.count_tokens(d.limit(0), BPE).count() == 0


def test_whole_tokens_are_proved():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    whole = token_counts.whole_tokens(Path(BPE).read_bytes())
    assert len(whole) > 40_000 and all(len(tok.encode(s, add_special_tokens=False).ids) == 1 for s in list(whole)[:500]) and "<|endoftext|>" not in whole


@pytest.mark.parametrize("head", [600_000, 40, 0])
def test_sentencepiece_equals_the_library(spark, head):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=SP)
    texts = ODD + random_texts(3, 500)
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(3, "a", "y")], "doc_id long, text string, rank string")
    got = sentencepiece_lattice.encode(d, SP, head=head).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        t = texts[r.doc_id]
        assert list(r.ids) == sp.encode(t or ""), t
        assert r.n_pieces == len(r.ids) and r.text == t and (r.round_trip or sentencepiece_lattice.MARK in t)
    assert sentencepiece_lattice.encode(d.limit(0), SP).count() == 0


def test_relational_and_local_walks_agree(spark):
    pieces = sentencepiece_lattice.Pieces.load(SP)
    rank, most = dict(zip(pieces.strings, pieces.ranks, strict=True)), max(map(len, pieces.strings))
    r = random.Random(4)
    units = {"".join(r.choice("▁theinorsaéz.x") for _ in range(r.choice([20, 59, 60, 61, 150]))).lstrip("▁") for _ in range(200)} | {"".join(r.choice("▁theinorsaéz.x") for _ in range(r.randrange(1, 60))).lstrip("▁") for _ in range(300)} | {"中", "🎉🎊", "▁a"}
    units = {u for u in units if u and not sentencepiece_lattice.direct(u)}
    d = spark.createDataFrame([(u, 1) for u in units], "unit string, n long")
    got = {x.unit: (x.mask, x.cuts) for x in sentencepiece_lattice.encode_units(d, pieces).collect()}
    assert set(got) == units and {u: m for u, (m, _) in got.items() if len(u) <= 60} == {u: sentencepiece_lattice.walk(u, rank, most) for u in units if len(u) <= 60}
    assert all(sentencepiece_lattice.symbols(u, *m) == sentencepiece_lattice.merge(u, rank)[0] == sentencepiece_lattice.merge_short(u, rank) for u, m in got.items())


def test_viterbi_fold_finds_the_best_path(spark):
    scores = {"a": -3.0, "b": -3.5, "ab": -4.0, "ba": -5.1, "aba": -6.5, "bb": -9.0, "▁": -1.0, "▁a": -2.0}
    pieces = sentencepiece_lattice.Pieces(tuple(scores), tuple(range(len(scores))), tuple(range(len(scores))), tuple(scores.values()), tuple(range(1000, 1256)), "unigram")
    r = random.Random(6)
    units = {"▁" + "".join(r.choice("ab") for _ in range(r.randrange(9))) for _ in range(60)}

    def paths(u):
        return [(0.0, [])] if not u else [(s + scores[u[:k]], [u[:k], *p]) for k in range(1, 4) if u[:k] in scores for s, p in paths(u[k:])]

    got = sentencepiece_lattice.encode_units(spark.createDataFrame([(u, 1) for u in units], "unit string, n long"), pieces).collect()
    for x in got:
        found = sentencepiece_lattice.symbols(x.unit, x.mask, x.cuts)
        assert sum(scores[s] for s in found) == pytest.approx(max(paths(x.unit))[0], abs=1e-5) and found == sentencepiece_lattice.viterbi(x.unit, scores, 3)
    assert len(got) == len(units)


def unigram_model(scores):
    """A serialized unigram model with byte fallback, written field by field; nothing is trained."""
    import struct

    def field(n, value):
        if isinstance(value, int):
            return bytes([n << 3, value])
        size = len(value)
        return bytes([n << 3 | 2]) + (bytes([size]) if size < 128 else bytes([size & 127 | 128, size >> 7])) + value

    piece = lambda s, x, kind: field(1, field(1, s.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", x) + field(3, kind))
    rows = [piece("<unk>", 0, 2), piece("<s>", 0, 3), piece("</s>", 0, 3), *(piece(f"<0x{b:02X}>", 0, 6) for b in range(256)), *(piece(s, x, 1) for s, x in scores.items())]
    normal = field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1)
    return b"".join(rows) + field(2, field(3, 1) + bytes([35 << 3 & 127 | 128, 35 >> 4]) + b"\x01") + field(3, normal)


@pytest.mark.parametrize("head", [600_000, 10, 0])
def test_unigram_model_equals_the_library(spark, head, tmp_path):
    from sentencepiece import SentencePieceProcessor

    r = random.Random(9)
    scores = {"▁": -2.0, "▁a": -2.5, "ab": -3.25, "aba": -4.5, "ba": -4.0, "b": -3.0, "a": -2.75, "▁ab": -3.5, "bb": -5.75, "c": -3.0, "abc": -7.5, ".": -3.0, "..": -4.0}
    model = unigram_model(scores)
    (tmp_path / "m.model").write_bytes(model)
    sp = SentencePieceProcessor(model_proto=model)
    texts = [None, "", " ", "é", "a  b", "ab" * 700, "z.z..", "\n"] + ["".join(r.choice("aabbc  .é🎉") for _ in range(r.randrange(40))) for _ in range(300)] + ["ab" * 31 + "c"] * 3
    got = sentencepiece_lattice.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), str(tmp_path / "m.model"), head=head).collect()
    for x in got:
        assert list(x.ids) == sp.encode(texts[x.doc_id] or ""), texts[x.doc_id]


def test_a_vocabulary_that_one_walk_would_get_wrong_is_refused():
    bad = sentencepiece_lattice.Pieces(("a", "b", "c", "bc", "abc"), tuple(range(5)), (9, 9, 9, 5, 1), (0,) * 5, tuple(range(1000, 1256)))
    with pytest.raises(ValueError, match="rising rank"):
        sentencepiece_lattice.prove_monotone(bad)


def test_classifier_holds_out_and_generalizes(spark):
    r = random.Random(7)
    good = lambda: " ".join(r.choice(["the", "of", "river", "stone", "light", "and", "walks", "home"]) for _ in range(60)) + "."
    junk = lambda: " ".join(r.choice(["BUY", "now", "click", "free"]) + "!!" for _ in range(60))
    rows = [(i, junk() if i % 4 == 0 else good()) for i in range(600)] + [(900, None), (901, ""), (902, "word " * 20_000), (3, good())]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    # labels of held-out rows are wrong on purpose: they must not be learnt
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    labels = spark.createDataFrame([(i, int((i % 4 != 0) != held(i))) for i in range(600)] + [(None, 1), (5, None), (6, 7)], "doc_id long, quality int")
    model = quality_classifier.train(d, labels)
    got = quality_classifier.score(d, model).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) and x.held_out == held(x.doc_id) for x in got)
    hits = [x.predicted == (x.doc_id % 4 != 0) for x in got if x.held_out and x.doc_id < 600]
    assert sum(hits) / len(hits) > 0.97
    none = quality_classifier.train(d, labels.limit(0))
    assert {x.score for x in quality_classifier.score(d, none).collect()} == {0.5} and quality_classifier.score(d.limit(0), model).count() == 0


def test_ratios_and_weights_solve_the_dual():
    r = np.random.default_rng(5)
    rows = [np.unique(r.choice(60, 9) + 40 * int(i % 3 == 0)).astype(np.int32) for i in range(90)]
    y = np.array([int(i % 3 == 0) ^ int(i % 11 == 0) for i in range(90)])
    m = quality_classifier.fit(rows, y, epochs=4000)
    counts = {s: np.ones(1 << quality_classifier.BITS) for s in (0, 1)}
    for row, t in zip(rows, y, strict=True):
        for k in row:
            counts[t][k] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    used = np.unique(np.concatenate(rows))
    assert np.allclose(m.ratios[used], ratio[used], atol=1e-5) and not m.ratios[np.setdiff1d(np.arange(1 << quality_classifier.BITS), used)].any()
    # the primal value of these weights is the dual optimum that a slow projected ascent finds
    x = np.zeros((90, len(used) + 1))
    for i, row in enumerate(rows):
        v = ratio[row] / np.sqrt((ratio[row] ** 2).sum())
        x[i, np.searchsorted(used, row)] = v
    x[:, -1] = 1
    s = np.where(y == 1, 1.0, -1.0)
    cost = np.where(y == 1, 90 / (2 * y.sum()), 90 / (2 * (90 - y.sum())))
    g = (x * s[:, None]) @ (x * s[:, None]).T
    a, step = np.zeros(90), 1 / np.linalg.eigvalsh(g)[-1]
    for _ in range(60_000):
        a = np.clip(a + step * (1 - g @ a), 0, cost)
    dual = a.sum() - a @ g @ a / 2
    w = np.append(np.divide(m.weights[used], ratio[used], out=np.zeros(len(used)), where=ratio[used] != 0), m.bias)
    primal = w @ w / 2 + (cost * np.maximum(0, 1 - s * (x @ w))).sum()
    assert dual <= primal + 1e-6 and primal - dual < 2e-3 * dual


def test_repeated_labelled_rows_count_once(spark):
    rows = [(i, "good words " * 9 if i % 2 else "BAD!! " * 9) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    once, often = (quality_classifier.train(spark.createDataFrame(rows * k, "doc_id long, text string"), labels) for k in (1, 3))
    assert (once.weights == often.weights).all() and once.bias == often.bias
