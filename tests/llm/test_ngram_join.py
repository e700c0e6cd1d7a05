"""The n-gram join against all pairs, with lists and sets small enough to take every way through it."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import ngram_join
from textloom.llm.components import components


def shingle_sets(rows):
    out = {}
    for i, t in rows:
        w = (t or "").encode().translate(ngram_join._LOWER).split()
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def brute(rows):
    sets = shingle_sets(rows)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocab) for _ in range(30)]
    rows = []
    for _ in range(14):  # families of near copies around the threshold, of all sizes
        base = [r.choice(vocab) for _ in range(r.choice([5, 6, 8, 10, 12, 20, 60, 90]))]
        for _ in range(r.choice([1, 2, 9, 14])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append(w[: len(w) - r.choice([0, 0, 0, 1, 4])])
    for _ in range(25):  # texts that share a passage and little else
        rows.append([r.choice(vocab) for _ in range(r.randrange(40))] + passage + [r.choice(vocab) for _ in range(r.randrange(20))])
    rows += [["a"], ["a", "b"], ["A", "B"], ["a", "b", "c", "d"]]
    rows = [" ".join(w).upper() if r.random() < 0.1 else "\n".join(w) if r.random() < 0.1 else " ".join(w) for w in rows]
    rows += [None, "", " \t"] + rows[:5]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "sizes"), [(1, (2, 60, 2)), (2, (3, 1 << 20, 256)), (3, (40, 400, 30))])
def test_components_equal_all_pairs(spark, monkeypatch, seed, sizes):
    for name, n in zip(("SHORT", "BLOCK", "LEAST_MEMBER"), sizes, strict=True):
        monkeypatch.setattr(ngram_join, name, n)
    rows = corpus(seed)
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("own")).withColumn("sid", F.lit(3)).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(d).collect()}
    assert got == brute(rows)


def near_group(seed, copies, words, edits, passage=()):
    """Copies of one text with so many edits each: many pairs lie just below the threshold, with and without a shared passage."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    out = []
    for _ in range(copies):
        w = list(base)
        for k in r.sample(range(words), r.randrange(edits + 1)):
            w[k] = f"x{r.randrange(3)}"
        out.append(" ".join(w))
    out += [" ".join([*(f"own{i}_{k}" for k in range(10)), *passage]) for i in range(20)]
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("block", [300, 1 << 20])
def test_large_group_just_below_the_threshold(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block * 20)
    rows = near_group(4, 130, 60, 4, [f"p{i}" for i in range(30)])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert got == want and 30 < len({c for _, c in want.values()}) < 140


@pytest.mark.parametrize("seed", range(40))
def test_forest_equals_all_pairs(seed):
    r = np.random.default_rng(seed)
    base = r.integers(0, 2**63, 40).astype(np.uint64)
    pool = r.integers(0, 2**63, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate([r.choice(base, 40 - k, replace=False), r.choice(pool, k)])) for k in r.integers(0, 14, r.integers(1, 50))]
    lab = ngram_join.forest(sets)
    link = np.array([[4 * (i := len(np.intersect1d(a, b))) >= 3 * (len(a) + len(b) - i) for b in sets] for a in sets])
    for _ in sets:
        link = link @ link
    assert ((lab[:, None] == lab[None, :]) == link).all()
    assert (lab[lab] == lab).all()


def test_edges_of_the_input(spark):
    d = spark.createDataFrame([(7, "a b c d e f g"), (7, "a b c d e f g"), (None, "a b c d e f g"), (3, "a b c d e f g"), (9, None), (8, "")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(d).collect() if r.doc_id is not None)
    assert got == [(False, 3, 3, 3), (False, 7, 3, 3), (False, 7, 3, 3), (False, 8, 0, 8), (False, 9, 0, 9)]
    assert [r.component_id for r in ngram_join.join(d).where("doc_id is null").collect()] == [None]
    assert ngram_join.join(d.limit(0)).count() == 0
    assert sorted(r.doc_id for r in ngram_join.keep_one(d.where("doc_id is not null and doc_id <> 7")).collect()) == [3, 8, 9]


def test_null_id_before_its_copies(spark):
    rows = [(None, "a b c d e f g h i j k l"), (7, "a b c d e f g h i j k l"), (4, "a b c d e f g h i j k l"), (5, "a b c d e f g h i j k l m"), (6, "q r s t u v")]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert [r.component_id for r in ngram_join.join(d).where("doc_id is null").collect()] == [None]
    got = {r.doc_id: r.component_id for r in ngram_join.join(d).where("doc_id is not null").collect()}
    assert got == {7: 4, 4: 4, 5: 4, 6: 6}


def test_keep_one_of_repeated_conflicting_and_null_ids(spark):
    t = {k: " ".join(k + str(i) for i in range(12)) for k in "abcd"}
    rows = [(7, t["a"]), (7, t["a"]), (3, t["b"]), (7, t["b"]), (5, t["c"]), (5, t["d"]), (None, t["a"]), (None, "x y z"), (None, "x y z"), (None, "u v w"), (9, ""), (9, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("own")).repartition(3)
    got = ngram_join.keep_one(d)
    assert got.columns == d.columns
    want = [(3, t["b"]), (5, t["c"]), (5, t["d"]), (7, t["a"]), (9, ""), (None, "u v w"), (None, "x y z")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


def test_extra_columns_may_have_any_name(spark):
    rows = [(2, "a b c d e f", "x", 1, 5), (1, "a b c d e f", "y", 2, 6)]
    d = spark.createDataFrame(rows, "doc_id long, text string, id string, th int, _id int").selectExpr("*", "1 as row", "2 as h", "3 as copies", "4 as sid", "5 as n", "6 as f1", "7 as `a.b`")
    assert ngram_join.keep_one(d).columns == d.columns
    assert [(r.doc_id, r.id) for r in ngram_join.keep_one(d).collect()] == [(1, "y")]
    assert sorted((r.doc_id, r.component_id) for r in ngram_join.join(d).collect()) == [(1, 1), (2, 1)]


def test_bitmaps_never_say_too_little():
    r = np.random.default_rng(0)
    for _ in range(300):
        pool = r.integers(0, 2**63, 400).astype(np.uint64)
        a, b = (np.unique(r.choice(pool, r.integers(1, 400))) for _ in range(2))
        assert ngram_join.overlap_bound(ngram_join.bitmap(a), len(a), ngram_join.bitmap(b), len(b)) >= len(np.intersect1d(a, b))


def test_boundary_follows_cost():
    small, large = np.full(100, 6), np.full(100, 300)
    assert ngram_join.choose_boundary(large, 0.1) == 0
    assert ngram_join.choose_boundary(small, 5.0) >= 6 > ngram_join.choose_boundary(small, 0.0)


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_components(spark, one_task):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(500 + i, 501 + i) for i in range(60)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), one_task=one_task).collect()}
    assert all(got.get(x, x) == find(x) for x in list(root))
