"""Quality classifier: a linear SVM over n-gram indicators scaled by naive Bayes log-count ratios.

Tokens are runs of word characters or of other marks; indicators are token n-grams (1 and 2), shapes of
tokens (1 and 2, with a mark for a token that repeats its predecessor) and the logarithm of the
number of tokens. An indicator's value is its class log-count ratio; a document's vector has length 1. The
weights come from dual coordinate descent on the hinge loss.

The fit takes a bounded sample of labelled rows, ``SAMPLE_ROWS``, chosen by a hash of doc_id; the
sample's labels are therefore safe to broadcast, and only the sample's feature lists reach the driver. Every document
is then scored in one pass without a shuffle.

Defined results: a null text counts as empty and gets the score of a document without tokens;
repeated rows are scored one by one, and fitted on once (by the smallest text); rows with a null doc_id are held in, never fitted on; labels that are null
or not 0/1 are ignored; without both classes among the labels every score is the share of label 1 (0.5
without any); extra columns are ignored; an empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 8000
BITS = 18
FOLDS, HELD_OUT = 3, 1

_TOKENS = re.compile(r"\w+|[^\w\s]+").findall
_MEMO_ENTRIES = 400_000


def _shape(token: str) -> str:
    if token.isalpha():
        return "A" if token.isupper() and len(token) > 1 else "T" if token[0].isupper() else "a"
    return "9" if token.isdigit() else "x" if token[0].isalnum() else "p" + token[:2]


class _Memo(dict):
    """token -> its hash in the high and its shape's hash in the low 32 bits."""

    def __missing__(self, token: str) -> int:
        v = zlib.crc32(token.encode()) << 32 | zlib.crc32(_shape(token).encode())
        if len(self) >= _MEMO_ENTRIES:
            self.clear()
        if len(token) <= 40:
            self[token] = v
        return v


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int32)


def indicators(text: str, memo: _Memo) -> np.ndarray:
    """Sorted distinct indicator numbers of a text, each below 2**BITS."""
    tokens = _TOKENS(text)
    n = len(tokens)
    with np.errstate(over="ignore"):
        size = _mix(np.array([7 + int(math.log2(n + 1) * 2)], np.uint64))
        if not n:
            return size
        v = np.fromiter(map(memo.__getitem__, tokens), np.uint64, n)
        word, shape = v >> np.uint64(32), v & np.uint64(0xFFFFFFFF)
        same = np.zeros(n, np.uint64)
        same[1:] = word[1:] == word[:-1]
        shape = np.unique(np.concatenate([shape * np.uint64(8) + same * np.uint64(2) + np.uint64(1), (shape[:-1] * np.uint64(0x85EBCA6B) + shape[1:]) * np.uint64(8) + np.uint64(5)]))
        pairs = word[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + word[1:] * np.uint64(8) + np.uint64(6)
        return np.unique(np.concatenate([_mix(word * np.uint64(8)), _mix(pairs), _mix(shape), size]))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # SVM weight times log-count ratio, for each indicator
    ratios: np.ndarray
    bias: float
    constant: float | None = None

    def score(self, idx: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        norm = math.sqrt(float((self.ratios[idx] ** 2).sum())) or 1.0
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, 4 * (float(self.weights[idx].sum()) / norm + self.bias)))))


def fit(rows: list[np.ndarray], labels: np.ndarray, c: float = 1.0, epochs: int = 20, alpha: float = 1.0, seed: int = 0) -> Model:
    """Log-count ratios, then dual coordinate descent for the L1-loss linear SVM."""
    y = np.where(labels == 1, 1.0, -1.0)
    zero = np.zeros(1 << BITS, np.float32)
    if len(set(y)) < 2:
        return Model(zero, zero, 0.0, float((y > 0).mean()) if len(y) else 0.5)
    counts = {s: np.full(1 << BITS, alpha) for s in (1.0, -1.0)}
    for s in counts:
        chosen = [r for r, t in zip(rows, y, strict=True) if t == s]
        counts[s] += np.bincount(np.concatenate(chosen), minlength=1 << BITS)
    ratio = np.log(counts[1.0] / counts[1.0].sum()) - np.log(counts[-1.0] / counts[-1.0].sum())
    ratio[(counts[1.0] + counts[-1.0]) <= 2 * alpha] = 0.0  # never seen
    x = [(v := ratio[r]) / (np.sqrt((v * v).sum()) or 1.0) for r in rows]
    cost = np.where(y > 0, c * len(y) / (2 * (y > 0).sum()), c * len(y) / (2 * (y < 0).sum()))
    w, b, a = np.zeros(1 << BITS), 0.0, np.zeros(len(y))
    q = np.array([float(v @ v) + 1 for v in x])
    order, rng = np.arange(len(y)), np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        moved = 0.0
        for i in order:
            g = y[i] * (w[rows[i]] @ x[i] + b) - 1
            new = min(max(a[i] - g / q[i], 0.0), cost[i])
            if (d := new - a[i]) != 0.0:
                w[rows[i]] += d * y[i] * x[i]
                b += d * y[i]
                a[i], moved = new, max(moved, abs(d))
        if moved < 1e-4:
            break
    return Model((w * ratio).astype(np.float32), ratio.astype(np.float32), b)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model:
    chosen = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col(label).cast("int").alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "_label").limit(sample_rows)  # the bound that makes the broadcast safe
    found = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("_text")).join(F.broadcast(chosen), "doc_id")
    found = found.groupBy("doc_id", "_label").agg(F.min("_text").alias("_text")).select("doc_id", "_text", "_label")  # a repeated id counts once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo()
        for b in batches:
            idx = [indicators(t.as_py() or "", memo).astype(np.int32).tobytes() for t in b.column("_text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_label"), pa.array(idx, pa.binary())], names=["doc_id", "_label", "idx"])

    got = found.mapInArrow(run, "doc_id long, _label int, idx binary").toArrow().sort_by([("doc_id", "ascending"), ("_label", "ascending"), ("idx", "ascending")])
    return fit([np.frombuffer(x.as_py(), np.int32) for x in got["idx"]], got["_label"].to_numpy())


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two arrays of 2**BITS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, m = _Memo(), shared.value
        for b in batches:
            s = np.array([m.score(indicators(t.as_py() or "", memo)) for t in b.column("_text")], np.float64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), F.col(text).alias("_text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
