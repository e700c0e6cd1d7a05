"""Exact top-k inner-product search by Fagin's threshold algorithm, in blocks.

Components are quantized to integers, so scores are exact. Vectors are dealt into blocks; within a block each dimension
has its list of vectors, sorted by component. A query walks all its dimensions' lists at once, from the end that its
own component's sign makes best, scores what it meets by random access, and stops when the bound (the
score that a vector at the current depth in every list would have) is below its k-th best score; at an equal bound it goes on, since a smaller id may still tie.
Depth doubles, and the bound is tested at every depth; there is no other way out but that every vector has been met.

A block of vectors is one group: its lists are sorted once, and all queries stream past them in Arrow batches. Nothing is
broadcast, a task's memory is bounded by one block of vectors and one batch of queries, a query is sent once for each block, a vector once. The partial
results (k for each query and block of vectors) are merged by query.

Defined results: vectors that are null or hold a null or non-finite component take no part, as queries or candidates; an
empty vector scores 0 with all; of vectors of different lengths the common leading components count; a row whose vec_id is
the query's own is no candidate; repeated rows are candidates one by one, a repeated query is answered once (by its smallest vector); a null vec_id takes no part;
extra columns are ignored; fewer candidates than k give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 5
SCALE = 256
VECTOR_BLOCK = 16384
#: Depth of the first test of the bound.
START = 16


def quantize(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, x as double; null where the vector takes no part."""
    good = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(embedding.isNotNull() & good, F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column, padded with zeros, or cut, to ``dims``."""
    sizes = np.diff(col.offsets.to_numpy())
    values = col.values.slice(col.offsets[0].as_py(), int(sizes.sum())).to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return values.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    at = 0
    for i, n in enumerate(sizes):
        out[i, : min(n, dims)] = values[at : at + min(n, dims)]
        at += n
    return out


class Block:
    """The sorted lists of a block of vectors; ``met`` and ``stopped`` count vectors scored and searches that the bound ended."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        o = np.argsort(ids, kind="stable")
        self.ids, self.v = ids[o], vectors[o]
        self.most = float(np.abs(self.v).max(initial=0))
        self.f = self.v.astype(np.float64)  # products of doubles are fast, and exact below 2**53
        #: ``order[d]``: the rows by rising component d; ``ranked[d]``: those components.
        self.order = np.ascontiguousarray(np.argsort(self.v, axis=0, kind="stable").T)
        self.ranked = np.take_along_axis(self.v.T, self.order, axis=1)
        self.met = self.stopped = 0

    def search(self, q: np.ndarray, own: int, k: int = K) -> list[tuple[int, int]]:
        """The k best (score, id) of one query, best first, ties by id."""
        n, v = len(self.ids), self.f if len(q) * self.most * float(np.abs(q).max(initial=0)) < 2**53 else self.v
        q = q.astype(v.dtype)
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        seen = self.ids == own
        left = n - int(seen.sum())
        best_s, best_r = np.empty(0, v.dtype), np.empty(0, np.int64)
        depth = 0
        while left:
            to = min(n, max(START, depth * 2))
            met = np.zeros(n, bool)
            met[self.order[up, n - to : n - depth].ravel()] = True
            met[self.order[down, depth:to].ravel()] = True
            if to == n:  # the lists' ends; a query of zeros has no list
                met[:] = True
            rows = np.flatnonzero(met & ~seen)
            seen[rows] = True
            left -= len(rows)
            self.met += len(rows)
            s = v[rows] @ q
            if len(best_s) == k:
                good = s >= best_s[-1]
                s, rows = s[good], rows[good]
            elif len(s) > 4 * k:
                good = s >= np.partition(s, len(s) - k)[len(s) - k]
                s, rows = s[good], rows[good]
            s, rows = np.concatenate([best_s, s]), np.concatenate([best_r, rows])
            top = np.lexsort((rows, -s))[:k]
            best_s, best_r, depth = s[top], rows[top], to
            if left and len(best_s) == k and q[up] @ self.ranked[up, n - depth] + q[down] @ self.ranked[down, depth - 1] < best_s[-1]:
                self.stopped += 1
                break
        return [(int(s), int(self.ids[r])) for s, r in zip(best_s, best_r, strict=True)]


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (b, kind, vec_id, q), sorted so that a block's vectors (kind 0) come before its queries (kind 1)."""
    now, kept, block = None, [], None
    for b in batches:
        at, kinds = b.column("b").to_numpy(), b.column("kind").to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(at) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(at)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if x == y:
                continue
            part = b.slice(x, y - x)
            if at[x] != now:
                now, kept, block = at[x], [], None
            if kinds[x] == 0:
                kept.append(part)
                continue
            if not kept:
                continue
            if block is None:
                dims = max(int(np.diff(p.column("q").offsets.to_numpy()).max()) for p in kept)
                block = Block(np.concatenate([p.column("vec_id").to_numpy() for p in kept]), np.concatenate([_matrix(p.column("q"), dims) for p in kept]))
            out: tuple[list, list, list] = ([], [], [])
            own = part.column("vec_id").to_pylist()
            for i, q in zip(own, _matrix(part.column("q"), block.v.shape[1]), strict=True):
                for s, r in block.search(q, i, k):
                    for column, value in zip(out, (i, r, s), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])


def search(vectors: DataFrame, is_query: Column, k: int = K, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best of all rows for each row where ``is_query`` holds.

    ``vectors`` has ``vec_id`` and ``embedding``.
    """
    v = vectors.select("vec_id", quantize(F.col("embedding")).alias("q")).where("q is not null and vec_id is not null")
    q = v.where(is_query).groupBy("vec_id").agg(F.min("q").alias("q"))
    blocks = max(1, -(-vectors.select("vec_id").count() // vector_block))
    # repeated ids are dealt by their row as well
    v = v.select(F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("b"), F.lit(0).alias("kind"), "vec_id", "q")
    q = q.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.lit(1).alias("kind"), "vec_id", "q")
    rows = v.unionByName(q).repartition(4 * blocks, "b").sortWithinPartitions("b", "kind")
    parts = rows.mapInArrow(lambda x: _search(x, k), "query_id long, vec_id long, score long")
    best = parts.withColumn("rank", F.expr("cast(row_number() over (partition by query_id order by score desc, vec_id) as int)"))
    return best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
