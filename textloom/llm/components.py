"""Connected components of an edge table.

Every partition first shrinks its own edges to a forest. A small table (``ONE_TASK`` edges at most, counted before) is then
finished by union-find in one task of bounded memory; a larger one by alternating large-star and small-star steps, each an
aggregation with partial minima and a join, whatever the degree of a node. Both give the same rows; nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut


#: Edges that one task may hold: some tens of MB.
ONE_TASK = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of a partition: (node, smallest of its component here)."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while x != top:
            root[x], x = top, root.get(x, x)
        return top

    def flush() -> pa.RecordBatch:
        pairs = [(x, find(x)) for x in list(root)]
        root.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs if p[0] != p[1]], pa.int64()) for k in (0, 1)], names=["u", "v"])

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = find(u), find(v)
            if x != y:
                root[max(x, y)] = min(x, y)
                root.setdefault(min(x, y), min(x, y))
        if len(root) > 2 * ONE_TASK:
            yield flush()
    yield flush()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with u > v to edges (u, v) with u > v."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(low, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """``node, root`` for every node that is not its own root; the root is the component's smallest node."""
    schema = "u long, v long"
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").mapInArrow(_forest, schema), "edges")
    if e.count() <= one_task:
        return cut(e.coalesce(1).mapInArrow(_forest, schema).select(F.col("u").alias("node"), F.col("v").alias("root")), "roots")
    e, seen = e.distinct(), None
    for _ in range(max_rounds):
        n = cut(_star(_star(e, True), False), "edges")
        now = n.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first()
        e = n
        if tuple(now) == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(now)
    raise RuntimeError("components did not settle")
