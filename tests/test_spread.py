"""Documents made of narrow tables are dealt to tasks, and a batch is parsed in pieces of bounded size."""

import pyarrow as pa
import pytest

import __spark_entry__
from textloom.plans.engine import SLICE_BYTES, SLICE_ROWS, _slices

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", "inline_nodes html_blocks markdown_blocks word_blocks child_blocks front_matter merged_tails merged_tails_incremental".split())
def test_rows_are_dealt_before_they_are_parsed(spark, name):
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan and plan.index("RoundRobinPartitioning") > plan.index("MapInArrow")


def test_slices_hold_all_rows_within_their_bounds():
    texts = ["x" * n for n in [0, 3, SLICE_BYTES + 1, 5] + [SLICE_BYTES // 3] * 7 + [1] * (2 * SLICE_ROWS + 1)] + [None]
    b = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([None] * len(texts), pa.binary())], names=["text", "content"])
    parts = list(_slices(b, ("text", "content")))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts
    assert all(p.num_rows == 1 or p.num_rows <= SLICE_ROWS and sum(len(t or "") for t in p.column(0).to_pylist()) <= SLICE_BYTES for p in parts)
    assert [p.num_rows for p in _slices(b.slice(0, 0), ("text", "content"))] == [0]
