"""Python hands on the results of a slice before it parses the next one, however large a batch comes in."""

import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_schema

from textloom.options import SplitOptions
from textloom.plans.engine import SLICE_ROWS, ChunkEngine

N = 1000


@pytest.mark.parametrize("what", ["drafts", "trees"])
def test_results_leave_slice_by_slice(spark, monkeypatch, what):
    docs = spark.createDataFrame([(0, "", "html")], "page_id long, text string, format string")
    caught = {}
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: caught.update(run=run, schema=to_arrow_schema(self.schema)) or self)
    parsed = []

    def page(text, title, metadata):
        from textloom.operators import html

        parsed.append(text)
        return html.parse(text, title, metadata)

    getattr(ChunkEngine(SplitOptions("sibling", max_tokens=256), parsers={"html": page}), what)(docs)
    rows = [{"page_id": i, "text": f"<body><h1>t {i}</h1><p>x</p>", "format": "html"} for i in range(N)]
    batch = pa.RecordBatch.from_pylist(rows, caught["schema"])
    ids, ahead = [], 0
    for out in caught["run"](iter([batch])):
        ids += out.column("page_id").to_pylist()
        ahead = max(ahead, len(parsed) - len(ids) + out.num_rows)
    assert ids == list(range(N)) and len(parsed) == N
    assert ahead <= SLICE_ROWS
