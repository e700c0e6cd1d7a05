"""The driver's contract: names, SQL, and independence of the optional subpackage."""

import importlib
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

SF = Path("/root/testdata/sf0.001")


def test_registry():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 20 and next(iter(q)) == "chunk_documents"


def test_nothing_else_imports_the_optional_subpackage():
    top = Path(__spark_entry__.__file__).parent / "textloom"
    for p in top.rglob("*.py"):
        if "llm" not in p.relative_to(top).parts:
            assert "textloom.llm" not in p.read_text() and "from .llm" not in p.read_text(), p


def test_registry_without_the_optional_subpackage(monkeypatch):
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n.startswith(("textloom.llm", "corpus_pipeline")) else real(n, *a))
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    fresh = importlib.import_module("__spark_entry__")
    assert not any(k.startswith("op") or k == "pipeline" for k in fresh.queries()) and "chunk_documents" in fresh.queries()


@pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")
def test_queries_equal_their_sql(spark):
    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    q = {k: f for k, f in __spark_entry__.queries().items() if not k.startswith("op") and k != "pipeline"}
    for name, sql in __spark_entry__.oracle_sql().items():
        if name in q:
            df, want = q[name](spark, str(SF)), c.sql(sql)
            cols = sorted(df.columns)
            assert sorted(want.columns) == cols, name
            at = [want.columns.index(x) for x in cols]
            assert sorted(repr(tuple(r[x] for x in cols)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall()), name
