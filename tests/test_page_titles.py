"""Titles of pages, against the query's SQL, with references that a cut has left open."""

import duckdb

import __spark_entry__
from textloom.operators import html

TITLES = ["a &amp;&amp", "cut &am", "x &lt;b&gt; &quot;q&quot; &lt", "two\n  lines &amp", "&amp;lt; &ampx;", "plain"]


def test_open_references_stay(spark, tmp_path):
    rows = [(i, "http://x", f"<!DOCTYPE html>\n<html><head>\u2028\r<title>{t}</title></head><body><h1>no</h1></body></html>") for i, t in enumerate(TITLES)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = {tuple(r) for r in __spark_entry__.queries()["page_titles"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.sql(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == set(c.sql(__spark_entry__.oracle_sql()["page_titles"]).fetchall())


def test_closed():
    assert html.parse("<title>a&amp</title>").title == "a&" and html.parse("<title>a&amp</title>", closed=True).title == "a&amp"
    assert html.parse("\n<title >&#65;&#x42; &copy &copy;</title>", closed=True).title == "AB &copy ©"
