"""``python -m textloom.cli INPUT OUT``: split files into chunks."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textloom.options import FORMATS, SplitOptions, from_short
from textloom.plans.engine import ChunkEngine
from textloom.sources import documents


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textloom", description="Split Markdown, HTML and Word files into chunks.")
    p.add_argument("input", help="a path or glob that Spark can read")
    p.add_argument("output", help="folder for the result")
    p.add_argument("--input-format", default="auto", choices=FORMATS)
    p.add_argument("--output-format", default="json", choices=("json", "parquet"))
    p.add_argument("--splitter", default="section")
    p.add_argument("--tokenizer", default="approx")
    p.add_argument("--tokenizer-arg", action="append", default=[])
    p.add_argument("--max-tokens", type=int, default=1200)
    p.add_argument("--ideal-max-tokens-ratio", type=float, default=0.8)
    p.add_argument("--merge-below-ratio", type=float, default=0.125)
    p.add_argument("--max-heading-level", type=int)
    p.add_argument("--heading-sensitive", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--block-config", action="append", default=[], metavar="KIND[:isolated][:nosplit][:TOKENS]")
    p.add_argument("--block-config-json", default="")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    options = SplitOptions.named(
        a.splitter, max_tokens=a.max_tokens, ideal_ratio=a.ideal_max_tokens_ratio, merge_below_ratio=a.merge_below_ratio, max_heading_level=a.max_heading_level,
        heading_sensitive=a.heading_sensitive, blocks=tuple(from_short(a.block_config, a.block_config_json)),
    )
    spark = SparkSession.builder.appName("textloom").getOrCreate()
    docs = documents.read_files(spark, a.input, by_suffix=a.input_format == "auto")
    if a.input_format != "auto":
        docs = docs.withColumn("format", F.lit(a.input_format))
    engine = ChunkEngine(options, (a.tokenizer, *a.tokenizer_arg))
    docs = docs.withColumn("file", F.col("source_path"))
    if a.output_format == "json":
        documents.document_json(engine, docs, ["file"]).select("json").write.mode("overwrite").text(a.output)
    else:
        engine.split(docs).write.mode("overwrite").parquet(a.output)
    print(f"Wrote chunks to {a.output}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
