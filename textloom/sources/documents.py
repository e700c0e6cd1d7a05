"""Reading documents, writing chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as X

#: Fields of a chunk, in order.
CHUNK = (
    "chunk_id chunk_type body token_count estimated_token_count headings_token_count body_token_count ancestor_headings own_heading section_level document_title document_path start_line end_line"
).split()


def read_files(spark: SparkSession, path: str | list[str], glob: str | None = None, titled: bool = False, by_suffix: bool = False) -> DataFrame:
    """Files as documents: ``content`` and ``source_path``.

    ``titled``: a file's name is its document's title. ``by_suffix``: the format is the suffix's,
    markdown for any other, without a look at the content.
    """
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    d = reader.load(path).select(F.col("path").alias("source_path"), "content")
    name = F.element_at(F.split("source_path", "/"), -1)
    if titled:
        d = d.withColumn("document_title", name)
    return d.withColumn("format", X.suffix_format(F.col("source_path"), "markdown")) if by_suffix else d


def from_texts(df: DataFrame, column: str, format: str = "auto") -> DataFrame:
    """A table's string column as documents; its other columns stay."""
    return df.withColumnRenamed(column, "text").withColumn("format", F.lit(format))


def _in_order(fields: list[str]) -> Column:
    """The chunks of a group by their number: chunk-10000 comes after chunk-9999."""
    number = F.substring_index("chunk_id", "-", -1).cast("long").alias("_n")
    return F.transform(F.array_sort(F.collect_list(F.struct(number, F.struct(*fields).alias("c")))), lambda x: x["c"])


def chunk_json(chunks: DataFrame, key: list[str]) -> DataFrame:
    """One JSON object per document: its title, number of chunks and chunks in order."""
    fields = [c for c in CHUNK if c in chunks.columns]
    per = chunks.groupBy(*key, "document_title").agg(_in_order(fields).alias("chunks"))
    return per.select(*key, F.to_json(F.struct(F.col("document_title").alias("document"), F.size("chunks").alias("chunk_count"), "chunks"), {"ignoreNullFields": "false"}).alias("json"))


def document_json(engine, docs: DataFrame, key: list[str]) -> DataFrame:
    """:func:`chunk_json` with the document's metadata and reference definitions; a document without chunks has an empty array."""
    about = engine.trees(docs).select(*[F.col(k).alias(f"_{k}") for k in key], F.col("title").alias("_title"), "metadata", "references")
    chunks = engine.split(docs)
    fields = [c for c in CHUNK if c in chunks.columns]
    per = chunks.groupBy(*key, "document_title").agg(_in_order(fields).alias("chunks"))
    same = None
    for k in key:
        same = (F.col(k).eqNullSafe(F.col(f"_{k}"))) if same is None else same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    none = F.array().cast(per.schema["chunks"].dataType)
    j = about.join(per, same, "left").withColumn("document_title", F.when(F.col("chunks").isNull(), F.col("_title")).otherwise(F.col("document_title"))).withColumn("chunks", F.coalesce("chunks", none))
    return j.select(*[F.col(f"_{k}").alias(k) for k in key], F.to_json(F.struct(F.col("document_title").alias("document"), "metadata", F.col("references").alias("reference_definitions"), F.size("chunks").alias("chunk_count"), "chunks"), {"ignoreNullFields": "false"}).alias("json"))
