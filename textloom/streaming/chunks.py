"""Splitting a stream of documents: the batch plan, as it has no shuffle and no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from textloom.plans.engine import ChunkEngine


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_chunks(engine: ChunkEngine, docs: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append chunks as Parquet; exactly once, by the sink's own log."""
    w = engine.split(docs).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()
