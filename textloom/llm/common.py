"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.shipping import ship

#: Characters that separate words, everywhere in this subpackage: space and U+0009..U+000D.
BLANKS = " \t\n\x0b\f\r"
#: The same as a Java/Python regular expression class.
BLANK_CLASS = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is read from ``spark.checkpoint.dir``; only where that is unset (single-machine tests)
    does the session get a temporary folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jsc.get() if jsc.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder there that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage with a replicated/shared copy: a lost executor costs a reread, not a
    recomputation, and the plan that follows starts from a scan with known sizes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textloom-{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`cut`; it must not be read afterwards."""
    spark = df.sparkSession
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if "/textloom-" in f:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def settings(spark: SparkSession, **values: object) -> Iterator[None]:
    """Session settings (two underscores for a dot) that hold for the queries run inside, then go back."""
    names = {k.replace("__", "."): str(v) for k, v in values.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Rows of an Arrow batch where a row is a whole text or more: bounds a worker's memory.
SMALL_BATCHES = {"spark__sql__execution__arrow__maxRecordsPerBatch": 1000}


def carried(docs: DataFrame, *added: str, without: tuple[str, ...] = ()) -> dict[str, str]:
    """Old and new names of the columns that an operator passes through beside the columns ``added``.

    A column of an added one's name (whatever its case) is kept as ``<name>_input``, so nothing is lost and names stay distinct.
    """
    taken, names = {x.lower() for x in (*added, *docs.columns)}, {}
    for c in docs.columns:
        if c not in without:
            names[c] = c
            if c.lower() in {x.lower() for x in added}:
                while names[c].lower() in taken:
                    names[c] += "_input"
                taken.add(names[c].lower())
    return names


def unpacked(names: dict[str, str], row: str = "row") -> list[Column]:
    """The columns of :func:`carried` from the packed input row."""
    return [F.col(f"{row}.`{old}`").alias(new) for old, new in names.items()]


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null or blank texts give an empty array."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, BLANK_CLASS + "+"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
