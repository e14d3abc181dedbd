"""Helpers shared by the training-data operators: tables, scratch storage, binding of sub-expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in every operator here: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[ \x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark so that any store Spark knows can hold it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; one of our own only where none is set and all runs in one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.sparkContext.setCheckpointDir(root)
    return root


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    This cuts the lineage: whatever follows restarts from files that every executor sees, so a lost
    executor costs a re-read. Column pruning then applies to the stored table. The file system deletes
    the folder when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Deletes the files of a table that ``written`` made and nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def text_id(name: str) -> Column:
    """An id column as text. Pandas turns a batch of numbers that holds a null into floats, which lose digits over 2^53."""
    return F.col(f"`{name}`").cast("long").cast("string").alias(name)


def long_id(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a ``text_id`` turned back."""
    return df.withColumn(name, F.col(name).cast("long"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for a row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def split_words(text: Column) -> Column:
    """``[^\\x20\\x09-\\x0D]+`` of ``text`` as an array; null text has no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; all other characters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
