"""Shared helpers: table loading, the scratch folder and exact word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: A word is a longest run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Sides of a join are broadcast only when they are known to be below this many rows.
BROADCAST_ROWS = 200_000

#: Rows of a record batch that a task turns into Python objects together.
SLICE_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only, so that every engine and locale agrees."""
    return F.translate(c, UPPER, LOWER)


def text_or_empty(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column], F.lit(""))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the session names none, a local master gets a temporary folder and
    any other master a folder in the warehouse, which all executors share.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] == "local":
        named = tempfile.mkdtemp(prefix="scratch-")
    else:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This ends the lineage: a lost executor costs a re-read of the table and
    not another run of the stages before it.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The record batches in pieces of SLICE_ROWS rows, so that what a task makes of texts stands for few of them at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def sized(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` written down and counted: for broadcast if it is small, as it is otherwise."""
    out = cut(df)
    n = out.count()
    return (F.broadcast(out) if n <= BROADCAST_ROWS else out), n


def drop_cut(df: DataFrame) -> None:
    """Delete a table written by :func:`cut` once nothing reads it any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
