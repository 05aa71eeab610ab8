"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a lookup table up to which it is broadcast; beyond, a shuffled join does the same.
BROADCAST_ROWS = 20_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset a temporary folder serves, but only in local mode (one machine); on a
    cluster its absence is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="headway-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and stored in the shared folder, so lost executors lose nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as Parquet to a new path in the shared folder, and that path."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, *paths: str) -> None:
    """Deletes paths that scratch_path or stored gave, once nothing reads them any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def joined(df: DataFrame, table: DataFrame, on, how: str = "left") -> DataFrame:
    """df joined to a lookup table that must be cheap to count (a checkpoint, an aggregate of one).

    Broadcast while the table has at most BROADCAST_ROWS rows; beyond that a shuffled join,
    whose hot keys Spark splits at run time.
    """
    return df.join(F.broadcast(table) if table.count() <= BROADCAST_ROWS else table, on, how)


def fraction(seed: int, *columns) -> Column:
    """A hash of the columns as a number from 0 to below 1; a share s of rows lies below s, however small s is."""
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 11) / float(1 << 53)


def sampled(df: DataFrame, rows: float, total: int, seed: int, *columns) -> DataFrame:
    """About `rows` of df's `total` rows, picked by a hash of the columns; all where there are no more."""
    return df if total <= rows else df.where(fraction(seed, *columns) < rows / total)


def ascii_lower(c: Column) -> Column:
    """c with A-Z lower-cased and every other character as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_of(name: str = "text") -> Column:
    """The text column, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


def crc32_mod(id_col: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo modulus; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus
