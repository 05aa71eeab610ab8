"""The folder that driver and executors share, and tables kept in it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows of a bucket of a clustered table, about.
BUCKET_ROWS = 2_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset a temporary folder serves, but only in local mode (one machine); on a
    cluster its absence is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="headway-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """df, checkpointed in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again, where several plans read it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Deletes the files of frames that `written` gave, once nothing reads them any more."""
    for df in frames:
        spark = df.sparkSession
        for path in {file.rpartition("/")[0] for file in df.inputFiles()}:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, a written or counted frame's shuffle files go as soon as that is done; else they stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


@contextmanager
def clustered(df: DataFrame, by: list[str], order: list[str], path: str) -> Iterator[DataFrame]:
    """df as a table bucketed by some columns and sorted within buckets, below path; the table's name goes at the end, its files stay.

    Spark knows how such a table is dealt, so what groups, ranks or joins by these columns (or more) reads it without a
    shuffle. Each bucket is one file, written by one task; their number follows the rows.
    """
    spark = df.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // BUCKET_ROWS))
    name = f"clustered_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *by)
    dealt.write.bucketBy(buckets, *by).sortBy(*order).option("path", f"{path}/{name}").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
