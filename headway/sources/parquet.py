"""Typed tables as Parquet: type once, check often."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..feed import Feed
from ..schema import TABLES

#: Tables whose rows are dealt by a second key, so that a large feed has several files.
DEALT = {"stop_times": "trip_id", "shapes": "shape_id", "trips": "trip_id"}
SALTS = 16


def write_typed_tables(feed: Feed, path: str, mode: str = "error") -> None:
    """Each table below path/<table>/feed_id=...; a large table's feed is dealt into at most SALTS files."""
    for name, df in feed.tables.items():
        salt = F.pmod(F.xxhash64(DEALT[name]), F.lit(SALTS)) if name in DEALT else F.lit(0)
        df.repartition("feed_id", salt).write.mode(mode).partitionBy("feed_id").parquet(f"{path}/{name}")


def read_typed_tables(spark: SparkSession, path: str, names: Iterable[str] = TABLES) -> Feed:
    """The tables that are there, with their declared types, and their status; filters on feed_id prune folders."""
    from pyspark.errors import AnalysisException

    tables = {}
    for name in names:
        try:
            found = spark.read.parquet(f"{path}/{name}")
        except AnalysisException:  # not there
            continue
        types = {f.name: f.dataType for f in TABLES[name].struct()}
        tables[name] = found.select(*(F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in found.columns))
    try:
        status = spark.read.parquet(f"{path}/status")
    except AnalysisException:  # tables that don't come from files
        status = None
    return Feed(spark, tables, status)
