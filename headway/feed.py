"""A feed, or many: named tables, each row with its feed_id."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .schema import TABLES


@dataclass
class Feed:
    """tables by name; status has (feed_id, table, status, columns) where feeds were read from files."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    status: DataFrame | None = None

    def __contains__(self, name: str) -> bool:
        return name in self.tables

    def has(self, table: str, *columns: str) -> bool:
        """Whether the table is there and declares all the columns."""
        return table in self.tables and set(columns) <= set(self.tables[table].columns)

    def declares(self, table: str, *columns: str) -> Column:
        """A condition on rows of the table: that their feed's file has one of the columns in its header.

        Tables read from files carry that in each row, as bits (_declared); others have a column or not.
        """
        if table not in self.tables or "_declared" not in self.tables[table].columns:
            return F.lit(any(self.has(table, c) for c in columns))
        names = TABLES[table].names
        return F.col("_declared").bitwiseAND(F.lit(sum(1 << names.index(c) for c in set(columns)))) != 0

    def declaring(self, table: str, column: str) -> DataFrame:
        """feed_id of feeds whose file has the column in its header, even without rows."""
        if self.status is not None:
            return self.status.where((F.col("table") == table) & F.array_contains("columns", column)).select("feed_id").distinct()
        own = self[table]
        return own.where(self.declares(table, column)).select("feed_id").distinct()

    def having(self, table: str) -> DataFrame:
        """feed_id of feeds that have the table's file, even without rows; of feeds that aren't from files, those with rows."""
        if self.status is not None:
            return self.status.where((F.col("table") == table) & (F.col("status") != "MISSING_FILE")).select("feed_id").distinct()
        return self[table].select("feed_id").distinct()

    def __getitem__(self, name: str) -> DataFrame:
        """The table with every column of its schema; those it lacks are null, and a missing table has no rows."""
        schema = TABLES[name].struct()
        if name not in self.tables:
            return self.spark.createDataFrame([], schema)
        df = self.tables[name]
        return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in df.columns})

    def unclean(self) -> DataFrame:
        """(feed_id, table) of tables that did not load cleanly; one that is missing counts if it is required."""
        required = [t.name for t in TABLES.values() if t.presence == "required"]
        fine = F.col("status").isin("PARSABLE", "EMPTY_FILE") | (F.col("status") == "MISSING_FILE") & ~F.col("table").isin(required)
        return self.status.where(~fine).select("feed_id", "table")

    def gated(self, needs: Iterable[str]) -> Feed:
        """Only feeds whose tables named in needs loaded cleanly; a missing table passes unless it is required."""
        needs = list(needs)
        if self.status is None or not needs:
            return self
        bad = self.unclean().where(F.col("table").isin(needs)).select("feed_id").distinct()
        return Feed(self.spark, {k: df.join(bad, "feed_id", "left_anti") if k in needs else df for k, df in self.tables.items()}, self.status)

    @classmethod
    def load(cls, spark: SparkSession, path: str, names: Iterable[str] = TABLES) -> Feed:
        """Typed tables stored by sources.parquet.write_typed_tables, with their status if load_raw stored one."""
        from .sources.parquet import read_typed_tables

        return read_typed_tables(spark, path, names)

    @classmethod
    def load_raw(cls, spark: SparkSession, glob: str, path: str) -> tuple[Feed, DataFrame]:
        """Feeds from zip archives that glob names: the typed feed, with status, and notices on files and cells; stored below path."""
        from .sources.files import unpack_archives
        from .sources.raw import load_lines

        return load_lines(unpack_archives(spark, glob), path)


def group_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy("feed_id", *keys).agg(F.count(F.lit(1)).alias("n_rows"))


def rows_any_set(df: DataFrame, *columns: str) -> DataFrame:
    return df.where(F.coalesce(*(F.col(c).cast("string") for c in columns)).isNotNull())


def rows_all_null(df: DataFrame, *columns: str) -> DataFrame:
    return df.where(F.coalesce(*(F.col(c).cast("string") for c in columns)).isNull())


def row_at_max(df: DataFrame, key: str, by: Column, pick: list[str]) -> DataFrame:
    """For each key the columns of its row with the largest by (ties: the first row)."""
    best = F.max_by(F.struct(*pick), F.struct(by, -F.col("_row_number"))).alias("_best")
    return df.groupBy("feed_id", key).agg(best).select("feed_id", key, "_best.*")


def distinct_in_order(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct values with the row where each stands first."""
    return df.groupBy("feed_id", *columns).agg(F.min("_row_number").alias("_row_number"))


def missing_reference(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows of child with a value that parent lacks."""
    known = parent.select("feed_id", F.col(parent_column).alias(column)).where(F.col(column).isNotNull()).distinct()
    return child.where(F.col(column).isNotNull()).join(known, ["feed_id", column], "left_anti")


def first_rows(df: DataFrame, *keys: str) -> DataFrame:
    """The first row of each key."""
    order = W.partitionBy("feed_id", *keys).orderBy("_row_number")
    return df.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
