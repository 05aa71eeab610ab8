"""Notices: what checks return, and reports over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEVERITIES = ("INFO", "WARNING", "ERROR")
COLUMNS = ("feed_id", "code", "severity", "filename", "row_number", "context")
MAX_SAMPLES = 1000


def context_of(context: dict[str, Column | str]) -> Column:
    """A map of the non-null values as text; a string names a column."""
    if not context:
        return F.map_filter(F.create_map(F.lit("_"), F.lit(None).cast("string")), lambda k, v: v.isNotNull())
    pairs = [x for k, v in context.items() for x in (F.lit(k), (F.col(v) if isinstance(v, str) else v).cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def notices(df: DataFrame, code: str | Column, severity: str, filename: str, row: str | Column | None = "_row_number", **context: Column | str) -> DataFrame:
    """A notice for each row of df, which has feed_id."""
    number = F.lit(None) if row is None else F.col(row) if isinstance(row, str) else row
    return df.select(
        "feed_id", (F.lit(code) if isinstance(code, str) else code).alias("code"), F.lit(severity).alias("severity"), F.lit(filename).alias("filename"),
        number.cast("long").alias("row_number"), context_of(context).alias("context"),
    )


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def context_text(df: DataFrame) -> DataFrame:
    """Notices with the context written as name=value;name=value."""
    text = F.array_join(F.transform(F.map_entries("context"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return df.withColumn("context", text)


def ordinal(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)


def report(found: DataFrame, max_samples: int = MAX_SAMPLES) -> DataFrame:
    """For each feed, code and severity: totalNotices and at most max_samples contexts, first rows first.

    Counts come from one aggregate; the samples are picked by rank, which Spark limits before the
    shuffle, so a code with most of the notices costs no more than its samples.
    """
    keys = ["feed_id", "code", "severity"]
    order = W.partitionBy(*keys).orderBy("filename", "row_number", F.to_json("context"))
    picked = found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= max_samples)
    listed = F.array_sort(F.collect_list(F.struct("_rank", F.map_entries("context").alias("entries"))))
    samples = picked.groupBy(*keys).agg(F.transform(listed, lambda s: F.map_from_entries(s["entries"])).alias("sampleNotices"))
    totals = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("totalNotices"))
    return totals.join(samples, keys).orderBy("feed_id", "code", ordinal(F.col("severity")))


def severity_totals(found: DataFrame) -> DataFrame:
    """Counts by severity and code, with subtotals (null code) and the total (both null)."""
    return found.rollup("severity", "code").agg(F.count(F.lit(1)).alias("n_notices"))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Codes whose counts differ between two runs, with counts and the notices that one run alone has.

    Equal notices are counted for both runs at once, so each run is made once and its notices are shuffled once.
    """
    keys = ["feed_id", "code"]
    flat = [context_text(df).select(*keys, "severity", "filename", "row_number", "context", F.lit(by).alias("by")) for df, by in ((before, 1), (after, -1))]
    each = union(flat).groupBy(*keys, "severity", "filename", "row_number", "context").agg(F.count_if(F.col("by") > 0).alias("b"), F.count_if(F.col("by") < 0).alias("a"))
    more = lambda x, y: F.sum(F.greatest(F.col(x) - F.col(y), F.lit(0)))
    out = each.groupBy(*keys).agg(F.sum("b").alias("n_before"), F.sum("a").alias("n_after"), more("b", "a").alias("only_before"), more("a", "b").alias("only_after"))
    return out.where("n_before <> n_after or only_before > 0 or only_after > 0")
