"""From archives to checked tables: lines, cells, types, zones, and what became of each table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..feed import Feed
from ..notices import COLUMNS, union
from ..operators.typing import failed_feeds, type_table
from ..operators.zones import zone_structure
from ..schema import TABLES
from .csvrows import headers_of, raw_table, records, split_records
from .files import file_presence, header_checks, row_shape, table_status, zone_texts, zones_of
from .parquet import read_typed_tables, write_typed_tables


def listing_of(lines: DataFrame) -> DataFrame:
    """feed_id, filename, size in characters: a row for each file; an empty file is a line without a value."""
    size = F.coalesce(F.sum(F.length("value") + 1), F.lit(0))
    return lines.groupBy("feed_id", "filename").agg(size.alias("size"))


def load_lines(lines: DataFrame, path: str) -> tuple[Feed, DataFrame]:
    """lines (feed_id, filename, line_number, value) -> the typed feed and the notices of its files and cells.

    Lines, rows, typed tables, their status and the notices are stored below path, each once, so
    nothing is parsed twice. Tables that lost rows keep the rest and carry it in their status, by
    which checks leave feeds out. Of a table whose header has an error no row is read. Zones whose
    file has an error are left out. Each row carries which fields its file's header has.
    """
    spark = lines.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    lines = stored(lines, "lines")
    found = records(lines)
    headers = stored(headers_of(found), "headers")
    listing = listing_of(lines)
    told = stored(header_checks(headers), "header-notices")
    broken = told.where("severity = 'ERROR'").select("feed_id", F.regexp_replace("filename", "\\.txt$", "").alias("table")).distinct()
    rows = stored(split_records(found, headers).join(broken, ["feed_id", "table"], "left_anti"), "rows")
    texts = zone_texts(lines)
    structure = stored(zone_structure(texts), "zone-notices")
    wrong_zones = structure.where("severity = 'ERROR'").select("feed_id", F.lit("zones").alias("table"), F.lit("UNPARSABLE_ROWS").alias("status")).distinct()

    tables, notes, lost = {}, [file_presence(listing), told, row_shape(rows), structure], [wrong_zones]
    # what no feed has in its header is not parsed: a row for each table
    declared = {r["table"]: r["bits"] for r in headers.groupBy("table").agg(F.bit_or("declared").alias("bits")).orderBy("table").collect()}
    for name, bits in declared.items():
        names = [c for i, c in enumerate(TABLES[name].names) if bits >> i & 1]
        tables[name], found = type_table(raw_table(rows, name), TABLES[name], names)
        notes.append(found)
        lost.append(failed_feeds(found, TABLES[name]))
    if texts.take(1):
        tables["zones"] = zones_of(texts).join(wrong_zones, "feed_id", "left_anti")
    short = rows.where("cut is not null or size(cells) <> size(header) and not (size(cells) = 1 and cells[0] = '')")
    lost.append(short.select("feed_id", "table", F.lit("UNPARSABLE_ROWS").alias("status")).distinct())
    write_typed_tables(Feed(spark, tables), f"{path}/typed")
    notices = stored(union([df.select(*COLUMNS) for df in notes]), "notices")
    table_status(listing, headers, union(lost)).write.parquet(f"{path}/typed/status")
    return read_typed_tables(spark, f"{path}/typed", tables), notices
