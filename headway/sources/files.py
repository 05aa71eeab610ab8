"""Feed files as text: archives, lines with their physical numbers, cells, and checks of their form."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..notices import notices, union
from ..schema import TABLES
from .csvrows import MAX_CELL, lone_empty

MAX_ROWS = 1_000_000_000
LINES = "feed_id string, filename string, line_number long, value string"


def unpack_archives(spark: SparkSession, glob: str) -> DataFrame:
    """Lines of the members of the zip archives that glob names, see unpack."""
    return unpack(spark.read.format("binaryFile").load(glob).select("path", "content"))


def unpack(archives: DataFrame) -> DataFrame:
    """archives (path, content) -> lines of their members: feed_id (the archive's name), filename, line_number, value.

    A task takes an archive apart into members, still packed; members are dealt over tasks, which unpack
    and decode them. Of a repeated name the first member counts, and names are compared without case.
    Bytes that are no UTF-8 become U+FFFD, and a byte order mark is dropped. An empty file is a
    row without a line, and so is an archive that can't be read (its filename is empty).
    """
    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                feed = re.sub(r"\.zip$", "", path.rsplit("/", 1)[-1], flags=re.I)
                for row in packed_members(feed, content):
                    yield pd.DataFrame([row], columns=["feed_id", "filename", "deflated", "data"])

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for feed, name, deflated, data in batch.itertuples(index=False):
                rows, n = [], 0
                for n, text in enumerate(lines_of(bytes(data), deflated), 1):
                    rows.append((feed, name, n, text))
                    if len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=["feed_id", "filename", "line_number", "value"])
                        rows = []
                if not n:
                    rows.append((feed, name, 0, None))
                yield pd.DataFrame(rows, columns=["feed_id", "filename", "line_number", "value"])

    packed = archives.select("path", "content").mapInPandas(members, "feed_id string, filename string, deflated boolean, data binary")
    return packed.repartition("feed_id", "filename").mapInPandas(lines, LINES)


def packed_members(feed: str, content: bytes) -> Iterator[tuple[str, str, bool, bytes]]:
    """(feed, filename, deflated, data) of each member, by the archive's directory; data as it is packed."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        yield feed, "", False, b""
        return
    seen: set[str] = set()
    for member in archive.infolist():
        name = member.filename.lower()
        if member.is_dir() or name in seen:
            continue
        seen.add(name)
        if member.compress_type != zipfile.ZIP_DEFLATED or member.flag_bits & 1:
            yield feed, member.filename, False, archive.read(member)
            continue
        # a member's own header: 30 bytes, then its name and a further field
        at = member.header_offset
        begin = at + 30 + int.from_bytes(content[at + 26 : at + 28], "little") + int.from_bytes(content[at + 28 : at + 30], "little")
        yield feed, member.filename, True, content[begin : begin + member.compress_size]


def lines_of(data: bytes, deflated: bool) -> Iterator[str]:
    """The lines of a member, without their ends."""
    text = io.TextIOWrapper(io.BufferedReader(Inflated(data)) if deflated else io.BytesIO(data), "utf-8-sig", "replace", newline="")
    return (line.rstrip("\r\n") for line in text)


class Inflated(io.RawIOBase):
    """Deflated bytes as a stream, unpacked as it is read."""

    def __init__(self, data: bytes):
        self.inflate, self.rest = zlib.decompressobj(-zlib.MAX_WBITS), data

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        found = self.inflate.decompress(self.rest, len(into))
        self.rest = self.inflate.unconsumed_tail
        into[: len(found)] = found
        return len(found)


def read_lines(spark: SparkSession, glob: str, feed_at: int = -2, file_at: int = -1) -> DataFrame:
    """Lines of plain files `.../<feed_id>/<filename>` with physical numbers.

    feed_at and file_at are the places of the two names in the path, counted from its end.

    Large files are read in splits. Lines of a split follow each other in one task; the splits'
    line counts, a row for each split (as the driver lists them), are broadcast and give the number at which each begins.
    """
    raw = spark.read.text(glob).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"), "value")
    splits = raw.groupBy("path", "at").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("path").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = raw.join(F.broadcast(splits.withColumn("before", before).drop("n")), ["path", "at"])
    parts = F.split(F.url_decode("path"), "/")
    return numbered.select(F.element_at(parts, feed_at).alias("feed_id"), F.element_at(parts, file_at).alias("filename"), (F.col("before") + F.col("id") - F.col("first") + 1).alias("line_number"), F.regexp_replace("value", "^﻿|\r$", "").alias("value"))


def zone_texts(lines: DataFrame) -> DataFrame:
    """Lines -> (feed_id, value): the whole text of each feed's locations.geojson. A file of zones is one row, as JSON has no lines."""
    own = lines.where((F.lower("filename") == "locations.geojson") & F.col("value").isNotNull())
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", "value"))), lambda s: s["value"]), "\n")
    return own.groupBy("feed_id").agg(text.alias("value"))


def zones_of(texts: DataFrame) -> DataFrame:
    """(feed_id, value) -> the zones table: a row for each feature, with id, index, geometry type and coordinates as JSON."""
    shape = "struct<features:array<struct<id:string,geometry:struct<type:string,coordinates:string>>>>"
    each = texts.select("feed_id", F.posexplode(F.from_json("value", shape)["features"]).alias("i", "f"))
    return each.select(
        "feed_id", F.col("i").cast("long").alias("_row_number"), F.col("f.id").alias("feature_id"), F.col("i").alias("feature_index"),
        F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"),
    )


def read_zones(spark: SparkSession, glob: str) -> DataFrame:
    """The zones of files `.../<feed_id>/locations.geojson`."""
    return zones_of(spark.read.text(glob, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("feed_id"), "value"))


# ---- checks of listings, headers and rows


def file_presence(listing: DataFrame) -> DataFrame:
    """listing (feed_id, filename, size) -> notices on files that are missing, unknown, empty or misplaced."""
    known = {t.file: t for t in TABLES.values()}
    base = F.element_at(F.split("filename", "/"), -1)
    rows = listing.select("feed_id", F.lower("filename").alias("filename"), "size", F.lower(base).alias("base"))
    top = rows.where(~F.col("filename").contains("/"))
    names = top.groupBy("feed_id").agg(F.collect_set("filename").alias("names"))
    has = lambda f: F.array_contains("names", f)
    required = [t.file for t in TABLES.values() if t.presence == "required"]
    lacking = F.array(*(F.when(~has(f), F.lit(f)) for f in required), F.when(~has("stops.txt") & ~has("locations.geojson"), F.lit("stops.txt")), F.when(~has("feed_info.txt") & has("translations.txt"), F.lit("feed_info.txt")))
    missing = names.select("feed_id", F.explode(F.filter(lacking, lambda x: x.isNotNull())).alias("file"))
    hinted = names.where(~has("feed_info.txt") & ~has("translations.txt"))
    n = lambda df, code, severity, file: notices(df.withColumn("_f", file), code, severity, "", None, file="_f").withColumn("filename", F.col("context")["file"])
    return union([
        n(missing, "missing_required_file", "ERROR", F.col("file")), n(hinted, "missing_recommended_file", "WARNING", F.lit("feed_info.txt")),
        n(top.where(~F.col("filename").isin([*known, ""])), "unknown_file", "INFO", F.col("filename")), n(top.where((F.col("size") == 0) & F.col("filename").isin(list(known))), "empty_file", "ERROR", F.col("filename")),
        n(rows.where(F.col("filename").contains("/") & F.col("base").isin(list(known))), "invalid_input_files_in_subfolder", "ERROR", F.col("filename")),
        n(names.where(~has("calendar.txt") & ~has("calendar_dates.txt")), "missing_calendar_and_calendar_date_files", "ERROR", F.lit("calendar.txt")),
    ])


def header_checks(headers: DataFrame) -> DataFrame:
    """headers (feed_id, table, header array) -> notices on names that are empty, repeated, unknown or missing; indexes from 1."""
    file = F.concat("table", F.lit(".txt"))
    cells = headers.select("feed_id", "table", F.posexplode("header").alias("i", "name")).withColumn("i", F.col("i") + 1)
    first = F.min("i").over(W.partitionBy("feed_id", "table", "name"))
    named = cells.where("name <> ''").withColumn("first", first)
    spark = headers.sparkSession
    schema = spark.createDataFrame([(t.name, f.name, f.presence) for t in TABLES.values() for f in t.fields], "table string, name string, presence string")
    wanted = headers.select("feed_id", "table").distinct().join(F.broadcast(schema.where("presence = 'required'")), "table")
    put = lambda df, code, severity, **c: notices(df.withColumn("_file", file), code, severity, "", None, **c, _file="_file").select("feed_id", "code", "severity", F.col("context")["_file"].alias("filename"), "row_number", F.map_filter("context", lambda k, v: k != "_file").alias("context"))
    return union([
        put(cells.where("name = ''"), "empty_column_name", "ERROR", index="i"), put(named.where("i > first"), "duplicated_column", "ERROR", fieldName="name", firstIndex="first", secondIndex="i"),
        put(named.where("i = first").join(F.broadcast(schema.select("table", "name")), ["table", "name"], "left_anti"), "unknown_column", "INFO", fieldName="name", index="i"),
        put(wanted.join(named, ["feed_id", "table", "name"], "left_anti"), "missing_required_column", "ERROR", fieldName="name"),
    ])


def row_shape(rows: DataFrame) -> DataFrame:
    """split_rows() -> notices on rows of a wrong length, empty rows, cells that are too long and files with too many rows."""
    named = rows.withColumn("_file", F.concat("table", F.lit(".txt")))

    def put(df: DataFrame, code: str, severity: str, row: str | None = "_row_number", **c: Column | str) -> DataFrame:
        found = notices(df, code, severity, "", row, **c, _file="_file")
        rest = F.map_filter("context", lambda k, v: k != "_file")
        return found.select("feed_id", "code", "severity", F.col("context")["_file"].alias("filename"), "row_number", rest.alias("context"))

    whole = named.where("cut is null")
    empty = lone_empty(F.col("cells"))
    many = named.groupBy("feed_id", "_file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MAX_ROWS)
    cut = named.where("cut is not null").withColumn("cell", F.get("cells", F.col("cut")))
    return union([
        put(whole.where(~empty & (F.size("cells") != F.size("header"))), "invalid_row_length", "ERROR", rowLength=F.size("cells"), headerCount=F.size("header")),
        put(whole.where(empty), "empty_row", "WARNING"),
        put(
            cut, "csv_parsing_failed", "ERROR", None, lineIndex=F.col("_row_number") - 1, columnIndex=F.when(F.col("cut") >= 0, F.col("cut")),
            parsedContent=F.left("cell", F.lit(MAX_CELL)),
        ),
        put(many, "too_many_rows", "ERROR", None, rowCount="n"),
    ])


def table_status(listing: DataFrame, headers: DataFrame, failed: DataFrame) -> DataFrame:
    """feed_id, table, status, columns for every feed and table. failed: (feed_id, table, status) of tables that lost rows.

    The first that holds counts: missing, empty, invalid headers, unparsable rows, parsable.
    """
    spark = listing.sparkSession
    tables = F.broadcast(spark.createDataFrame([(t.name, t.file) for t in TABLES.values()], "table string, file string"))
    every = listing.select("feed_id").distinct().join(tables)
    sizes = listing.groupBy("feed_id", F.lower("filename").alias("file")).agg(F.max("size").alias("size"))
    bad = header_checks(headers).where("severity = 'ERROR'").select("feed_id", F.col("filename").alias("file"), F.lit(True).alias("bad")).distinct()
    lost = failed.groupBy("feed_id", "table").agg(F.min("status").alias("lost"))
    rows = every.join(sizes, ["feed_id", "file"], "left").join(bad, ["feed_id", "file"], "left").join(lost, ["feed_id", "table"], "left").join(headers.select("feed_id", "table", F.col("header").alias("columns")), ["feed_id", "table"], "left")
    status = F.when(F.col("size").isNull(), "MISSING_FILE").when(F.col("size") == 0, "EMPTY_FILE").when(F.col("bad"), "INVALID_HEADERS").when(F.col("lost").isNotNull(), F.col("lost")).otherwise("PARSABLE")
    return rows.select("feed_id", "table", status.alias("status"), "columns")
