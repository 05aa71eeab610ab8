"""Cells, typing and files."""

import zipfile

import pytest

from headway.functions import cells
from headway.operators.typing import type_table
from headway.schema import TABLES
from headway.sources import csvrows, files
from headway.sources.parquet import read_typed_tables, write_typed_tables
from pyspark.sql import functions as F

from .feeds import codes, feed


def typed(spark, parser, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", parser(F.col("x")).alias("y"))
    return [r["y"] for r in sorted(rows.collect())]


def test_scalars(spark):
    assert typed(spark, cells.to_seconds, "8:00:00", "125:59:59", "08:60:00", "x", None) == [28800, 453599, None, None, None]
    assert [str(x) for x in typed(spark, cells.to_date, "20240229", "20230229", "2024010", "abc")] == ["2024-02-29", "None", "None", "None"]
    assert typed(spark, cells.to_color, "FFFFFF", "00ff0", "GG0000") == [0xFFFFFF, None, None]
    assert typed(spark, cells.to_int, "+12", "-7", "2147483648", "1.0", "") == [12, -7, None, None, None]
    assert typed(spark, cells.to_double, "1.5", ".5f", "1e2D", "Infinity", "1,5") == [1.5, 0.5, 100.0, float("inf"), None]
    assert typed(spark, cells.to_timezone, "Europe/Paris", "UTC+5", "GMT-0330", "+18:00", "+19", "Nowhere") == ["Europe/Paris", "UTC+05:00", "GMT-03:30", "+18:00", None, None]
    assert typed(spark, cells.to_language, "en", "zh-Hant-TW", "e", "en_US", "sl-rozaj") == ["en", "zh-Hant-TW", None, None, "sl-rozaj"]


@pytest.mark.parametrize(("url", "ok"), [
    ("http://example.com", True), ("https://a.b.example.org:8080/p/q?x=1#f", True), ("ftp://10.0.0.1/x", True), ("gopher://example.com", False), ("http://example", False), ("http://256.1.1.1", False), ("http://example.com//a", False),
    ("http://example.com/../a", False), ("http://example.com/?a b", False), ("http://example.com:70000", False), ("http://-a.com", False), ("http://example.notatld", False),
])
def test_urls(spark, url, ok):
    assert (typed(spark, cells.to_url, url) == [url]) is ok


@pytest.mark.parametrize(("mail", "ok"), [("a.b+c@example.com", True), ("a@b", False), ("a..b@example.com", False), (".a@example.com", False), ("a.@example.com", False), ("a@b@example.com", False), ("x" * 65 + "@example.com", False)])
def test_emails(spark, mail, ok):
    assert (typed(spark, cells.to_email, mail) == [mail]) is ok


def test_mixed_case(spark):
    assert typed(spark, cells.mixed_case_missing, "main street", "Main street", "MAIN STREET", "x", "harbour", "HARBOUR", "b12", "A 7 b") == [True, False, True, False, True, False, False, False]


def raw(spark, *rows):
    return spark.createDataFrame([("f", i + 2, *r) for i, r in enumerate(rows)], "feed_id string, _row_number long, stop_id string, stop_name string, stop_lat string, location_type string, extra string")


def test_typing(spark):
    values, found = type_table(raw(spark, (" S1", "Main St", "40.5", "9", "e"), (None, "A", "95", None, None), ("Sé", "B", "abc", "1", None), ("S4", "all lower", None, None, None)), TABLES["stops"])
    got = {(c, n, x["fieldName"]) for c, n, x in codes(found)}
    assert got == {("leading_or_trailing_whitespaces", 2, "stop_id"), ("unexpected_enum_value", 2, "location_type"), ("missing_required_field", 3, "stop_id"), ("number_out_of_range", 3, "stop_lat"), ("non_ascii_or_non_printable_char", 4, "stop_id"), ("invalid_float", 4, "stop_lat"), ("mixed_case_recommended_field", 5, "stop_name")}
    rows = {r["_row_number"]: r for r in values.collect()}
    assert set(rows) == {2, 5} and (rows[2]["stop_id"], rows[2]["location_type"], rows[2]["stop_lat"]) == ("S1", -1, 40.5)
    assert values.columns == TABLES["stops"].struct().fieldNames()


STOPS = '﻿stop_id , stop_name,bogus\r\nS1,"A, ""b""",x\r\n\r\nS2,"two\nlines",y\r\nS3,short\r\n'


def test_lines_of_files_and_archives(spark, tmp_path):
    (tmp_path / "feed1").mkdir()
    (tmp_path / "feed1" / "stops.txt").write_bytes(STOPS.encode() + b"S\xff4,n,z\n")
    with zipfile.ZipFile(tmp_path / "feed2.zip", "w") as z:
        z.writestr("stops.txt", STOPS)
        z.writestr("STOPS.TXT", "other\n1\n")
        z.writestr("empty.txt", "")
    lines = files.read_lines(spark, f"{tmp_path}/feed1/*.txt").unionByName(files.unpack_archives(spark, f"{tmp_path}/*.zip"))
    rows = csvrows.split_rows(lines.where("value is not null"))
    stops = sorted((r["feed_id"], r["_row_number"], r["stop_id"], r["stop_name"]) for r in csvrows.raw_table(rows, "stops").collect())
    assert stops == [("feed1", 2, "S1", 'A, "b"'), ("feed1", 5, "S2", "two\nlines"), ("feed1", 7, "S�4", "n"), ("feed2", 2, "S1", 'A, "b"'), ("feed2", 5, "S2", "two\nlines")]
    assert codes(files.row_shape(rows).where("feed_id = 'feed2'")) == [("invalid_row_length", 6, {"rowLength": "2", "headerCount": "3"})]
    found = codes(files.header_checks(rows.where("feed_id = 'feed2'").select("feed_id", "table", "header").distinct()))
    assert found == [("unknown_column", None, {"fieldName": "bogus", "index": "3"})]


def test_numbers_of_split_files(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "trips.txt").write_text("".join(f"line{i:06d}\n" for i in range(1, 3001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        lines = files.read_lines(spark, f"{tmp_path}/f/*.txt")
        assert lines.rdd.getNumPartitions() > 1 or lines.count() == 3000
        assert lines.where("int(substr(value, 5)) <> line_number").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_presence_and_status(spark):
    listing = spark.createDataFrame([("a", "stops.txt", 10), ("a", "trips.txt", 0), ("a", "sub/routes.txt", 5), ("b", "agency.txt", 1), ("b", "notes.md", 1)], "feed_id string, filename string, size long")
    found = {(r["feed_id"], r["code"], r["filename"]) for r in files.file_presence(listing).collect()}
    assert {("a", "empty_file", "trips.txt"), ("a", "missing_required_file", "routes.txt"), ("a", "invalid_input_files_in_subfolder", "sub/routes.txt"), ("b", "unknown_file", "notes.md"), ("b", "missing_required_file", "stops.txt"), ("b", "missing_recommended_file", "feed_info.txt")} <= found
    headers = spark.createDataFrame([("a", "stops", ["stop_id"]), ("b", "agency", ["agency_id", "agency_id"])], "feed_id string, table string, header array<string>")
    failed = spark.createDataFrame([("a", "stops", "UNPARSABLE_ROWS")], "feed_id string, table string, status string")
    status = {(r["feed_id"], r["table"]): r["status"] for r in files.table_status(listing, headers, failed).collect()}
    assert (status["a", "stops"], status["a", "trips"], status["a", "routes"], status["b", "agency"]) == ("UNPARSABLE_ROWS", "EMPTY_FILE", "MISSING_FILE", "INVALID_HEADERS")


def test_zones_are_read(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "locations.geojson").write_text('{"type":"FeatureCollection","features":[{"id":"Z1","type":"Feature","properties":{},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}}]}')
    r = files.read_zones(spark, f"{tmp_path}/*/locations.geojson").first()
    assert (r["feed_id"], r["feature_id"], r["geometry_type"]) == ("f", "Z1", "Polygon") and r["coordinates"].replace(" ", "").startswith("[[[0,0]")


def test_typed_tables_round_trip(spark, tmp_path):
    f = feed(spark, "one", stops=[dict(stop_id="A", stop_lat=1.5)], trips=[dict(trip_id="T")])
    write_typed_tables(f, f"{tmp_path}/t")
    g = read_typed_tables(spark, f"{tmp_path}/t")
    assert set(g.tables) == {"stops", "trips"} and g["stops"].select("feed_id", "stop_id", "stop_lat").first() == ("one", "A", 1.5)
    assert g["routes"].count() == 0


#: Offsets and what they are as zones; None: invalid.
OFFSETS = {
    "+5": "+05:00", "-05": "-05:00", "+0530": "+05:30", "+05:30": "+05:30", "+053000": "+05:30", "-05:30:15": "-05:30:15", "UTC+5": "UTC+05:00", "UTC+05:00:30": "UTC+05:00:30", "GMT-0330": "GMT-03:30", "UT+1": "UT+01:00",
    "+00": "Z", "-0": "Z", "UTC+0": "UTC", "GMT-00:00": "GMT", "UT": "UT", "UTC": "UTC", "Z": "Z", "+18": "+18:00", "+18:00:01": None, "+1800": "+18:00", "+19": None, "+5:30": None, "UTC+5:30": None, "+05:3": None, "+05:60": None,
    "+053": None, "+05:3000": None, "+0530:00": None, "5": None, "UTC5": None, "utc+5": None, "+": None, "GMT0": "GMT0", "Europe/Berlin": "Europe/Berlin",
}
HOSTS = {
    "a.brussels": True, "a.amsterdam": True, "a.nrw": True, "a.bayern": True, "a.click": True, "a.istanbul": True, "a.rio": True, "a.osaka": True, "a.com.": True, "a.com..": False, "a.xn--p1ai": True, "a.xn--zzzzzz": False,
    "a.xn--vermgensberater-ctb": True, "a.zzzz": False, "com": False, "10.0.0.1": True, "10.0.0.256": False,
}


def test_offsets_and_domains(spark):
    df = spark.createDataFrame([(t,) for t in OFFSETS], "t string")
    assert {r["t"]: r["z"] for r in df.select("t", cells.to_timezone(F.col("t")).alias("z")).collect()} == OFFSETS
    hosts = spark.createDataFrame([(h,) for h in HOSTS], "h string")
    assert {r["h"]: r["v"] for r in hosts.select("h", cells.valid_host(F.col("h")).alias("v")).collect()} == HOSTS
    assert len(cells.tlds()) > 1400
