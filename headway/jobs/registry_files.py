"""Registered queries on text: cells, typing, files, headers, shapes and zones."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..feed import Feed, group_counts, row_at_max, rows_any_set
from ..functions import cells
from ..notices import context_text
from ..operators import zones
from ..operators.typing import type_table
from ..schema import TABLES, Field, Table
from ..shared import shared_folder
from ..sources import csvrows, files
from ..sources.raw import listing_of
from .projection import PROJECTION, feed_of, with_feed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def over(source: str, sql: str) -> Callable[[SparkSession, str], DataFrame]:
    """A reader of sql over one of the driver's tables, named {t} in it."""
    return lambda spark, sf_dir: spark.sql(sql, t=spark.read.parquet(f"{sf_dir}/{source}.parquet"))


def flat(found: DataFrame) -> DataFrame:
    return context_text(found).select("code", "filename", "row_number", "context")


def scratch(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


# ---- C: cells

RAW = """select 'feed' as feed_id, event_id+2 as _row_number,
 case when event_id%40=0 then null when event_id%41=0 then concat(' T',user_id) when event_id%43=0 then concat('T',user_id,chr(10),'x') when event_id%47=0 then concat('Té',user_id) when event_id%53=0 then '   ' else concat('T',user_id) end as trip_id,
 case when event_id%31=0 then null else concat(event_id%30,':',lpad(cast(event_id%70 as string),2,'0'),':00') end as start_time, concat(event_id%25+5,':30:',event_id%66) as end_time,
 case when event_id%17=0 then 'x1' when event_id%19=0 then '-5' when event_id%23=0 then '0' when event_id%29=0 then '99999999999' else cast(event_id%900+1 as string) end as headway_secs,
 case event_id%6 when 0 then '0' when 1 then '1' when 2 then '7' when 3 then 'a' end as exact_times from {t}"""


def _problem(code: str, field: str, value: str, when: str) -> str:
    return f"SELECT '{code}' AS code, 'frequencies.txt' AS filename, CAST(_row_number AS BIGINT) AS row_number, concat_ws(';', 'fieldName={field}', 'fieldValue=' || {value}) AS context FROM r WHERE {when}"


_TIME = "'^[0-9]{1,3}:[0-5][0-9]:[0-5][0-9]$'"
_SECONDS = lambda c: f"(CAST(split_part({c}, ':', 1) AS INTEGER) * 3600 + CAST(split_part({c}, ':', 2) AS INTEGER) * 60 + CAST(split_part({c}, ':', 3) AS INTEGER))"
_BOTH = f"regexp_matches(start_time, {_TIME}) AND regexp_matches(end_time, {_TIME})"
_INTEGER = "regexp_matches(headway_secs, '^-?[0-9]+$') AND length(headway_secs) < 10"
_PROBLEMS = " UNION ALL ".join([
    _problem("missing_required_field", "trip_id", "NULL", "coalesce(trim(trip_id), '') = ''"), _problem("missing_required_field", "start_time", "NULL", "start_time IS NULL"), _problem("new_line_in_value", "trip_id", "trip_id", "contains(trip_id, chr(10))"),
    _problem("leading_or_trailing_whitespaces", "trip_id", "trip_id", "starts_with(trip_id, ' ')"), _problem("non_ascii_or_non_printable_char", "trip_id", "trip_id", "contains(trip_id, 'é') OR contains(trip_id, chr(10))"),
    *(_problem("invalid_time", c, c, f"NOT regexp_matches({c}, {_TIME})") for c in ("start_time", "end_time")), _problem("invalid_integer", "headway_secs", "headway_secs", f"NOT ({_INTEGER})"),
    _problem("number_out_of_range", "headway_secs", "headway_secs", f"CASE WHEN {_INTEGER} THEN CAST(headway_secs AS BIGINT) <= 0 ELSE false END"), _problem("invalid_integer", "exact_times", "exact_times", "exact_times = 'a'"), _problem("unexpected_enum_value", "exact_times", "exact_times", "exact_times = '7'"),
    *(_problem(code, "end_time", f"CASE WHEN {_BOTH} THEN {_SECONDS('end_time')} END", f"CASE WHEN {_BOTH} THEN {_SECONDS('start_time')} {op} {_SECONDS('end_time')} ELSE false END") for code, op in (("start_and_end_range_out_of_order", ">"), ("start_and_end_range_equal", "="))),
])
QUERIES["c1_cell_problems"] = lambda spark, sf_dir: flat(type_table(over("events", RAW)(spark, sf_dir), TABLES["frequencies"])[1])
SQL["c1_cell_problems"] = f"WITH r AS ({RAW.format(t='events')}) {_PROBLEMS}"
QUERIES["c11_typed_rows"] = lambda spark, sf_dir: type_table(over("events", RAW)(spark, sf_dir), TABLES["frequencies"])[0].drop("feed_id")
SQL["c11_typed_rows"] = f"""WITH r AS ({RAW.format(t='events')}) SELECT _row_number, trim(trip_id) AS trip_id, {_SECONDS('start_time')} AS start_time, {_SECONDS('end_time')} AS end_time, CAST(headway_secs AS INTEGER) AS headway_secs, CASE exact_times WHEN '7' THEN -1 ELSE CAST(exact_times AS INTEGER) END AS exact_times FROM r
 WHERE coalesce(trim(trip_id), '') <> '' AND NOT contains(trip_id, chr(10)) AND CASE WHEN {_BOTH} THEN {_SECONDS('start_time')} < {_SECONDS('end_time')} ELSE false END AND CASE WHEN {_INTEGER} THEN CAST(headway_secs AS BIGINT) > 0 ELSE false END AND coalesce(exact_times, '') <> 'a'"""

_TEXT = Table("texts", (Field("id", "id"), Field("text", "text", mixed_case=True)))
HYGIENE = """select 'feed' as feed_id, doc_id as _row_number, cast(doc_id as string) as id, case when doc_id%7=0 then concat(' ',text) when doc_id%11=0 then concat(text,'�')
 when doc_id%13=0 then replace(text,'\n',' ') when doc_id%3=0 then lower(replace(text,'\n',' ')) else text end as text from {t}"""
QUERIES["c2_text_hygiene"] = lambda spark, sf_dir: type_table(over("documents", HYGIENE)(spark, sf_dir), _TEXT)[1].groupBy("code", "severity").agg(
    F.count(F.lit(1)).alias("n"), F.min("row_number").alias("first_row"), F.max("row_number").alias("last_row"))
SQL["c2_text_hygiene"] = f"""WITH r AS ({HYGIENE.format(t='documents')}), e AS (SELECT *, contains(text, '�') AS bad, contains(text, chr(10)) OR contains(text, chr(13)) AS broken, regexp_matches(text, '^[\\x00-\\x20]') OR regexp_matches(text, '[\\x00-\\x20]\\z') AS spaced FROM r),
 k AS (SELECT *, list_filter(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 0) AS tokens FROM e),
 w AS (SELECT *, list_filter(tokens, lambda x: length(x) > 1 AND NOT regexp_matches(x, '\\p{{N}}')) AS words FROM k),
 p AS (SELECT 'invalid_character' AS code, 'ERROR' AS severity, _row_number AS n FROM e WHERE bad UNION ALL SELECT 'new_line_in_value', 'ERROR', _row_number FROM e WHERE broken UNION ALL SELECT 'leading_or_trailing_whitespaces', 'WARNING', _row_number FROM e WHERE spaced
 UNION ALL SELECT 'mixed_case_recommended_field', 'WARNING', _row_number FROM w WHERE NOT bad AND NOT broken AND text IS NOT NULL AND CASE WHEN len(tokens) <= 1 THEN len(words) = 1 AND lower(words[1]) = words[1] ELSE len(words) >= 2 AND len(list_filter(words, lambda x: lower(x) <> x AND upper(x) <> x)) = 0 END)
 SELECT code, severity, count(*) AS n, min(n) AS first_row, max(n) AS last_row FROM p GROUP BY 1, 2"""
NAMES = "select l_orderkey as k, l_linenumber as i, case l_orderkey%9 when 0 then 'main street' when 1 then 'Main Street' when 2 then 'MAIN STREET' when 3 then 'x' when 4 then 'harbour' when 5 then 'b12' when 6 then 'A 7 st' when 7 then 'route 66 lane' else concat('Stop ',l_partkey) end as name from {t}"
QUERIES["c3_mixed_case"] = lambda spark, sf_dir: over("lineitem", NAMES)(spark, sf_dir).where(cells.mixed_case_missing(F.col("name"))).groupBy("name").count().withColumnRenamed("count", "n")
SQL["c3_mixed_case"] = f"SELECT name, count(*) AS n FROM ({NAMES.format(t='lineitem')}) q WHERE name IN ('main street', 'MAIN STREET', 'harbour', 'route 66 lane') GROUP BY 1"
#: Strings by kind, with whether they are valid.
KNOWN = {
    "currency": ("AED AFN ALL AMD AOA ARS AUD BDT BGN BHD BOB BRL CAD CHF CLF CLP CNY COP CZK DKK EEK EGP ETB EUR GBP GEL HKD HRK HUF IDR ILS INR ISK JPY KES KRW KWD LKR LTL MAD MXN MYR NGN NOK NZD PEN PHP PLN RON RUB SEK SGD THB TND TRY UAH USD UYU VND XAF XOF ZAR ZWL".split(),
                 "eur EURO XXQ ZZZ US AAA QQQ".split()),
    "timezone": ("Africa/Cairo America/Argentina/Buenos_Aires America/New_York America/Sao_Paulo Asia/Kolkata Asia/Tokyo Australia/Sydney CET CST6CDT Cuba EET EST5EDT Egypt Eire Etc/GMT+5 Europe/Berlin Europe/Paris GB GMT Greenwich Hongkong Iceland Indian/Maldives Iran Israel Jamaica Japan MET NZ Navajo PRC PST8PDT Pacific/Auckland Poland Portugal ROK Singapore Turkey UCT US/Pacific UTC Universal W-SU WET Zulu".split(),
                 "Foo/Bar Mars Europe/Atlantis europe/paris America/New-York Japan/Tokyo Z9".split()),
    "url": ("https://metro.kr/x https://www.mbta.ru https://a.xyz http://b.transport ftp://c.com/d?e=f http://10.0.0.1/x https://d.museum https://e.berlin https://f.gr https://g.vn https://h.tw https://i.hr https://j.rs https://k.cl https://l.eu https://m.uk:8080/n https://o.africa.za https://p.xn--p1ai".split(),
            "https://a.zzzz https://b http://c..com http://d.com//e http://-f.com http://g.com:99999 gopher://h.com http://i.com/../j mailto:k@l.com http://256.1.1.1".split()),
    "email": ("a@b.com a.b+c@d.co.jp x@y.kr z_9@q.ru n@m.xyz".split(), "a@b a@b.zzzz @c.com d..e@f.com g@h@i.com .j@k.com".split()),
}
_VALUES = [(kind, text, good) for kind, (right, wrong) in KNOWN.items() for texts, good in ((right, True), (wrong, False)) for text in texts]


def known_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each text of KNOWN, put into the rows of events, passes its parser."""
    texts = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(t).alias("text")) for k, t, _ in _VALUES))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.get(texts, (F.col("event_id") % len(_VALUES)).cast("int")).alias("v")).select("v.*")
    parsers = {"currency": cells.to_currency, "timezone": cells.to_timezone, "url": cells.to_url, "email": cells.to_email}
    parsed = F.coalesce(*(F.when(F.col("kind") == k, parse(F.col("text"))) for k, parse in parsers.items()))
    return rows.groupBy("kind", "text").agg(F.count(F.lit(1)).alias("n"), F.count(parsed).alias("n_valid"))


QUERIES["c7_c8_known_values"] = known_values
SQL["c7_c8_known_values"] = "WITH v(i, kind, text, good) AS (VALUES " + ", ".join(f"({i}, '{k}', '{t}', {g})" for i, (k, t, g) in enumerate(_VALUES)) + f""")
 SELECT kind, text, count(*) AS n, sum(CASE WHEN good THEN 1 ELSE 0 END)::BIGINT AS n_valid FROM events JOIN v ON v.i = event_id % {len(_VALUES)} GROUP BY 1, 2"""
DATES = "select event_id, case when event_id%13=0 then concat('2024',lpad(cast(event_id%14 as string),2,'0'),lpad(cast(event_id%35 as string),2,'0')) when event_id%17=0 then '20240230' else concat('2024',lpad(cast(event_id%12+1 as string),2,'0'),lpad(cast(event_id%28+1 as string),2,'0')) end as d, case when event_id%5=0 then '12345' when event_id%7=0 then 'GGGGGG' else lpad(cast(event_id%1000000 as string),6,'0') end as c from {t}"
QUERIES["c4_dates_and_colors"] = lambda spark, sf_dir: over("events", DATES)(spark, sf_dir).select("event_id", cells.to_date(F.col("d")).cast("string").alias("date"), cells.to_color(F.col("c")).alias("color"))
SQL["c4_dates_and_colors"] = f"SELECT event_id, CAST(TRY_CAST(substr(d, 1, 4) || '-' || substr(d, 5, 2) || '-' || substr(d, 7, 2) AS DATE) AS VARCHAR) AS date, CASE WHEN regexp_matches(c, '^[0-9A-Fa-f]{{6}}$') THEN CAST('0x' || c AS INTEGER) END AS color FROM ({DATES.format(t='events')}) q"
NUMBERS = "select event_id, case event_id%9 when 0 then '1e3' when 1 then '.5' when 2 then '7.' when 3 then '+2.25' when 4 then '-0.125f' when 5 then 'abc' when 6 then '1,5' when 7 then '' else cast(event_id as string) end as x from {t}"
QUERIES["c5_numbers"] = lambda spark, sf_dir: over("events", NUMBERS)(spark, sf_dir).select("event_id", cells.to_double(F.col("x")).alias("value"), cells.to_int(F.col("x")).alias("whole"))
SQL["c5_numbers"] = f"SELECT event_id, CASE x WHEN '1e3' THEN 1000 WHEN '.5' THEN 0.5 WHEN '7.' THEN 7 WHEN '+2.25' THEN 2.25 WHEN '-0.125f' THEN -0.125 ELSE TRY_CAST(CASE WHEN regexp_matches(x, '^[0-9]+$') THEN x END AS DOUBLE) END AS value, TRY_CAST(CASE WHEN regexp_matches(x, '^[0-9]+$') THEN x END AS INTEGER) AS whole FROM ({NUMBERS.format(t='events')}) q"
LISTS = "select event_id, case event_id%6 when 0 then 'EUR' when 1 then 'usd' when 2 then 'XXQ' when 3 then 'JPY' else 'CAD' end as cur, case event_id%7 when 0 then 'en' when 1 then 'pt-BR' when 2 then 'zh-Hant-TW' when 3 then 'e' when 4 then 'en_US' else 'deu' end as lang, case event_id%8 when 0 then 'Europe/Paris' when 1 then 'UTC+5' when 2 then '-0330' when 3 then 'GMT+19' when 4 then 'Mars' when 5 then '+02:45' else 'UTC' end as tz from {t}"
QUERIES["c7_reference_lists"] = lambda spark, sf_dir: over("events", LISTS)(spark, sf_dir).select("event_id", cells.to_currency(F.col("cur")).alias("currency"), cells.to_language(F.col("lang")).alias("language"), cells.to_timezone(F.col("tz")).alias("timezone"))
SQL["c7_reference_lists"] = f"SELECT event_id, CASE WHEN cur IN ('EUR', 'JPY', 'CAD') THEN cur END AS currency, CASE WHEN lang NOT IN ('e', 'en_US') THEN lang END AS language, CASE tz WHEN 'UTC+5' THEN 'UTC+05:00' WHEN '-0330' THEN '-03:30' WHEN 'GMT+19' THEN NULL WHEN 'Mars' THEN NULL ELSE tz END AS timezone FROM ({LISTS.format(t='events')}) q"
LINKS = "select page_id, case page_id%9 when 0 then url when 1 then replace(url,'http','gopher') when 2 then concat(url,'//x') when 3 then replace(url,'example','exa mple') when 4 then concat(url,'?q=a b') when 5 then replace(url,'.example','.example.invalidtld/') when 6 then 'http://192.168.0.1:8080/a' when 7 then 'http://256.1.1.1/' else 'ftp://a-b.example.org:70000/' end as u, concat(case page_id%5 when 0 then 'a.b' when 1 then '.a' when 2 then 'a..b' when 3 then 'a b' else 'x+y' end,'@',case page_id%3 when 0 then 'example.org' when 1 then 'example' else '-x.com' end) as m from {t}"
QUERIES["c8_urls_and_emails"] = lambda spark, sf_dir: over("pages", LINKS)(spark, sf_dir).select("page_id", cells.to_url(F.col("u")).isNotNull().alias("url_ok"), cells.to_email(F.col("m")).isNotNull().alias("email_ok"))
SQL["c8_urls_and_emails"] = f"""SELECT page_id, CASE page_id % 9 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN contains(u, '#') OR contains(u, '?') WHEN 3 THEN false WHEN 4 THEN contains(u, '#') WHEN 5 THEN false WHEN 6 THEN true ELSE false END AS url_ok, page_id % 5 IN (0, 4) AND page_id % 3 = 0 AS email_ok FROM ({LINKS.format(t='pages')}) q"""
MONEY = "select 'feed' as feed_id, c_custkey+2 as _row_number, concat('F',c_custkey) as fare_id, case c_custkey%4 when 0 then '10.50' when 1 then '10' when 2 then '3.125' else '7.5' end as price, case c_custkey%3 when 0 then 'EUR' when 1 then 'JPY' else 'KWD' end as currency_type from {t}"
QUERIES["c10_currency_scale"] = lambda spark, sf_dir: flat(type_table(over("customer", MONEY)(spark, sf_dir), TABLES["fare_attributes"])[1])
SQL["c10_currency_scale"] = f"SELECT 'invalid_currency_amount' AS code, 'fare_attributes.txt' AS filename, _row_number AS row_number, 'fieldName=price;fieldValue=' || price AS context FROM ({MONEY.format(t='customer')}) q WHERE CASE WHEN contains(price, '.') THEN length(split_part(price, '.', 2)) ELSE 0 END <> CASE currency_type WHEN 'EUR' THEN 2 WHEN 'JPY' THEN 0 ELSE 3 END"

# ---- A and B: files

LISTING = "select concat('F',n_regionkey) as feed_id, case n_nationkey%11 when 0 then 'stops.txt' when 1 then 'trips.txt' when 2 then 'routes.txt' when 3 then 'agency.txt' when 4 then 'notes.txt' when 5 then 'sub/stops.txt' when 6 then 'calendar.txt' when 7 then 'translations.txt' when 8 then 'stop_times.txt' when 9 then 'feed_info.txt' else 'locations.geojson' end as filename, cast(case when n_nationkey%6=0 then 0 else 100+n_nationkey end as bigint) as size from {t}"
QUERIES["b1_file_presence"] = lambda spark, sf_dir: context_text(files.file_presence(over("nation", LISTING)(spark, sf_dir))).select(F.col("feed_id").alias("feed"), "code", "filename")
SQL["b1_file_presence"] = f"""WITH l AS ({LISTING.format(t='nation')}), f AS (SELECT DISTINCT feed_id FROM l), h AS (SELECT feed_id, list(filename) AS n FROM l WHERE NOT contains(filename, '/') GROUP BY 1)
 SELECT feed_id AS feed, 'missing_required_file' AS code, q AS filename FROM h, (VALUES ('agency.txt'), ('routes.txt'), ('trips.txt'), ('stop_times.txt')) v(q) WHERE NOT list_contains(n, q)
 UNION ALL SELECT feed_id, 'missing_required_file', 'stops.txt' FROM h WHERE NOT list_contains(n, 'stops.txt') AND NOT list_contains(n, 'locations.geojson') UNION ALL SELECT feed_id, 'missing_required_file', 'feed_info.txt' FROM h WHERE NOT list_contains(n, 'feed_info.txt') AND list_contains(n, 'translations.txt')
 UNION ALL SELECT feed_id, 'missing_recommended_file', 'feed_info.txt' FROM h WHERE NOT list_contains(n, 'feed_info.txt') AND NOT list_contains(n, 'translations.txt') UNION ALL SELECT feed_id, 'unknown_file', filename FROM l WHERE filename = 'notes.txt'
 UNION ALL SELECT feed_id, 'empty_file', filename FROM l WHERE size = 0 AND filename NOT IN ('notes.txt', 'sub/stops.txt') UNION ALL SELECT feed_id, 'invalid_input_files_in_subfolder', filename FROM l WHERE contains(filename, '/')
 UNION ALL SELECT feed_id, 'missing_calendar_and_calendar_date_files', 'calendar.txt' FROM h WHERE NOT list_contains(n, 'calendar.txt')"""
LINES = "select concat('F',event_id%50) as feed_id, 'frequencies.txt' as filename, floor(event_id/50)+1 as line_number, case when event_id<50 then case event_id%4 when 0 then 'trip_id,start_time,end_time,headway_secs' when 1 then 'trip_id,start_time,,end_time' when 2 then 'trip_id,color,end_time,trip_id' else 'trip_id , start_time,end_time,headway_secs' end when event_id%13=0 then concat('T',user_id,',1,2') when event_id%17=0 then '\"\"' when event_id%19=0 then '' when event_id%23=0 then concat('\"T,',user_id,'\",\"a \"\"b\"\"\",3,4') else concat('T',user_id,', 1 ,2,3') end as value from {t}"
QUERIES["b2_header_checks"] = lambda spark, sf_dir: context_text(files.header_checks(csvrows.split_rows(over("events", LINES)(spark, sf_dir)).select("feed_id", "table", "header").distinct())).select(F.col("feed_id").alias("feed"), "code", "filename", "context")
SQL["b2_header_checks"] = "WITH f AS (SELECT event_id AS i, 'F' || event_id AS feed, 'frequencies.txt' AS filename FROM events WHERE event_id < 50) SELECT feed, 'empty_column_name' AS code, filename, 'index=3' AS context FROM f WHERE i % 4 = 1 UNION ALL SELECT feed, 'missing_required_column', filename, 'fieldName=headway_secs' FROM f WHERE i % 4 IN (1, 2) UNION ALL SELECT feed, 'missing_required_column', filename, 'fieldName=start_time' FROM f WHERE i % 4 = 2 UNION ALL SELECT feed, 'unknown_column', filename, 'fieldName=color;index=2' FROM f WHERE i % 4 = 2 UNION ALL SELECT feed, 'duplicated_column', filename, 'fieldName=trip_id;firstIndex=1;secondIndex=4' FROM f WHERE i % 4 = 2"
QUERIES["b3_row_shape"] = lambda spark, sf_dir: context_text(files.row_shape(csvrows.split_rows(over("events", LINES)(spark, sf_dir)))).select(F.col("feed_id").alias("feed"), "code", "row_number", "context")
SQL["b3_row_shape"] = "SELECT 'F' || (event_id % 50) AS feed, CASE WHEN event_id % 13 = 0 THEN 'invalid_row_length' ELSE 'empty_row' END AS code, CAST(floor(event_id / 50) AS BIGINT) + 1 AS row_number, CASE WHEN event_id % 13 = 0 THEN 'rowLength=3;headerCount=4' ELSE '' END AS context FROM events WHERE event_id >= 50 AND (event_id % 13 = 0 OR event_id % 17 = 0)"
QUERIES["a2_raw_rows"] = lambda spark, sf_dir: csvrows.raw_table(csvrows.split_rows(over("events", LINES)(spark, sf_dir)), "frequencies").where("trip_id <> ''").select(F.col("feed_id").alias("feed"), "_row_number", "trip_id", "start_time", "end_time", "headway_secs")
SQL["a2_raw_rows"] = """WITH r AS (SELECT event_id, event_id % 50 % 4 AS k, 'F' || (event_id % 50) AS feed, CAST(floor(event_id / 50) AS BIGINT) + 1 AS _row_number, user_id, event_id % 23 = 0 AS q FROM events WHERE event_id >= 50 AND event_id % 13 <> 0 AND event_id % 17 <> 0 AND event_id % 19 <> 0)
 SELECT feed, _row_number, CASE WHEN q THEN 'T,' || user_id ELSE 'T' || user_id END AS trip_id, CASE WHEN k = 2 THEN NULL WHEN q THEN 'a "b"' ELSE '1' END AS start_time, CASE WHEN k = 1 THEN CASE WHEN q THEN '4' ELSE '3' END ELSE CASE WHEN q THEN '3' ELSE '2' END END AS end_time, CASE WHEN k IN (1, 2) THEN NULL WHEN q THEN '4' ELSE '3' END AS headway_secs FROM r"""


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stop_times written as CSV files by Spark, read back as lines, split, typed."""
    folder = scratch(spark)
    columns = ["trip_id", "stop_id", "stop_sequence", "shape_dist_traveled", "timepoint"]
    feed_of(spark, sf_dir, "stop_times")["stop_times"].select(*columns).write.option("header", True).csv(f"{folder}/stop_times.txt")
    lines = files.read_lines(spark, f"{folder}/stop_times.txt", feed_at=-1, file_at=-2)
    typed, _ = type_table(csvrows.raw_table(csvrows.split_rows(lines), "stop_times"), TABLES["stop_times"])
    return typed.select(*columns).groupBy("stop_sequence").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("trip_id").alias("n_trips"), F.count("stop_id").alias("n_stops"), F.round(F.sum("shape_dist_traveled"), 1).alias("total"), F.sum("timepoint").alias("timepoints"))


QUERIES["a2_csv_round_trip"] = csv_round_trip
SQL["a2_csv_round_trip"] = with_feed("SELECT stop_sequence, count(*) AS n, count(DISTINCT trip_id) AS n_trips, count(stop_id) AS n_stops, round(sum(shape_dist_traveled), 1) AS total, CAST(sum(timepoint) AS BIGINT) AS timepoints FROM stop_times GROUP BY 1")


def typed_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed tables written by feed and read again."""
    from ..sources.parquet import read_typed_tables, write_typed_tables

    folder = f"{scratch(spark)}/typed"
    write_typed_tables(feed_of(spark, sf_dir, "stops", "shapes"), folder)
    feed = read_typed_tables(spark, folder)
    return feed["stops"].select(F.lit("stops").alias("kind"), F.col("stop_id").alias("id"), "_row_number").unionByName(feed["shapes"].select(F.lit("shapes").alias("kind"), F.col("shape_id").alias("id"), "_row_number"))


QUERIES["a5_typed_round_trip"] = typed_round_trip
SQL["a5_typed_round_trip"] = with_feed("SELECT 'stops' AS kind, stop_id AS id, _row_number FROM stops UNION ALL SELECT 'shapes', shape_id, _row_number FROM shapes")



def zipped(rows: pd.DataFrame) -> pd.DataFrame:
    """A zip archive for one feed: its stops, and a file that no table has."""
    held = io.BytesIO()
    rows = rows.sort_values("c_custkey")
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("stops.txt", "stop_id,stop_name\r\n" + "".join(f'S{k},"{n}, north"\r\n' for k, n in zip(rows["c_custkey"], rows["c_name"], strict=True)))
        z.writestr("notes.txt", "")
    return pd.DataFrame({"path": [f"store/{rows['feed'].iloc[0]}.zip"], "content": [held.getvalue()]})


def archived_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of archives, one for each thousand keys of customers and each nation."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", F.concat(F.lit("F"), "c_nationkey", F.lit("-"), F.floor(F.col("c_custkey") / 1000)).alias("feed"))
    return files.unpack(rows.groupBy("feed").applyInPandas(zipped, "path string, content binary"))


def archived_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = csvrows.split_rows(archived_lines(spark, sf_dir).where("value is not null"))
    return csvrows.raw_table(rows, "stops").select(F.col("feed_id").alias("feed"), "_row_number", "stop_id", "stop_name")


def archived_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = archived_lines(spark, sf_dir)
    rows = csvrows.split_rows(lines.where("value is not null"))
    headers = rows.select("feed_id", "table", "header").distinct()
    failed = rows.where("_row_number % 7 = 0").select("feed_id", "table", F.lit("UNPARSABLE_ROWS").alias("status"))
    found = files.table_status(listing_of(lines), headers, failed)
    return found.select(F.col("feed_id").alias("feed"), "table", "status")


_ARCHIVED = "f AS (SELECT *, 'F' || c_nationkey || '-' || (c_custkey // 1000) AS feed FROM customer)"
QUERIES["a1_archived_stops"] = archived_stops
SQL["a1_archived_stops"] = f"WITH {_ARCHIVED} SELECT feed, row_number() OVER (PARTITION BY feed ORDER BY c_custkey) + 1 AS _row_number, 'S' || c_custkey AS stop_id, c_name || ', north' AS stop_name FROM f"
QUERIES["b4_table_status"] = archived_status
SQL["b4_table_status"] = f"""WITH {_ARCHIVED}, n AS (SELECT feed, count(*) AS n FROM f GROUP BY 1), t(t) AS (VALUES {', '.join(f"('{n}')" for n in TABLES)})
 SELECT feed, t AS "table", CASE WHEN t <> 'stops' THEN 'MISSING_FILE' WHEN n >= 6 THEN 'UNPARSABLE_ROWS' ELSE 'PARSABLE' END AS status FROM n, t"""

# ---- L: keyed reads

QUERIES["l5_last_stops"] = lambda spark, sf_dir: row_at_max(feed_of(spark, sf_dir, "stop_times")["stop_times"].where("stop_sequence > 2"), "trip_id", F.col("stop_sequence"), ["stop_id", "_row_number"]).drop("feed_id")
SQL["l5_last_stops"] = with_feed("SELECT trip_id, stop_id, _row_number FROM (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY stop_sequence DESC, _row_number) AS i FROM stop_times WHERE stop_sequence > 2) q WHERE i = 1")
QUERIES["l5_counts"] = lambda spark, sf_dir: group_counts(rows_any_set(feed_of(spark, sf_dir, "stop_times")["stop_times"], "arrival_time", "departure_time"), "stop_id").drop("feed_id")
SQL["l5_counts"] = with_feed("SELECT stop_id, count(*) AS n_rows FROM stop_times WHERE arrival_time IS NOT NULL OR departure_time IS NOT NULL GROUP BY 1")

# ---- J: shapes and zones

SQUARES = "select cast(n_nationkey as bigint)+2 as _row_number, cast(n_nationkey as int) as feature_index, concat('Z',n_nationkey) as feature_id, 'Polygon' as geometry_type, concat('[[[',x,',',y,'],[',x+10,',',y,'],[',x+10,',',y+10,'],[',x,',',y+10,']',case when n_nationkey%6=5 then '' else concat(',[',x,',',y,']') end,']]') as coordinates from (select *, cast(n_nationkey%5*8 as int) as x, cast(floor(n_nationkey/5)*8 as int) as y from {t}) q"


def zone_feed(spark: SparkSession, sf_dir: str) -> Feed:
    feed = feed_of(spark, sf_dir, "stop_times", flex=True)
    return Feed(spark, {"stop_times": feed["stop_times"].withColumn("end_pickup_drop_off_window", F.expr("start_pickup_drop_off_window + 3600")).withColumn("location_id", F.expr("concat('Z', _row_number % 13)")), "zones": over("nation", SQUARES)(spark, sf_dir).withColumn("feed_id", F.lit("feed"))})


_BOX, _HOLE = [(0, 0), (8, 0), (8, 8), (0, 8), (0, 0)], [(2, 2), (4, 2), (4, 4), (2, 4), (2, 2)]
#: Geometries by what is wrong with them, around a corner of the zone; the first has nothing.
SHAPES: list[tuple[str | None, str, list]] = [
    (None, "Polygon", [_BOX, _HOLE]), ("self-crossing", "Polygon", [[(0, 0), (8, 8), (8, 0), (0, 8), (0, 0)]]), ("self-touching", "Polygon", [[(0, 0), (8, 0), (4, 4), (8, 8), (0, 8), (4, 4), (0, 0)]]),
    ("hole outside shell", "Polygon", [_BOX, [(x + 7, y + 9) for x, y in _HOLE]]), ("nested holes", "Polygon", [_BOX, [(1, 1), (7, 1), (7, 7), (1, 7), (1, 1)], _HOLE]),
    ("disconnected interior", "Polygon", [_BOX, [(0, 4), (4, 2), (8, 4), (4, 6), (0, 4)]]), ("nested shells", "MultiPolygon", [[_BOX], [_HOLE]]), ("too few points", "Polygon", [[(0, 0), (8, 0), (8, 0), (0, 0)]]),
    ("unclosed ring", "Polygon", [[(0, 0), (8, 0), (8, 8), (0, 8)]]), ("bad coordinates", "Polygon", [[(0, 0), (300, 0), (8, 8), (0, 0)]]), (None, "Polygon", [_BOX, [(0, 4), (4, 2), (4, 6), (0, 4)]]),
    (None, "MultiPolygon", [[_BOX, _HOLE], [[(2.5, 2.5), (3.5, 2.5), (3, 3.5), (2.5, 2.5)]]]), ("self-crossing", "Polygon", [_BOX, [(6, 6), (12, 6), (12, 7), (6, 7), (6, 6)]]), ("self-crossing", "MultiPolygon", [[_BOX], [[(x + 4, y + 4) for x, y in _BOX]]]),
]


def drawn(shape: list) -> str:
    """A shape's coordinates as an expression over the corner (x, y)."""
    if isinstance(shape[0], tuple):
        return "concat('[', " + ", ',', ".join(f"'[', x + {a}, ',', y + {b}, ']'" for a, b in shape) + ", ']')"
    return "concat('[', " + ", ',', ".join(map(drawn, shape)) + ", ']')"


def drawn_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the zones of suppliers, one kind after another, each at its own corner."""
    corner = "s_suppkey, s_suppkey % 17 * 3 as x, s_nationkey * 1.5D + 10 as y"
    cases = " ".join(f"when {i} then {drawn(shape)}" for i, (_, _, shape) in enumerate(SHAPES))
    kinds = " ".join(f"when {i} then '{kind}'" for i, (_, kind, _) in enumerate(SHAPES))
    k = f"cast(s_suppkey % {len(SHAPES)} as int)"
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr(*corner.split(", ")).selectExpr(
        "'feed' as feed_id", "s_suppkey as _row_number", "concat('Z', s_suppkey) as feature_id", "cast(s_suppkey as int) as feature_index", f"case {k} {kinds} end as geometry_type", f"case {k} {cases} end as coordinates")
    return flat(zones.zone_rings(Feed(spark, {"zones": rows})))


QUERIES["j9_zone_faults"] = drawn_zones
SQL["j9_zone_faults"] = "WITH s(k, message) AS (VALUES " + ", ".join(f"({i}, '{fault}')" for i, (fault, _, _) in enumerate(SHAPES) if fault) + f""")
 SELECT 'invalid_geometry' AS code, 'locations.geojson' AS filename, CAST(NULL AS BIGINT) AS row_number, 'featureId=Z' || s_suppkey || ';featureIndex=' || s_suppkey || ';message=' || message AS context FROM supplier JOIN s ON k = s_suppkey % {len(SHAPES)}"""
QUERIES["j9_zone_rings"] = lambda spark, sf_dir: flat(zones.zone_rings(zone_feed(spark, sf_dir)))
SQL["j9_zone_rings"] = "SELECT 'invalid_geometry' AS code, 'locations.geojson' AS filename, CAST(NULL AS BIGINT) AS row_number, 'featureId=Z' || n_nationkey || ';featureIndex=' || n_nationkey || ';message=unclosed ring' AS context FROM nation WHERE n_nationkey % 6 = 5"
QUERIES["j10_zone_window_overlap"] = lambda spark, sf_dir: flat(zones.zone_window_overlap(zone_feed(spark, sf_dir)))
SQL["j10_zone_window_overlap"] = f"""WITH r AS (SELECT trip_id, _row_number AS n, 'Z' || (_row_number % 13) AS z, start_pickup_drop_off_window AS s, start_pickup_drop_off_window + 3600 AS e, coalesce(pickup_type, 0) AS p, coalesce(drop_off_type, 0) AS d FROM ({PROJECTION['flex_stop_times']}) q WHERE start_pickup_drop_off_window IS NOT NULL),
 g AS (SELECT 'Z' || n_nationkey AS z, n_nationkey % 5 * 8 AS x, n_nationkey // 5 * 8 AS y FROM nation WHERE n_nationkey % 6 <> 5)
 SELECT 'overlapping_zone_and_pickup_drop_off_window' AS code, 'stop_times.txt' AS filename, b.n AS row_number, concat_ws(';', 'tripId=' || a.trip_id, 'locationId1=' || a.z, 'locationId2=' || b.z, 'otherRow=' || a.n) AS context
 FROM r a JOIN r b ON a.trip_id = b.trip_id AND (a.s, a.n) < (b.s, b.n) AND b.s < a.e AND a.z <> b.z AND (a.p = b.p OR a.d = b.d) JOIN g ga ON ga.z = a.z JOIN g gb ON gb.z = b.z WHERE abs(ga.x - gb.x) < 10 AND abs(ga.y - gb.y) < 10"""
QUERIES["j8_zone_structure"] = lambda spark, sf_dir: context_text(zones.zone_structure(spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr(*_geojson_columns()))).select(F.col("feed_id").alias("feed"), "code", "context")


def _geojson_columns() -> list[str]:
    texts = [
        '{"type":"FeatureCollection","features":[{"type":"Feature","id":"a","properties":{},"geometry":{"type":"Polygon","coordinates":[]}}]}', '{"type":"Features","features":[],"crs":1}',
        '{"features":[{"type":"Thing","id":"a","properties":{},"geometry":{"type":"Point","coordinates":[]}}]}', '{"type":', '{"type":"FeatureCollection"}', '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{},"x":1}]}',
    ]
    return ["concat('F', n_nationkey) as feed_id", "case n_nationkey % 6 " + " ".join(f"when {i} then '{t}'" for i, t in enumerate(texts)) + " end as value"]


SQL["j8_zone_structure"] = """WITH f AS (SELECT 'F' || n_nationkey AS feed, n_nationkey % 6 AS k FROM nation), p(k, code, context) AS (VALUES (1, 'unsupported_geo_json_type', 'geoJsonType=Features'), (1, 'geo_json_unknown_element', 'unknownElement=crs'), (2, 'missing_required_element', 'missingElement=type'), (2, 'unsupported_feature_type', 'featureIndex=0;featureType=Thing'),
 (2, 'unsupported_geometry_type', 'featureIndex=0;geometryType=Point'), (3, 'malformed_json', ''), (4, 'missing_required_element', 'missingElement=features'), (5, 'missing_required_element', 'featureIndex=0;missingElement=features.id'), (5, 'missing_required_element', 'featureIndex=0;missingElement=features.geometry'), (5, 'geo_json_unknown_element', 'featureIndex=0;unknownElement=x'))
 SELECT feed, code, context FROM f JOIN p USING (k)"""
