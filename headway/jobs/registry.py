"""Registered queries over the projected feed, each with its SQL for another engine."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..feed import Feed
from ..notices import compare, context_text, report, severity_totals
from ..operators import aggregates, calendars, distances, graph, joins, keys, matcher, rowrules, sequences
from .projection import PROJECTION, feed_of, with_feed

#: The date that stands for today; services of the projected feed run around it.
TODAY = datetime.date(1997, 6, 15)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def flat(found: DataFrame) -> DataFrame:
    return context_text(found).select("code", "filename", "row_number", "context")


def register(name: str, check: Callable[[Feed], DataFrame], sql: str, flex: bool = False, *tables: str) -> None:
    """A query that gives check's notices; sql selects code, filename, row_number and context."""
    QUERIES[name] = lambda spark, sf_dir: flat(check(feed_of(spark, sf_dir, *tables, flex=flex)))
    SQL[name] = with_feed(sql, flex)


def register_table(name: str, table: Callable[[Feed], DataFrame], sql: str, flex: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = table(feed_of(spark, sf_dir, flex=flex)).drop("feed_id")
        return found.withColumns({c: F.col(c).cast("string") for c, kind in found.dtypes if kind == "date"})

    QUERIES[name] = run
    SQL[name] = with_feed(sql, flex)


def sel(code: str, file: str, row: str = "_row_number", **context: str) -> str:
    text = ", ".join(f"'{k}=' || ({v})" for k, v in context.items())
    return f"SELECT '{code}' AS code, '{file}.txt' AS filename, CAST({row} AS BIGINT) AS row_number, {f'concat_ws({chr(39)};{chr(39)}, {text})' if text else chr(39) * 2} AS context"


def all_of(*parts: str) -> str:
    return " UNION ALL ".join(parts)


# ---- D: keys and references

REFERENCES_SQL = [
    ("routes", "agency_id", ["agency.agency_id"]), ("fare_attributes", "agency_id", ["agency.agency_id"]), ("attributions", "agency_id", ["agency.agency_id"]), ("stops", "parent_station", ["stops.stop_id"]),
    ("stops", "level_id", []), ("trips", "route_id", ["routes.route_id"]), ("trips", "shape_id", ["*shapes.shape_id"]), ("trips", "service_id", ["calendar.service_id", "*calendar_dates.service_id"]),
    ("stop_times", "trip_id", ["trips.trip_id"]), ("stop_times", "stop_id", ["stops.stop_id"]), ("frequencies", "trip_id", ["trips.trip_id"]), ("transfers", "from_stop_id", ["stops.stop_id"]), ("transfers", "to_stop_id", ["stops.stop_id"]),
    ("transfers", "from_route_id", ["routes.route_id"]), ("transfers", "to_route_id", ["routes.route_id"]), ("transfers", "from_trip_id", ["trips.trip_id"]), ("transfers", "to_trip_id", ["trips.trip_id"]), ("pathways", "from_stop_id", ["stops.stop_id"]),
    ("pathways", "to_stop_id", ["stops.stop_id"]), ("fare_rules", "fare_id", ["fare_attributes.fare_id"]), ("fare_rules", "route_id", ["routes.route_id"]), ("fare_rules", "origin_id", ["*stops.zone_id"]),
    ("fare_products", "rider_category_id", ["rider_categories.rider_category_id"]), ("fare_products", "fare_media_id", ["fare_media.fare_media_id"]), ("fare_transfer_rules", "from_leg_group_id", []), ("fare_transfer_rules", "to_leg_group_id", []),
    ("fare_leg_join_rules", "from_network_id", ["networks.network_id"]), ("fare_leg_join_rules", "to_network_id", ["networks.network_id"]), ("fare_leg_join_rules", "from_stop_id", ["stops.stop_id"]), ("fare_leg_join_rules", "to_stop_id", ["stops.stop_id"]),
    ("timeframes", "service_id", ["calendar.service_id", "*calendar_dates.service_id"]), ("location_group_stops", "location_group_id", ["location_groups.location_group_id"]), ("location_group_stops", "stop_id", ["stops.stop_id"]),
]
PARENT_FILES = {"level_id": "levels.txt", "from_leg_group_id": "fare_leg_rules.txt", "to_leg_group_id": "fare_leg_rules.txt", "from_network_id": "networks.txt or routes.txt", "to_network_id": "networks.txt or routes.txt"}


def reference_sql(child: str, column: str, parents: list[str]) -> str:
    files = PARENT_FILES.get(column) or " or ".join(f"{p.strip('*').split('.')[0]}.txt" for p in parents)
    # the network id of routes is not declared: every route counts as one with an empty id
    known = [f"SELECT {'coalesce(' + p.split('.')[1] + chr(44) + chr(39) * 2 + ')' if p[0] == '*' else p.split('.')[1]} AS v FROM {p.strip('*').split('.')[0]}" for p in parents]
    known += ["SELECT '' AS v FROM routes"] if "network_id" in column else []
    where = f" AND NOT EXISTS (SELECT 1 FROM ({' UNION ALL '.join(known)}) p WHERE p.v = c.{column})" if known else ""
    return sel("foreign_key_violation", child, childFieldName=f"'{column}'", parentFilename=f"'{files}'", fieldValue=column) + f" FROM {child} c WHERE {column} IS NOT NULL{where}"


FOREIGN_SQL = all_of(*(reference_sql(*r) for r in REFERENCES_SQL))
register("d3_foreign_keys", keys.foreign_key_violation, FOREIGN_SQL)

QUERIES["d3_foreign_key_report"] = lambda spark, sf_dir: report(keys.foreign_key_violation(feed_of(spark, sf_dir)), 5).select(
    "code", "severity", "totalNotices", F.array_join(F.transform("sampleNotices", lambda m: F.concat_ws("/", m["childFieldName"], m["fieldValue"])), ";").alias("samples")
)
SQL["d3_foreign_key_report"] = with_feed(f"""
SELECT code, 'ERROR' AS severity, count(*) AS "totalNotices", string_agg(regexp_extract(context, 'childFieldName=([^;]*)', 1) || '/' || regexp_extract(context, 'fieldValue=(.*)$', 1), ';' ORDER BY k) FILTER (k <= 5) AS samples
FROM (SELECT *, row_number() OVER (ORDER BY filename, row_number, context) AS k FROM ({FOREIGN_SQL}) f) g GROUP BY code""")


def duplicate_sql(table: str, key: dict[str, str]) -> str:
    """key: column -> text with nulls replaced."""
    parts = ", ".join(key.values())
    names = "concat_ws(',', " + ", ".join(f"CASE WHEN {k} IS NOT NULL THEN '{k}' END" for k in key) + ")"
    clock = lambda k: f"lpad(CAST({k} // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST({k} // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({k} % 60 AS VARCHAR), 2, '0')"
    values = "concat_ws(',', " + ", ".join(clock(k) if k.endswith("_time") else f"CAST({k} AS VARCHAR)" for k in key) + ")"
    return sel("duplicate_key", table, oldCsvRowNumber="o", fieldName="n", fieldValue="v") + f" FROM (SELECT _row_number, first_value(_row_number) OVER w AS o, first_value({names}) OVER w AS n, first_value({values}) OVER w AS v FROM {table} WINDOW w AS (PARTITION BY {parts} ORDER BY _row_number)) q WHERE _row_number > o"


DUPLICATES = {
    "stop_times": {"trip_id": "coalesce(trip_id, '')", "stop_sequence": "coalesce(stop_sequence, 0)"}, "shapes": {"shape_id": "coalesce(shape_id, '')", "shape_pt_sequence": "coalesce(shape_pt_sequence, 0)"},
    "frequencies": {"trip_id": "coalesce(trip_id, '')", "start_time": "coalesce(start_time, 0)"}, "calendar_dates": {"service_id": "coalesce(service_id, '')", "date": "date"},
}
for _t, _k in DUPLICATES.items():
    register(f"d1_duplicate_key_{_t}", lambda feed, t=_t: keys.duplicate_key(feed, t), duplicate_sql(_t, _k), False, _t)
register("d2_single_row_tables", keys.single_row_tables, sel("more_than_one_entity", "feed_info", "NULL", rowCount="n") + " FROM (SELECT count(*) AS n FROM feed_info) q WHERE n > 1")
register("d4_duplicate_geography_id", keys.duplicate_geography_id, sel("duplicate_geography_id", "stops", "NULL", geographyId="id", stopRow="a", groupRow="b", zoneRow="c") + """
 FROM (SELECT id, min(CASE WHEN s = 0 THEN n END) AS a, min(CASE WHEN s = 1 THEN n END) AS b, min(CASE WHEN s = 2 THEN n END) AS c, count(DISTINCT s) AS k FROM (
 SELECT stop_id AS id, 0 AS s, _row_number AS n FROM stops UNION ALL SELECT location_group_id, 1, _row_number FROM location_groups UNION ALL SELECT feature_id, 2, _row_number FROM zones) u GROUP BY id) q WHERE k > 1""")
register("d5_duplicate_zone_key", keys.duplicate_zone_key, sel("duplicate_geo_json_key", "locations", "NULL", featureId="feature_id", firstIndex="f", secondIndex="feature_index").replace("locations.txt", "locations.geojson") + " FROM (SELECT *, min(feature_index) OVER (PARTITION BY feature_id) AS f FROM zones) q WHERE feature_index > f")
register("d6_duplicate_names", keys.duplicate_names, all_of(
    sel("duplicate_route_name", "routes", routeId="route_id", firstRow="o") + " FROM (SELECT *, min(_row_number) OVER (PARTITION BY coalesce(route_long_name, ''), coalesce(route_short_name, ''), route_type, coalesce(agency_id, '')) AS o FROM routes) q WHERE _row_number > o",
    sel("duplicate_fare_media", "fare_media", fareMediaId="fare_media_id", firstRow="o") + " FROM (SELECT *, min(_row_number) OVER (PARTITION BY coalesce(fare_media_name, ''), fare_media_type) AS o FROM fare_media) q WHERE _row_number > o",
))
_KNOWN = "('agency','attributions','booking_rules','calendar','calendar_dates','fare_attributes','fare_leg_join_rules','fare_media','fare_products','fare_rules','fare_transfer_rules','feed_info','frequencies','location_group_stops','location_groups','networks','pathways','rider_categories','routes','shapes','stop_times','stops','timeframes','transfers','translations','trips')"
_T = "FROM (SELECT t.*, table_name IN ('routes', 'stop_times', 'stops') AS w1, table_name = 'stop_times' AS w2, field_value IS NULL AND table_name <> 'ghosts' AS r FROM translations t) q WHERE"
register("d7_translation_references", keys.translation_references, all_of(
    sel("translation_unknown_table_name", "translations", tableName="table_name") + f" FROM translations WHERE table_name NOT IN {_KNOWN}",
    *(sel("translation_unexpected_value", "translations", fieldName=f"'{c}'") + f" FROM translations WHERE field_value IS NOT NULL AND {c} IS NOT NULL" for c in ("record_id", "record_sub_id")),
    sel("missing_required_field", "translations", fieldName="'record_id'") + f" {_T} r AND w1 AND record_id IS NULL",
    sel("missing_required_field", "translations", fieldName="'record_sub_id'") + f" {_T} r AND w2 AND record_sub_id IS NULL",
    sel("translation_unexpected_value", "translations", fieldName="'record_id'") + f" {_T} r AND NOT w1 AND record_id IS NOT NULL",
    sel("translation_unexpected_value", "translations", fieldName="'record_sub_id'") + f" {_T} r AND NOT w2 AND record_sub_id IS NOT NULL",
    sel("translation_foreign_key_violation", "translations", tableName="table_name", recordId="record_id", recordSubId="record_sub_id") + f""" {_T} r AND w1 = (record_id IS NOT NULL) AND w2 = (record_sub_id IS NOT NULL) AND
 CASE table_name WHEN 'routes' THEN record_id NOT IN (SELECT route_id FROM routes) WHEN 'stops' THEN record_id NOT IN (SELECT stop_id FROM stops) WHEN 'stop_times' THEN NOT EXISTS (SELECT 1 FROM stop_times s WHERE s.trip_id = record_id AND CAST(s.stop_sequence AS VARCHAR) = record_sub_id) ELSE false END""",
))
register("d8_rows_missing_agency", keys.rows_missing_agency, all_of(*(sel("missing_required_agency_id", t) + f" FROM {t} WHERE agency_id IS NULL AND (SELECT count(*) FROM agency) > 1" for t in ("agency", "routes", "fare_attributes"))))
register("d9_network_files_conflict", lambda f: keys.network_files_conflict(Feed(f.spark, f.tables | {"routes": f.tables["routes"].withColumn("network_id", F.lit("NW1"))})), "SELECT 'route_networks_specified_in_more_than_one_file' AS code, 'routes.txt' AS filename, CAST(NULL AS BIGINT) AS row_number, 'fileNames=networks.txt' AS context FROM networks HAVING count(*) > 0")

# ---- E: row rules, by table


def projected_columns(name: str) -> list[str]:
    import re

    return re.findall(r" as (\w+)(?=,| from)", PROJECTION[name])


for _flex in (False, True):
    _tables = [n for n in PROJECTION if not n.startswith("flex_")]
    _columns = {n: projected_columns("flex_stop_times" if _flex and n == "stop_times" else n) for n in _tables}
    for _t in ("stop_times",) if _flex else dict.fromkeys(r.table for r in rowrules.RULES):
        _rules = [r for r in rowrules.RULES if r.table == _t]
        _sql = rowrules.oracle(_rules, _columns, set(_tables)) if _t in _columns else ""
        if _sql:
            register(f"e_rows_{'flex_' if _flex else ''}{_t}", lambda feed, rules=_rules: rowrules.row_notices(feed, rules), _sql, _flex)

# ---- F: joins

register("f1_usage", joins.usage, all_of(
    sel("unused_trip", "trips", tripId="trip_id") + " FROM trips t WHERE NOT EXISTS (SELECT 1 FROM stop_times s WHERE s.trip_id = t.trip_id)",
    sel("unusable_trip", "trips", tripId="trip_id") + " FROM trips t LEFT JOIN (SELECT trip_id AS i, count(*) AS n FROM stop_times GROUP BY 1) c ON i = trip_id WHERE coalesce(n, 0) < 2",
    sel("unused_shape", "shapes", "n", shapeId="shape_id") + " FROM (SELECT shape_id, min(_row_number) AS n FROM shapes GROUP BY 1) h WHERE shape_id NOT IN (SELECT shape_id FROM trips WHERE shape_id IS NOT NULL)",
    sel("unused_station", "stops", stopId="stop_id") + " FROM stops WHERE location_type = 1 AND stop_id NOT IN (SELECT parent_station FROM stops WHERE location_type = 0 AND parent_station IS NOT NULL)",
))
for _flex in (False, True):
    _group = " UNION ALL SELECT g.stop_id, s._row_number FROM stop_times s JOIN location_group_stops g USING (location_group_id)" if _flex else ""
    register(f"f2_stop_usage{'_flex' if _flex else ''}", joins.stop_usage, f"WITH u AS (SELECT stop_id, min(_row_number) AS n FROM (SELECT stop_id, _row_number FROM stop_times{_group}) x WHERE stop_id IS NOT NULL GROUP BY 1) " + all_of(
        sel("stop_without_stop_time", "stops", stopId="stop_id") + " FROM stops WHERE location_type = 0 AND stop_id NOT IN (SELECT stop_id FROM u)",
        sel("location_with_unexpected_stop_time", "stops", stopId="s.stop_id", stopTimeRow="n") + " FROM stops s JOIN u USING (stop_id) WHERE location_type <> 0",
    ), _flex)
register("f3_parent_type", joins.parent_type, sel("wrong_parent_location_type", "stops", "s._row_number", stopId="s.stop_id", locationType="s.location_type", parentStation="s.parent_station", parentLocationType="p.location_type") + " FROM stops s JOIN stops p ON p.stop_id = s.parent_station WHERE s.location_type IN (0, 2, 3) AND p.location_type <> 1 OR s.location_type = 4 AND p.location_type <> 0")
_SIDES = "(SELECT *, 'from_stop_id' AS field, from_stop_id AS sid, to_stop_id AS other FROM pathways UNION ALL SELECT *, 'to_stop_id', to_stop_id, from_stop_id FROM pathways)"
_SIDE = {"pathwayId": "pathway_id", "fieldName": "field", "stopId": "sid"}
register("f4_pathway_ends", joins.pathway_ends, all_of(
    sel("pathway_to_wrong_location_type", "pathways", "e._row_number", **_SIDE) + f" FROM {_SIDES} e JOIN stops s ON s.stop_id = sid WHERE s.location_type = 1",
    sel("pathway_to_platform_with_boarding_areas", "pathways", "e._row_number", **_SIDE) + f" FROM {_SIDES} e JOIN stops s ON s.stop_id = sid WHERE s.location_type = 0 AND sid IN (SELECT parent_station FROM stops WHERE location_type = 4)",
))
register("f5_dangling_node", joins.dangling_node, sel("pathway_dangling_generic_node", "stops", stopId="stop_id", parentStation="parent_station") + f" FROM stops WHERE location_type = 3 AND stop_id IN (SELECT sid FROM {_SIDES} e GROUP BY sid HAVING count(DISTINCT coalesce(other, '')) = 1)")
register("f6_elevator_levels", joins.elevator_levels, sel("missing_level_id", "stops", stopId="stop_id") + f" FROM stops WHERE level_id IS NULL AND stop_id IN (SELECT sid FROM {_SIDES} e WHERE pathway_mode = 5)")
register("f7_url_reuse", joins.url_reuse, sel("same_route_and_agency_url", "routes", "r._row_number", url="lower(route_url)", otherRow="a._row_number") + " FROM routes r JOIN agency a ON lower(route_url) = lower(agency_url)")
register("f8_ferry_bikes", joins.ferry_bikes, sel("missing_bike_allowance", "trips", routeId="route_id", tripId="trip_id") + " FROM trips WHERE (bikes_allowed IS NULL OR bikes_allowed IN (0, -1)) AND route_id IN (SELECT route_id FROM routes WHERE route_type = 4)")
_ENDS = "(SELECT _row_number, transfer_type, 'from' AS side, from_stop_id AS sid, from_trip_id AS tid, from_route_id AS rid FROM transfers UNION ALL SELECT _row_number, transfer_type, 'to', to_stop_id, to_trip_id, to_route_id FROM transfers)"
register("f9_transfer_stop_types", joins.transfer_stop_types, sel("transfer_with_invalid_stop_location_type", "transfers", "e._row_number", stopIdFieldName="side || '_stop_id'", stopId="sid", locationType="location_type") + f" FROM {_ENDS} e JOIN stops s ON s.stop_id = sid WHERE location_type NOT IN (0, 1) OR location_type = 1 AND transfer_type IN (4, 5)")
register("f10_transfer_trips", joins.transfer_trips, f"WITH served AS (SELECT stop_id AS sid, stop_id AS s FROM stops WHERE location_type = 0 UNION ALL SELECT p.stop_id, c.stop_id FROM stops p JOIN stops c ON c.parent_station = p.stop_id WHERE p.location_type = 1) " + all_of(
    sel("transfer_with_invalid_trip_and_route", "transfers", "e._row_number", tripFieldName="side || '_trip_id'", tripId="tid", routeId="rid", expectedRouteId="route_id") + f" FROM {_ENDS} e JOIN trips t ON t.trip_id = tid WHERE rid <> route_id",
    sel("transfer_with_invalid_trip_and_stop", "transfers", "e._row_number", tripFieldName="side || '_trip_id'", tripId="tid", stopId="e.sid") + f" FROM {_ENDS} e JOIN trips t ON t.trip_id = tid JOIN stops x ON x.stop_id = e.sid WHERE location_type IN (0, 1) AND NOT EXISTS (SELECT 1 FROM served v JOIN stop_times st ON st.stop_id = v.s WHERE v.sid = e.sid AND st.trip_id = e.tid)",
))
_EDGES = "v AS (SELECT trip_id, first_value(stop_id) OVER w AS f, last_value(stop_id) OVER w AS l, stop_id FROM stop_times WINDOW w AS (PARTITION BY trip_id ORDER BY coalesce(stop_sequence, 0), _row_number ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
register("f11_in_seat_ends", joins.in_seat_ends, f"WITH {_EDGES} " + all_of(
    sel("transfer_with_suspicious_mid_trip_in_seat", "transfers", tripIdFieldName="side || '_trip_id'", tripId="tid", stopId="sid") + f" FROM {_ENDS} e WHERE transfer_type IN (4, 5) AND sid IN (SELECT stop_id FROM stops) AND EXISTS (SELECT 1 FROM v WHERE v.trip_id = tid AND v.stop_id = sid AND (CASE side WHEN 'from' THEN l ELSE f END IS DISTINCT FROM sid))",
    sel("inconsistent_route_type_for_in_seat_transfer", "transfers", "x._row_number", fromTripId="from_trip_id", toTripId="to_trip_id", fromRouteType="ra.route_type", toRouteType="rb.route_type") + " FROM transfers x JOIN trips a ON a.trip_id = from_trip_id JOIN trips b ON b.trip_id = to_trip_id JOIN routes ra ON ra.route_id = a.route_id JOIN routes rb ON rb.route_id = b.route_id WHERE transfer_type = 4 AND ra.route_type <> rb.route_type",
))
register("f12_continuous_service", joins.continuous_service, sel("forbidden_continuous_pickup_drop_off", "stop_times", "s._row_number", tripId="s.trip_id", tripRow="t._row_number") + " FROM stop_times s JOIN trips t ON t.trip_id = s.trip_id JOIN routes r ON r.route_id = t.route_id WHERE continuous_pickup IN (0, 2, 3) AND (start_pickup_drop_off_window IS NOT NULL OR end_pickup_drop_off_window IS NOT NULL)", True)
register("f13_zone_fares", joins.zone_fares, sel("stop_without_zone_id", "stops", stopId="stop_id") + " FROM stops WHERE location_type = 0 AND zone_id IS NULL AND stop_id IN (SELECT s.stop_id FROM stop_times s JOIN trips t ON t.trip_id = s.trip_id WHERE coalesce(t.route_id, '') IN (SELECT coalesce(route_id, '') FROM fare_rules WHERE origin_id IS NOT NULL))")
register("f14_agency_consistency", joins.agency_consistency, all_of(
    sel("inconsistent_agency_timezone", "agency", expected="f", actual="agency_timezone") + " FROM (SELECT *, first_value(agency_timezone) OVER (ORDER BY _row_number) AS f FROM agency) q WHERE agency_timezone <> f",
    sel("inconsistent_agency_lang", "agency", expected="f", actual="agency_lang") + " FROM agency, (SELECT arg_min(agency_lang, _row_number) AS f FROM agency WHERE agency_lang IS NOT NULL) q WHERE agency_lang <> f",
    sel("feed_info_lang_and_agency_lang_mismatch", "agency", feedInfoLang="f", agencyLang="agency_lang") + " FROM agency, (SELECT arg_min(feed_lang, _row_number) AS f FROM feed_info) q WHERE agency_lang <> f AND f <> 'mul'",
))
register("f15_default_riders", joins.default_riders, "WITH u AS (SELECT fare_product_id, rider_category_id, min(p._row_number) AS n FROM fare_products p JOIN rider_categories r USING (rider_category_id) WHERE is_default_fare_category = 1 GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY fare_product_id ORDER BY n) AS i FROM u) " + sel("fare_product_with_multiple_default_rider_categories", "fare_products", "b.n", fareProductId="a.fare_product_id", firstRow="a.n", riderCategoryId1="a.rider_category_id", riderCategoryId2="b.rider_category_id") + " FROM k a JOIN k b USING (fare_product_id) WHERE a.i = 1 AND b.i = 2")

# ---- G: aggregates

register_table("g1_summary_counts", aggregates.summary_counts, all_of(*(f"SELECT '{c}' AS kind, count(DISTINCT {c}) AS n FROM {t} WHERE coalesce({c}, '') <> ''" for t, c in aggregates.COUNTED)))
_DATES = f"""weekly AS (SELECT DISTINCT service_id, CAST(d AS DATE) AS date FROM (SELECT *, unnest(generate_series(CAST(start_date AS TIMESTAMP), CAST(end_date AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM calendar) c
 WHERE CASE isodow(d) WHEN 1 THEN monday WHEN 2 THEN tuesday WHEN 3 THEN wednesday WHEN 4 THEN thursday WHEN 5 THEN friday WHEN 6 THEN saturday ELSE sunday END % 2 = 1)"""
_ACTIVE = f"{_DATES}, active AS (SELECT service_id, date FROM weekly UNION SELECT service_id, date FROM calendar_dates WHERE exception_type = 1 EXCEPT SELECT service_id, date FROM calendar_dates WHERE exception_type = 2)"
_RUNS = f"""{_DATES}, lastx AS (SELECT service_id, date, arg_max(exception_type, _row_number) AS k FROM calendar_dates GROUP BY 1, 2),
 served AS (SELECT service_id, date FROM weekly WHERE (service_id, date) NOT IN (SELECT service_id, date FROM lastx) UNION ALL SELECT service_id, date FROM lastx WHERE k = 1),
 runs AS (SELECT service_id, min(date) AS f, max(date) AS l FROM (SELECT *, date - CAST(row_number() OVER (PARTITION BY service_id ORDER BY date) AS INTEGER) AS g FROM served) q GROUP BY service_id, g)"""
_FILES = ",".join(sorted(f"{n}.txt" if n != "zones" else "locations.geojson" for n in PROJECTION if not n.startswith("flex_")))
register_table("g2_feed_summary", aggregates.feed_summary, f"WITH {_RUNS} SELECT (SELECT string_agg(agency_name, ', ' ORDER BY _row_number) FROM agency) AS agencies, (SELECT string_agg(concat(coalesce(agency_name, ''), '|', coalesce(agency_url, ''), '|||', coalesce(agency_timezone, '')), '; ' ORDER BY _row_number) FROM agency) AS agency_details, arg_min(feed_publisher_name, _row_number) AS feed_publisher_name, CAST(NULL AS VARCHAR) AS feed_publisher_url, arg_min(feed_contact_email, _row_number) AS feed_contact_email, '{_FILES}' AS files, arg_min(feed_lang, _row_number) AS feed_lang, CAST(arg_min(feed_start_date, _row_number) AS VARCHAR) AS feed_start_date, CAST(arg_min(feed_end_date, _row_number) AS VARCHAR) AS feed_end_date, CAST((SELECT min(f) FROM runs WHERE service_id IN (SELECT service_id FROM trips)) AS VARCHAR) AS service_start, CAST((SELECT max(l) FROM runs WHERE service_id IN (SELECT service_id FROM trips)) AS VARCHAR) AS service_end FROM feed_info")


def feature_sql(flex: bool) -> str:
    """What each feature asks of the projected tables; columns that these don't have can't show one."""
    asked = {
        "Pathway Connections": "FROM pathways", "Transfers": "FROM transfers", "Shapes": "FROM shapes", "Frequencies": "FROM frequencies", "Feed Information": "FROM feed_info",
        "Attributions": "FROM attributions", "Translations": "FROM translations", "Fares V1": "FROM fare_attributes", "Fare Products": "FROM fare_products",
        "Fare Transfers": "FROM fare_transfer_rules", "Booking Rules": "FROM booking_rules", "Route Colors": "FROM routes WHERE route_color IS NOT NULL OR route_text_color IS NOT NULL",
        "Headsigns": "FROM trips WHERE trip_headsign IS NOT NULL", "Bike Allowed": "FROM trips WHERE bikes_allowed IS NOT NULL", "Location Types": "FROM stops WHERE location_type IS NOT NULL",
        "Continuous Stops": "FROM routes WHERE continuous_pickup IS NOT NULL", "Fare Media": "FROM fare_products p CROSS JOIN fare_media WHERE p.fare_media_id IS NOT NULL",
        "Rider Categories": "FROM fare_products p CROSS JOIN rider_categories WHERE p.rider_category_id IS NOT NULL",
    }
    if flex:
        asked |= {
            "Zone-Based Demand Responsive Services": "FROM stop_times WHERE trip_id IS NOT NULL AND location_id IS NOT NULL AND stop_id IS NULL",
            "Fixed-Stops Demand Responsive Transit": "FROM stop_times s CROSS JOIN location_groups WHERE trip_id IS NOT NULL AND s.location_group_id IS NOT NULL AND stop_id IS NULL",
            "Predefined Routes with Deviation": "FROM (SELECT trip_id FROM stop_times GROUP BY 1 HAVING count(location_id) > 0 AND count(stop_id) > 0 AND count(arrival_time) > 0 AND count(departure_time) > 0) q",
        }
    return all_of(*(f"SELECT '{name}' AS feature WHERE EXISTS (SELECT 1 {where})" for name, where in asked.items()))


for _flex in (False, True):
    register_table(f"g3_feature_flags{'_flex' if _flex else ''}", aggregates.feature_flags, feature_sql(_flex), _flex)
register_table("g4_deviated_routes", aggregates.deviated_routes, "SELECT count(*) AS n_trips FROM (SELECT trip_id FROM stop_times GROUP BY 1 HAVING count(location_id) > 0 AND count(stop_id) > 0 AND count(arrival_time) > 0 AND count(departure_time) > 0) q HAVING count(*) > 0", True)
register("g5_block_route_types", aggregates.block_route_types, "WITH u AS (SELECT block_id, t.route_id, route_type, min(t._row_number) AS n FROM trips t JOIN routes r ON r.route_id = t.route_id WHERE block_id IS NOT NULL GROUP BY 1, 2, 3), y AS (SELECT block_id, route_type, min(n) AS n FROM u GROUP BY 1, 2) " + sel("inconsistent_route_type_for_block_id", "trips", "NULL", blockId="block_id", routeIds="a", routeTypes="b") + " FROM (SELECT block_id, string_agg(CAST(route_type AS VARCHAR), ',' ORDER BY n) AS b FROM y GROUP BY 1 HAVING count(*) > 1) p JOIN (SELECT block_id, string_agg(route_id, ',' ORDER BY n) AS a FROM u GROUP BY 1) q USING (block_id)")
register("g6_single_points", aggregates.single_points, sel("single_shape_point", "shapes", "min(_row_number)", shapeId="shape_id") + " FROM shapes GROUP BY shape_id HAVING count(*) = 1")
#: Trips of a few rows each, all on request.
_ON_REQUEST = {"trip_id": "concat(trip_id, '-', floor(_row_number / 3))", "pickup_type": "2", "drop_off_type": "2"}
register("g7_lone_flex_stop", lambda f: aggregates.lone_flex_stop(Feed(f.spark, {"stop_times": f["stop_times"].withColumns({k: F.expr(v) for k, v in _ON_REQUEST.items()})})), sel("missing_stop_times_record", "stop_times", "min(_row_number)", tripId="t") + " FROM (SELECT *, trip_id || '-' || CAST(floor(_row_number / 3) AS BIGINT) AS t FROM stop_times) q GROUP BY t HAVING count(*) = 1 AND bool_and(start_pickup_drop_off_window IS NOT NULL AND end_pickup_drop_off_window IS NOT NULL)", True)
register("g8_shape_distance_gaps", aggregates.shape_distance_gaps, sel("trip_with_shape_dist_traveled_but_no_shape_distances", "trips", "t._row_number", tripId="t.trip_id", shapeId="shape_id", stopTimeRow="n") + " FROM trips t JOIN (SELECT trip_id, arg_min(_row_number, coalesce(stop_sequence, 0) * 1000000000000 + _row_number) AS n FROM stop_times WHERE shape_dist_traveled IS NOT NULL GROUP BY 1) s USING (trip_id) WHERE shape_id IN (SELECT shape_id FROM shapes WHERE shape_dist_traveled IS NULL)")
register("g9_notices_by_severity", lambda f: severity_totals(keys.foreign_key_violation(f).unionByName(joins.usage(f))).select(F.lit("").alias("feed_id"), F.coalesce("code", F.lit("all")).alias("code"), "severity", F.lit("").alias("filename"), F.col("n_notices").alias("row_number"), F.create_map(F.lit("severity"), F.coalesce("severity", F.lit("all"))).alias("context")), f"SELECT coalesce(code, 'all') AS code, '' AS filename, count(*) AS row_number, 'severity=' || coalesce(severity, 'all') AS context FROM (SELECT code, CASE code WHEN 'foreign_key_violation' THEN 'ERROR' WHEN 'unused_station' THEN 'INFO' ELSE 'WARNING' END AS severity FROM ({FOREIGN_SQL} UNION ALL {SQL['f1_usage'][SQL['f1_usage'].index('SELECT ' + chr(39) + 'unused_trip'):]}) q) z GROUP BY ROLLUP (severity, code)")
register_table("g10_compare_reports", lambda f: compare(keys.foreign_key_violation(f), keys.foreign_key_violation(Feed(f.spark, f.tables | {"stops": f.tables["stops"].where("stop_id <> 'P5'")}))), f"WITH a AS ({FOREIGN_SQL}), b AS ({FOREIGN_SQL.replace('FROM stops)', 'FROM stops WHERE stop_id <> ' + chr(39) + 'P5' + chr(39) + ')').replace('FROM stops c WHERE', 'FROM stops c WHERE stop_id <> ' + chr(39) + 'P5' + chr(39) + ' AND')}) SELECT 'foreign_key_violation' AS code, (SELECT count(*) FROM a) AS n_before, (SELECT count(*) FROM b) AS n_after, (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) x) AS only_before, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) x) AS only_after")

# ---- H: sequences

_BY = "PARTITION BY trip_id ORDER BY coalesce(stop_sequence, 0), _row_number"
register("h1_unsorted_stop_times", sequences.unsorted_stop_times, sel("unsorted_stop_times", "stop_times", "min(_row_number)", tripId="trip_id") + " FROM (SELECT *, stop_sequence <= lag(stop_sequence) OVER (PARTITION BY trip_id ORDER BY _row_number) AS falls FROM stop_times) q GROUP BY trip_id HAVING coalesce(bool_or(falls), false) OR max(_row_number) - min(_row_number) + 1 > count(*)")
register("h2_stop_time_times", sequences.stop_time_times, all_of(
    sel("stop_time_with_only_arrival_or_departure_time", "stop_times", tripId="trip_id", stopSequence="stop_sequence") + " FROM stop_times WHERE (arrival_time IS NULL) <> (departure_time IS NULL)",
    sel("stop_time_with_arrival_before_previous_departure_time", "stop_times", tripId="trip_id", stopSequence="stop_sequence", previousRow="p") + " FROM (SELECT *, last_value(departure_time IGNORE NULLS) OVER w AS e, last_value(CASE WHEN departure_time IS NOT NULL THEN _row_number END IGNORE NULLS) OVER w AS p FROM stop_times WINDOW w AS (PARTITION BY trip_id ORDER BY stop_sequence, _row_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) q WHERE arrival_time < e",
))
register("h3_trip_edges", sequences.trip_edges, f"WITH q AS (SELECT *, row_number() OVER ({_BY}) AS i, row_number() OVER (PARTITION BY trip_id ORDER BY coalesce(stop_sequence, 0) DESC, _row_number DESC) AS j FROM stop_times) " + all_of(*(sel("missing_trip_edge", "stop_times", tripId="trip_id", stopSequence="stop_sequence", specifiedField=f"'{c}'", edge=f"'{e}'") + f" FROM q WHERE {k} = 1 AND {c} IS NULL" for k, e in (("i", "first"), ("j", "last")) for c in ("arrival_time", "departure_time"))))
register("h4_stop_time_distance", sequences.stop_time_distance, sel("decreasing_or_equal_stop_time_distance", "stop_times", tripId="trip_id", stopSequence="stop_sequence", previousRow="p") + f" FROM (SELECT *, lag(shape_dist_traveled) OVER ({_BY}) AS b, lag(_row_number) OVER ({_BY}) AS p FROM stop_times WHERE stop_id IS NOT NULL) q WHERE shape_dist_traveled <= b")


def haversine_sql(a: str, b: str, c: str, d: str) -> str:
    h = f"pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2)"
    return f"2 * 6371010.0 * asin(sqrt(CASE WHEN {h} > 1 THEN 1.0 ELSE {h} END))"


_H = "PARTITION BY shape_id ORDER BY shape_pt_sequence, _row_number"
register("h5_shape_distance", sequences.shape_distance, f"SELECT code, 'shapes.txt' AS filename, _row_number AS row_number, concat_ws(';', 'shapeId=' || shape_id, 'shapePtSequence=' || shape_pt_sequence, 'previousRow=' || p) AS context FROM (SELECT *, CASE WHEN shape_dist_traveled < d THEN 'decreasing_shape_distance' WHEN shape_dist_traveled <> d OR shape_dist_traveled IS NULL OR d IS NULL THEN NULL WHEN shape_pt_lat = la AND shape_pt_lon = lo THEN 'equal_shape_distance_same_coordinates' WHEN m >= 1.11 THEN 'equal_shape_distance_diff_coordinates' WHEN m > 0 THEN 'equal_shape_distance_diff_coordinates_distance_below_threshold' END AS code FROM (SELECT *, {haversine_sql('la', 'lo', 'shape_pt_lat', 'shape_pt_lon')} AS m FROM (SELECT *, lag(shape_pt_lat) OVER w AS la, lag(shape_pt_lon) OVER w AS lo, lag(shape_dist_traveled) OVER w AS d, lag(_row_number) OVER w AS p FROM shapes WINDOW w AS ({_H})) a) b) c WHERE code IS NOT NULL")
register("h6_adjacent_overlap", sequences.adjacent_overlap, all_of(
    sel("overlapping_frequency", "frequencies", tripId="trip_id", previousRow="p") + " FROM (SELECT *, lag(end_time) OVER w AS e, lag(_row_number) OVER w AS p FROM frequencies WINDOW w AS (PARTITION BY trip_id ORDER BY start_time, end_time, headway_secs, _row_number)) q WHERE start_time < e",
    sel("timeframe_overlap", "timeframes", timeframeGroupId="timeframe_group_id", serviceId="service_id", previousRow="p") + " FROM (SELECT *, lag(e0) OVER w AS e, lag(_row_number) OVER w AS p FROM (SELECT *, coalesce(start_time, 0) AS s0, coalesce(end_time, 0) AS e0 FROM timeframes) z WINDOW w AS (PARTITION BY timeframe_group_id, service_id ORDER BY s0, e0, _row_number)) q WHERE s0 < e",
))
_TRIP_DISTANCE = f"""WITH l AS (SELECT trip_id, arg_max({{'s': stop_id, 'd': shape_dist_traveled}}, stop_sequence * 1000000000000 + _row_number) AS t FROM stop_times GROUP BY 1),
 h AS (SELECT shape_id, shape_pt_lat AS la, shape_pt_lon AS lo, coalesce(shape_dist_traveled * 5e-2, 0) AS d FROM (SELECT *, row_number() OVER (PARTITION BY shape_id ORDER BY coalesce(shape_dist_traveled, 0) DESC, _row_number) AS i FROM shapes) z WHERE i = 1),
 m AS (SELECT x._row_number, x.trip_id, x.shape_id, {haversine_sql('stop_lat', 'stop_lon', 'la', 'lo')} AS m FROM trips x JOIN l ON l.trip_id = x.trip_id JOIN h ON h.shape_id = x.shape_id JOIN stops s ON s.stop_id = l.t.s WHERE l.t.d > h.d AND h.d > 0 AND stop_lat IS NOT NULL) """
#: Shapes whose own distances are in another unit than the trips'.
_SCALED = "shape_dist_traveled * 5e-2"
register("h7_trip_vs_shape_distance", lambda f: sequences.trip_vs_shape_distance(Feed(f.spark, f.tables | {"shapes": f.tables["shapes"].withColumn("shape_dist_traveled", F.expr(_SCALED))})), _TRIP_DISTANCE + all_of(
    sel("trip_distance_exceeds_shape_distance", "trips", tripId="trip_id", shapeId="shape_id", distance="CAST(round(m) AS BIGINT)") + " FROM m WHERE m > 11.1",
    sel("trip_distance_exceeds_shape_distance_below_threshold", "trips", tripId="trip_id", shapeId="shape_id", distance="CAST(round(m) AS BIGINT)") + " FROM m WHERE m <= 11.1",
))
register("h8_headsign", sequences.headsign, f"""WITH o AS (SELECT *, row_number() OVER ({_BY}) AS i, count(*) OVER (PARTITION BY trip_id) AS n FROM stop_times),
 ed AS (SELECT trip_id, max(CASE WHEN i = 1 THEN stop_id END) AS f, max(CASE WHEN i = n THEN stop_id END) AS l, max(n) AS n FROM o GROUP BY 1),
 c AS (SELECT min(t._row_number) AS r FROM trips t JOIN ed USING (trip_id) WHERE trip_headsign IS NOT NULL AND n >= 2 AND f = l) """ + sel("trip_headsign_matches_intermediate_stop", "stop_times", "o._row_number", tripId="t.trip_id", tripRow="t._row_number", stopId="o.stop_id") + " FROM trips t JOIN o ON o.trip_id = t.trip_id JOIN stops s ON s.stop_id = o.stop_id, c WHERE o.i < o.n AND lower(stop_name) = lower(trip_headsign) AND (c.r IS NULL OR t._row_number < c.r)")
_PLACES = "pl AS (SELECT s.stop_id, CASE WHEN s.stop_lat IS NOT NULL THEN s.stop_lat WHEN p.stop_lat IS NOT NULL THEN p.stop_lat ELSE g.stop_lat END AS lat, CASE WHEN s.stop_lat IS NOT NULL THEN s.stop_lon WHEN p.stop_lat IS NOT NULL THEN p.stop_lon ELSE g.stop_lon END AS lon FROM stops s LEFT JOIN stops p ON p.stop_id = s.parent_station LEFT JOIN stops g ON g.stop_id = p.parent_station)"
_MEASURED = f"""{_PLACES}, ms AS (SELECT s.*, lat, lon, row_number() OVER (PARTITION BY s.trip_id ORDER BY coalesce(stop_sequence, 0), s._row_number) - 1 AS k,
 CASE route_type WHEN 0 THEN 100 WHEN 1 THEN 150 WHEN 2 THEN 500 WHEN 3 THEN 150 WHEN 4 THEN 80 WHEN 5 THEN 30 WHEN 6 THEN 50 WHEN 7 THEN 50 WHEN 11 THEN 150 WHEN 12 THEN 150 ELSE 200 END AS lim
 FROM stop_times s JOIN trips t ON t.trip_id = s.trip_id JOIN routes r ON r.route_id = t.route_id LEFT JOIN pl ON pl.stop_id = s.stop_id)"""


def speed_sql(m: str, dep: str, arr: str) -> str:
    return f"({m}) / 1000 * 3600 / (CASE WHEN {arr} - {dep} <= 0 THEN 60 ELSE {arr} - {dep} END + CASE WHEN {arr} % 60 = 0 AND {dep} % 60 = 0 THEN 60 ELSE 0 END)"


register("h9_fast_consecutive", sequences.fast_consecutive, f"""WITH {_MEASURED}, kept AS (SELECT * FROM ms WHERE (k = 0 OR lat IS NOT NULL AND arrival_time IS NOT NULL) AND trip_id IN (SELECT trip_id FROM ms WHERE k = 0 AND lat IS NOT NULL AND departure_time IS NOT NULL)),
 pr AS (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo, lag(departure_time) OVER w AS d, lag(_row_number) OVER w AS p, coalesce(sum(CASE WHEN departure_time IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY trip_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed FROM kept WINDOW w AS (PARTITION BY trip_id ORDER BY k)),
 sp AS (SELECT *, {speed_sql(haversine_sql('la', 'lo', 'lat', 'lon'), 'd', 'arrival_time')} AS kph FROM pr WHERE k > 0 AND closed = 0) """ + sel("fast_travel_between_consecutive_stops", "stop_times", tripId="trip_id", stopSequence="stop_sequence", previousRow="p", speedKph="CAST(round(kph) AS BIGINT)") + " FROM sp WHERE kph > lim")
register("h10_fast_far", sequences.fast_far, f"""WITH {_MEASURED}, hp AS (SELECT *, sum(CASE WHEN lat IS NULL THEN 1 ELSE 0 END) OVER w AS gone, coalesce({haversine_sql('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')}, 0) AS hop FROM ms WINDOW w AS (PARTITION BY trip_id ORDER BY k)),
 ps AS (SELECT *, sum(hop) OVER (PARTITION BY trip_id ORDER BY k) AS pos FROM hp WHERE gone = 0),
 f AS (SELECT a.trip_id, a.k AS ka, b.k AS kb FROM ps a JOIN ps b ON b.trip_id = a.trip_id AND a.k < b.k WHERE a.departure_time IS NOT NULL AND b.arrival_time IS NOT NULL AND b.pos - a.pos > 10000 AND {speed_sql('b.pos - a.pos', 'a.departure_time', 'b.arrival_time')} > b.lim),
 z AS (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY kb, ka DESC) AS i FROM f) """ + sel("fast_travel_between_far_stops", "stop_times", "NULL", tripId="trip_id", fromStep="ka", toStep="kb") + " FROM z WHERE i = 1")

# ---- I: calendars

_D = f"DATE '{TODAY}'"
register_table("i1_active_dates", calendars.active_dates, f"WITH {_ACTIVE} SELECT service_id, CAST(date AS VARCHAR) AS date FROM active")
register_table("i2_service_runs", calendars.service_runs, f"WITH {_RUNS} SELECT service_id, CAST(f AS VARCHAR) AS first, CAST(l AS VARCHAR) AS last FROM runs")
register("i3_service_windows", lambda f: calendars.service_windows(f, datetime.date(1995, 6, 1)), f"WITH {_RUNS} " + all_of(
    sel("big_gap_in_service", "calendar", "c._row_number", serviceId="service_id", gapStart="l", gapEnd="n") + " FROM calendar c JOIN (SELECT *, lead(f) OVER (PARTITION BY service_id ORDER BY f) AS n FROM runs) r USING (service_id) WHERE n - l - 1 > 13",
    sel("service_extends_far_in_the_future", "calendar", "c._row_number", serviceId="service_id", lastDate="m") + " FROM calendar c JOIN (SELECT service_id, max(l) AS m FROM runs GROUP BY 1) r USING (service_id) WHERE m > DATE '1995-06-01' + 730",
))
register("i4_feed_windows", lambda f: calendars.feed_windows(f, datetime.date(1990, 1, 1)), f"WITH {_RUNS}, sp AS (SELECT service_id, min(f) AS f, max(l) AS l FROM runs WHERE service_id IN (SELECT service_id FROM trips) GROUP BY 1), tot AS (SELECT min(f) AS f, max(l) AS l FROM sp), per AS (SELECT feed_start_date AS a, feed_end_date AS b FROM feed_info ORDER BY _row_number LIMIT 1) " + all_of(
    sel("future_calendar", "calendar", "NULL", firstDate="f") + " FROM tot WHERE f > DATE '1990-01-01'",
    sel("service_window_outside_feed_period", "calendar", "NULL", serviceId="service_id", daysBefore="greatest(a - f, 0)", daysAfter="greatest(l - b, 0)") + " FROM sp, per WHERE f < a OR l > b",
    sel("feed_valid_beyond_total_service_window", "feed_info", "NULL", serviceStart="f", serviceEnd="l") + " FROM tot, per WHERE f - a > 14 OR b - l > 14",
))
register("i5_expired_calendar", lambda f: calendars.expired_calendar(f, datetime.date(2001, 7, 1)), f"WITH {_ACTIVE} " + sel("expired_calendar", "calendar", "c._row_number", serviceId="service_id", lastDate="m") + f" FROM calendar c JOIN (SELECT service_id, max(date) AS m FROM active GROUP BY 1) a USING (service_id) WHERE m < DATE '2001-07-01'")
register("e16_feed_dates", lambda f: calendars.feed_dates(f, TODAY), all_of(
    sel("feed_expiration_date7_days", "feed_info", feedEndDate="feed_end_date") + f" FROM feed_info WHERE feed_end_date < {_D} + 7",
    sel("feed_expiration_date30_days", "feed_info", feedEndDate="feed_end_date") + f" FROM feed_info WHERE feed_end_date < {_D} + 30 AND feed_end_date >= {_D} + 7",
    sel("future_feed", "feed_info", feedStartDate="feed_start_date") + f" FROM feed_info WHERE feed_start_date > {_D}",
))
_COUNTS = f"{_ACTIVE}, tr AS (SELECT t.service_id, coalesce(n, 1) AS n FROM trips t LEFT JOIN (SELECT trip_id, sum(1 + (end_time - start_time - 1) // headway_secs) AS n FROM frequencies GROUP BY 1) q USING (trip_id)), per AS (SELECT date, CAST(sum(n) AS BIGINT) AS n_trips FROM active JOIN tr USING (service_id) GROUP BY 1)"
register_table("i6_trips_per_date", calendars.trips_per_date, f"WITH {_COUNTS} SELECT CAST(date AS VARCHAR) AS date, n_trips FROM per")
register("i7_majority_coverage", lambda f: calendars.majority_coverage(f, datetime.date(1997, 12, 30)), f"WITH {_COUNTS}, k AS (SELECT *, row_number() OVER (ORDER BY n_trips, date) - 1 AS i, count(*) OVER () AS c FROM per), least_ AS (SELECT floor(n_trips * 0.75) AS m FROM k WHERE i = greatest(CAST(floor(c * 0.9) AS BIGINT), c - 30)), win AS (SELECT min(date) AS f, max(date) AS l FROM per, least_ WHERE n_trips >= m) " + sel("trip_coverage_not_active_for_next7_days", "trips", "NULL", currentDate="DATE '1997-12-30'", serviceStart="f", serviceEnd="l") + " FROM win WHERE f > DATE '1997-12-30' OR l - DATE '1997-12-30' < 7")
register("i8_block_overlap", calendars.block_overlap, f"""WITH {_ACTIVE}, o AS (SELECT *, row_number() OVER ({_BY}) AS i, count(*) OVER (PARTITION BY trip_id) AS n FROM stop_times),
 sp AS (SELECT t.block_id, t.trip_id, t.service_id, t._row_number, a.arrival_time AS a0, a.departure_time AS d0, b.arrival_time AS a1, b.departure_time AS d1 FROM trips t JOIN o a ON a.trip_id = t.trip_id AND a.i = 1 JOIN o b ON b.trip_id = t.trip_id AND b.i = b.n WHERE block_id IS NOT NULL AND a.arrival_time IS NOT NULL AND a.departure_time IS NOT NULL AND b.arrival_time IS NOT NULL AND b.departure_time IS NOT NULL),
 pa AS (SELECT x.block_id, x.trip_id AS ta, y.trip_id AS tb, x.service_id AS sa, y.service_id AS sb FROM sp x JOIN sp y ON x.block_id = y.block_id AND (x.a0, x.d1, x._row_number) < (y.a0, y.d1, y._row_number) WHERE y.a0 < x.d1 AND NOT (y.a0 = x.a1 AND y.d0 = x.d1)),
 sh AS (SELECT sa, sb, min(p.date) AS d FROM (SELECT DISTINCT sa, sb FROM pa) z JOIN active p ON p.service_id = sa JOIN active q ON q.service_id = sb AND q.date = p.date GROUP BY 1, 2) """ + sel("block_trips_with_overlapping_stop_times", "trips", "NULL", blockId="block_id", tripIdA="ta", tripIdB="tb", date="d") + " FROM pa JOIN sh USING (sa, sb)")

# ---- J: distances

_VECTOR = "6371010.0 * atan2(sqrt(pow(cos(radians(fa)) * sin(radians(fo)) * sin(radians(ta)) - sin(radians(fa)) * cos(radians(ta)) * sin(radians(tt)), 2) + pow(sin(radians(fa)) * cos(radians(ta)) * cos(radians(tt)) - cos(radians(fa)) * cos(radians(fo)) * sin(radians(ta)), 2) + pow(cos(radians(fa)) * cos(radians(fo)) * cos(radians(ta)) * sin(radians(tt)) - cos(radians(fa)) * sin(radians(fo)) * cos(radians(ta)) * cos(radians(tt)), 2)), cos(radians(fa)) * cos(radians(fo)) * cos(radians(ta)) * cos(radians(tt)) + cos(radians(fa)) * sin(radians(fo)) * cos(radians(ta)) * sin(radians(tt)) + sin(radians(fa)) * sin(radians(ta)))"
register_table("j3_stop_coordinates", distances.stop_coordinates, f"WITH {_PLACES} SELECT stop_id, lat, lon FROM pl")
_DISTANCE = {"fromStopId": "from_stop_id", "toStopId": "to_stop_id", "distance": "CAST(round(m) AS BIGINT)"}
register("j4_transfer_distance", distances.transfer_distance, f"WITH {_PLACES}, q AS (SELECT *, {_VECTOR} AS m FROM (SELECT t.*, coalesce(a.lat, 0) AS fa, coalesce(a.lon, 0) AS fo, coalesce(b.lat, 0) AS ta, coalesce(b.lon, 0) AS tt FROM transfers t LEFT JOIN pl a ON a.stop_id = from_stop_id LEFT JOIN pl b ON b.stop_id = to_stop_id WHERE from_stop_id IS NOT NULL AND to_stop_id IS NOT NULL) z) " + all_of(
    sel("transfer_distance_above_2_km", "transfers", **_DISTANCE) + " FROM q WHERE m > 2000 AND m <= 10000", sel("transfer_distance_too_large", "transfers", **_DISTANCE) + " FROM q WHERE m > 10000"))
register_table("j5_shape_running_distance", lambda f: distances.shape_running_distance(f).withColumn("metres", F.round("metres", 2)), f"SELECT shape_id, _row_number, round(sum(coalesce(hop, 0)) OVER w, 2) AS metres, max(shape_dist_traveled) OVER w AS user_distance FROM (SELECT *, {haversine_sql('lag(shape_pt_lat) OVER v', 'lag(shape_pt_lon) OVER v', 'shape_pt_lat', 'shape_pt_lon')} AS hop FROM shapes WINDOW v AS ({_H})) q WINDOW w AS ({_H})")


def unit_sql(lat: str, lon: str, name: str) -> str:
    return f"cos(radians({lat})) * cos(radians({lon})) AS {name}x, cos(radians({lat})) * sin(radians({lon})) AS {name}y, sin(radians({lat})) AS {name}z"


def apart_sql(a: str, b: str) -> str:
    """Metres between two unit vectors."""
    return f"2 * 6371010.0 * asin(least(1.0, sqrt(pow({a}x - {b}x, 2) + pow({a}y - {b}y, 2) + pow({a}z - {b}z, 2)) / 2))"


#: Every visited (shape, stop) against every arc of the shape, on the sphere; a stop without a place lies at (0, 0).
_ARCS = "WITH " + _PLACES + f""", sv AS (SELECT shape_id, {unit_sql('shape_pt_lat', 'shape_pt_lon', 'v')}, row_number() OVER ({_H}) AS k FROM shapes),
 sg AS (SELECT shape_id, k, vx AS ax, vy AS ay, vz AS az, lead(vx) OVER w AS ex, lead(vy) OVER w AS ey, lead(vz) OVER w AS ez FROM sv WINDOW w AS (PARTITION BY shape_id ORDER BY k)),
 nn AS (SELECT *, ay * ez - az * ey AS cx, az * ex - ax * ez AS cy, ax * ey - ay * ex AS cz FROM sg WHERE ex IS NOT NULL),
 nu AS (SELECT *, cx / len AS nx, cy / len AS ny, cz / len AS nz FROM (SELECT *, greatest(sqrt(cx * cx + cy * cy + cz * cz), 1e-300) AS len FROM nn) q),
 st AS (SELECT DISTINCT t.shape_id, s.stop_id, coalesce(lat, 0) AS lat, coalesce(lon, 0) AS lon FROM trips t JOIN stop_times s ON s.trip_id = t.trip_id LEFT JOIN pl ON pl.stop_id = s.stop_id WHERE s.stop_id IS NOT NULL),
 sp AS (SELECT *, {unit_sql('lat', 'lon', 'p')} FROM st),
 jn AS (SELECT sp.shape_id, stop_id, k, {apart_sql('p', 'a')} AS ma, {apart_sql('p', 'e')} AS mb, px * nx + py * ny + pz * nz AS sine,
  px * (ny * az - nz * ay) + py * (nz * ax - nx * az) + pz * (nx * ay - ny * ax) > 0 AND px * (ey * nz - ez * ny) + py * (ez * nx - ex * nz) + pz * (ex * ny - ey * nx) > 0 AS inside FROM sp JOIN nu ON nu.shape_id = sp.shape_id),
 tt AS (SELECT shape_id, stop_id, k, mb, CASE WHEN inside THEN 6371010.0 * asin(least(1.0, abs(sine))) ELSE least(ma, mb) END AS m FROM jn)"""
register_table("j6_shape_candidates", lambda f: matcher.shape_candidates(f).withColumn("nearest_m", F.round("nearest_m", 2)), _ARCS + """,
 cl AS (SELECT *, lag(k) OVER w AS k0, lag(m) OVER w AS m0, lag(mb) OVER w AS b0 FROM tt WHERE m <= 100 WINDOW w AS (PARTITION BY shape_id, stop_id ORDER BY k)),
 n AS (SELECT shape_id, stop_id, count(*) AS n FROM cl WHERE k0 IS NULL OR k <> k0 + 1 OR b0 > m0 AND m < b0 GROUP BY 1, 2)
 SELECT t.shape_id, t.stop_id, CAST(coalesce(any_value(n.n), 0) AS INTEGER) AS n_candidates, round(min(m), 2) AS nearest_m FROM tt t LEFT JOIN n ON n.shape_id = t.shape_id AND n.stop_id = t.stop_id GROUP BY 1, 2""")
register_table("j7_closest_shape_point", matcher.closest_shape_point, _ARCS + " SELECT shape_id, stop_id, round(min(m), 2) AS distance_m FROM tt GROUP BY 1, 2")
QUERIES["j6_stop_to_shape"] = lambda spark, sf_dir: flat(matcher.stop_to_shape(feed_of(spark, sf_dir)))

# ---- K: reachability

register_table("k1_including_station", graph.including_station, "SELECT stop_id, station FROM (SELECT s.stop_id, CASE WHEN s.location_type = 1 THEN s.stop_id WHEN a.location_type = 1 THEN a.stop_id WHEN b.location_type = 1 THEN b.stop_id WHEN c.location_type = 1 THEN c.stop_id END AS station FROM stops s LEFT JOIN stops a ON a.stop_id = s.parent_station LEFT JOIN stops b ON b.stop_id = a.parent_station LEFT JOIN stops c ON c.stop_id = b.parent_station) q WHERE station IS NOT NULL")
register("k2_pathway_unreachable_location", graph.pathway_unreachable_location, """WITH RECURSIVE st AS (SELECT s.stop_id, s.location_type, s._row_number, CASE WHEN s.location_type = 1 THEN s.stop_id WHEN a.location_type = 1 THEN a.stop_id WHEN b.location_type = 1 THEN b.stop_id WHEN c.location_type = 1 THEN c.stop_id END AS station FROM stops s LEFT JOIN stops a ON a.stop_id = s.parent_station LEFT JOIN stops b ON b.stop_id = a.parent_station LEFT JOIN stops c ON c.stop_id = b.parent_station),
 e AS (SELECT from_stop_id AS a, to_stop_id AS b FROM pathways UNION SELECT to_stop_id, from_stop_id FROM pathways WHERE is_bidirectional = 1),
 ins AS (SELECT * FROM st WHERE station IN (SELECT station FROM st WHERE stop_id IN (SELECT from_stop_id FROM pathways UNION SELECT to_stop_id FROM pathways))),
 f AS (SELECT stop_id FROM ins WHERE location_type = 2 UNION SELECT e.b FROM f JOIN e ON e.a = f.stop_id),
 g AS (SELECT stop_id FROM ins WHERE location_type = 2 UNION SELECT e.a FROM g JOIN e ON e.b = g.stop_id),
 pc AS (SELECT *, stop_id IN (SELECT stop_id FROM f) AS x, stop_id IN (SELECT stop_id FROM g) AS y FROM ins WHERE location_type IN (3, 4) OR location_type = 0 AND stop_id NOT IN (SELECT parent_station FROM stops WHERE parent_station IS NOT NULL)) """ + sel("pathway_unreachable_location", "stops", stopId="stop_id", hasEntrance="x", hasExit="y") + " FROM pc WHERE NOT x OR NOT y")


# ---- L: several checks in one run, which share the reading and dealing of stop_times

TOGETHER = ["row_rules", "duplicate_key_stop_times", "usage", "unsorted_stop_times", "stop_time_times", "trip_edges", "stop_time_distance"]


def run_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..shared import written
    from .runner import run_checks

    feed = feed_of(spark, sf_dir)
    # projected once, as its row numbers need a shuffle of all columns that the checks would each repeat for their own
    feed.tables["stop_times"] = written(feed.tables["stop_times"], "stop_times")
    run = run_checks(feed, TODAY, TOGETHER)
    if run.failures:
        raise ValueError(f"checks failed: {run.failures}")
    return run.notices.groupBy("code").agg(F.count(F.lit(1)).alias("n_notices"))


QUERIES["l6_run_checks"] = run_together
_PARTS = [n for n in SQL if n.startswith("e_rows_") and "flex" not in n] + ["d1_duplicate_key_stop_times", "f1_usage", "h1_unsorted_stop_times", "h2_stop_time_times", "h3_trip_edges", "h4_stop_time_distance"]
SQL["l6_run_checks"] = f"SELECT code, count(*) AS n_notices FROM ({' UNION ALL '.join(f'SELECT code FROM ({SQL[n]}) q{i}' for i, n in enumerate(_PARTS))}) z GROUP BY code"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import registry_files, registry_raw

    return QUERIES | registry_files.QUERIES | registry_raw.QUERIES


def oracle_sql() -> dict[str, str]:
    from . import registry_files, registry_raw

    return SQL | registry_files.SQL | registry_raw.SQL



