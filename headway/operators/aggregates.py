"""Grouped summaries and checks: counts, features, blocks, single points, flexible trips."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..feed import Feed
from ..notices import notices, union
from ..schema import TABLES

FEED = "feed_id"
COUNTED = (("shapes", "shape_id"), ("stops", "stop_id"), ("routes", "route_id"), ("trips", "trip_id"), ("agency", "agency_id"), ("trips", "block_id"))


def summary_counts(feed: Feed, approximate: bool = False) -> DataFrame:
    """Distinct ids by feed and kind. approximate: by sketches, which move a few KB for each feed."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    out = None
    for table, column in COUNTED:
        part = feed[table].where(F.coalesce(F.col(column), F.lit("")) != "").groupBy(FEED).agg(count(column).alias("n")).select(FEED, F.lit(column).alias("kind"), "n")
        out = part if out is None else out.unionByName(part)
    return out


#: Columns of an agency that a summary shows.
AGENCY = ("agency_name", "agency_url", "agency_phone", "agency_email", "agency_timezone")
#: Columns of feed_info that a summary shows, from its first row.
INFO = ("feed_publisher_name", "feed_publisher_url", "feed_lang", "feed_start_date", "feed_end_date", "feed_contact_email")


def feed_summary(feed: Feed) -> DataFrame:
    """One row for each feed: agencies in file order, feed info, files with rows, first and last service date.

    Of an agency name, URL, phone, email and time zone are shown, with bars between. The dates are those of
    services that trips have; a table that didn't load cleanly counts as empty there.
    """
    from .calendars import service_spans

    shown = F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in AGENCY))
    named = F.array_sort(F.collect_list(F.struct("_row_number", F.coalesce("agency_name", F.lit("")).alias("name"), shown.alias("shown"))))
    part = lambda name, sep: F.array_join(F.transform(named, lambda s: s[name]), sep)
    agencies = feed["agency"].groupBy(FEED).agg(part("name", ", ").alias("agencies"), part("shown", "; ").alias("agency_details"))
    info = feed["feed_info"].groupBy(FEED).agg(*(F.min_by(c, "_row_number").alias(c) for c in INFO))
    clean = {t: feed.gated([t]).tables[t] for t in ("trips", "calendar", "calendar_dates") if t in feed.tables}
    dated = Feed(feed.spark, feed.tables | clean, feed.status)
    used = dated["trips"].where("service_id is not null").select(FEED, "service_id").distinct()
    window = service_spans(dated, used).groupBy(FEED).agg(F.min("first").alias("service_start"), F.max("last").alias("service_end"))
    files = union([feed[n].select(FEED).distinct().withColumn("file", F.lit(TABLES[n].file)) for n in feed.tables])
    files = files.groupBy(FEED).agg(F.array_join(F.array_sort(F.collect_list("file")), ",").alias("files"))
    return agencies.join(info, FEED, "full").join(files, FEED, "full").join(window, FEED, "full")


def _set(table: str, *columns: str) -> tuple[tuple[str, str], ...]:
    """A row that sets one of the columns."""
    return tuple((table, f"{c} is not null") for c in columns)


def _rows(*tables: str) -> tuple[tuple[str, str], ...]:
    """A row in one of the tables."""
    return tuple((t, "true") for t in tables)


_ALONE = "trip_id is not null and {0} is not null and stop_id is null"
#: Features, and what shows each: every part must be met, by a row of one of its (table, condition).
FEATURES: dict[str, tuple[tuple[tuple[str, str], ...], ...]] = {
    "Pathway Connections": (_rows("pathways"),),
    "Pathway Signs": (_set("pathways", "signposted_as", "reversed_signposted_as"),),
    "Pathway Details": (_set("pathways", "max_slope", "min_width", "length", "stair_count"),),
    "In-station Traversal Time": (_set("pathways", "traversal_time"),),
    "Levels": (_rows("levels"),),
    "Transfers": (_rows("transfers"),),
    "Shapes": (_rows("shapes"),),
    "Frequencies": (_rows("frequencies"),),
    "Feed Information": (_rows("feed_info"),),
    "Attributions": (_rows("attributions"),),
    "Translations": (_rows("translations"),),
    "Fares V1": (_rows("fare_attributes"),),
    "Fare Products": (_rows("fare_products"),),
    "Fare Transfers": (_rows("fare_transfer_rules"),),
    "Fare Media": (_rows("fare_media"), _set("fare_products", "fare_media_id")),
    "Rider Categories": (_rows("rider_categories"), _set("fare_products", "rider_category_id")),
    "Route-Based Fares": (_set("routes", "network_id") + _rows("networks"), _rows("fare_products"), _set("fare_leg_rules", "network_id")),
    "Zone-Based Fares": (_rows("areas"), _rows("fare_products"), _set("fare_leg_rules", "from_area_id", "to_area_id")),
    "Time-Based Fares": (_rows("timeframes"), _rows("fare_products"), _set("fare_leg_rules", "from_timeframe_group_id", "to_timeframe_group_id")),
    "Contactless EMV Support": (_set("agency", "cemv_support") + _set("routes", "cemv_support"),),
    "Booking Rules": (_rows("booking_rules"),),
    "Route Colors": (_set("routes", "route_color", "route_text_color"),),
    "Headsigns": (_set("trips", "trip_headsign") + _set("stop_times", "stop_headsign"),),
    "Stops Wheelchair Accessibility": (_set("stops", "wheelchair_boarding"),),
    "Trips Wheelchair Accessibility": (_set("trips", "wheelchair_accessible"),),
    "Text-to-Speech": (_set("stops", "tts_stop_name"),),
    "Bike Allowed": (_set("trips", "bikes_allowed"),),
    "Cars Allowed": (_set("trips", "cars_allowed"),),
    "Location Types": (_set("stops", "location_type"),),
    "Stop Access": (_set("stops", "stop_access"),),
    "Continuous Stops": (_set("routes", "continuous_drop_off", "continuous_pickup") + _set("stop_times", "continuous_drop_off", "continuous_pickup"),),
    "Zone-Based Demand Responsive Services": ((("stop_times", _ALONE.format("location_id")),),),
    "Fixed-Stops Demand Responsive Transit": (_rows("location_groups"), (("stop_times", _ALONE.format("location_group_id")),)),
}


def feature_flags(feed: Feed) -> DataFrame:
    """(feed_id, feature) for each feature a feed shows: one pass over each table."""
    wanted: dict[str, set[str]] = {}
    for parts in FEATURES.values():
        for table, condition in (c for part in parts for c in part):
            wanted.setdefault(table, set()).add(condition)
    seen = []
    for table in sorted(wanted.keys() & feed.tables.keys()):
        df = feed[table]
        asked = [c for c in sorted(wanted[table]) if set(re.findall(r"(\w+) is (?:not )?null", c)) <= set(df.columns)]
        met = df.groupBy(FEED).agg(*(F.max(F.expr(c)).alias(f"c{i}") for i, c in enumerate(asked)))
        names = F.array(*(F.when(F.col(f"c{i}"), F.lit(f"{table}: {c}")) for i, c in enumerate(asked)))
        seen.append(met.select(FEED, F.explode(F.array_compact(names)).alias("met")))
    if not seen:
        return feed.spark.createDataFrame([], f"{FEED} string, feature string")
    held = union(seen).groupBy(FEED).agg(F.collect_set("met").alias("met"))
    any_of = lambda part: F.arrays_overlap("met", F.array(*(F.lit(f"{t}: {c}") for t, c in part)))
    shown = [F.when(reduce(Column.__and__, map(any_of, parts)), F.lit(name)) for name, parts in FEATURES.items()]
    found = held.select(FEED, F.explode(F.array_compact(F.array(*shown))).alias("feature"))
    deviated = deviated_routes(feed).select(FEED, F.lit("Predefined Routes with Deviation").alias("feature"))
    return found.unionByName(deviated)


def deviated_routes(feed: Feed) -> DataFrame:
    """Feeds with a trip whose rows together set zone, stop, arrival and departure, and how many such trips."""
    mask: Column = F.lit(0)
    for i, c in enumerate(("location_id", "stop_id", "arrival_time", "departure_time")):
        mask = mask + F.when(F.col(c).isNotNull(), 1 << i).otherwise(0)
    trips = feed["stop_times"].groupBy(FEED, "trip_id").agg(F.bit_or(mask).alias("mask")).where("mask = 15")
    return trips.groupBy(FEED).agg(F.count(F.lit(1)).alias("n_trips"))


def block_route_types(feed: Feed) -> DataFrame:
    """Blocks with several route types; routes and types in the order of their first trip."""
    trips = feed["trips"].where("block_id is not null").select(FEED, "block_id", "route_id", "_row_number")
    kinds = feed["routes"].where("route_id is not null").groupBy(FEED, "route_id").agg(F.min_by("route_type", "_row_number").alias("route_type"))
    # a row for each block and route before the join, whatever the number of trips
    used = trips.groupBy(FEED, "block_id", "route_id").agg(F.min("_row_number").alias("n")).join(kinds, [FEED, "route_id"])
    types = used.groupBy(FEED, "block_id", "route_type").agg(F.min("n").alias("n"), F.array_sort(F.collect_list(F.struct("n", "route_id"))).alias("routes"))
    in_order = lambda c, f: F.array_join(F.transform(F.array_sort(c), lambda s: s[f].cast("string")), ",")
    found = types.groupBy(FEED, "block_id").agg(F.count(F.lit(1)).alias("k"), in_order(F.flatten(F.collect_list("routes")), "route_id").alias("routeIds"), in_order(F.collect_list(F.struct("n", "route_type")), "route_type").alias("routeTypes")).where("k > 1")
    return notices(found, "inconsistent_route_type_for_block_id", "WARNING", "trips.txt", None, blockId="block_id", routeIds="routeIds", routeTypes="routeTypes")


def single_points(feed: Feed) -> DataFrame:
    points = feed["shapes"].where("shape_id is not null").groupBy(FEED, "shape_id").agg(F.count(F.lit(1)).alias("n"), F.min("_row_number").alias("_row_number")).where("n = 1")
    return notices(points, "single_shape_point", "WARNING", "shapes.txt", shapeId="shape_id")


def lone_flex_stop(feed: Feed) -> DataFrame:
    """Trips whose only stop_time has both windows and on-request pickup and drop-off."""
    flex = F.expr("start_pickup_drop_off_window is not null and end_pickup_drop_off_window is not null and pickup_type = 2 and drop_off_type = 2")
    trips = feed["stop_times"].where("trip_id is not null").groupBy(FEED, "trip_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce(flex, F.lit(False))).alias("flex"), F.min("_row_number").alias("_row_number"))
    return notices(trips.where("n = 1 and flex"), "missing_stop_times_record", "ERROR", "stop_times.txt", tripId="trip_id")


def shape_distance_gaps(feed: Feed) -> DataFrame:
    """Trips with distances on a shape that has a point without one."""
    key = F.struct(F.coalesce("stop_sequence", F.lit(0)), "_row_number")
    travelled = feed["stop_times"].where("shape_dist_traveled is not null").groupBy(FEED, "trip_id").agg(F.min_by("_row_number", key).alias("timeRow"))
    gaps = feed["shapes"].where("shape_dist_traveled is null and shape_id is not null").select(FEED, "shape_id").distinct()
    trips = feed["trips"].select(FEED, "trip_id", "shape_id", "_row_number").join(gaps, [FEED, "shape_id"], "left_semi").join(travelled, [FEED, "trip_id"])
    return notices(trips, "trip_with_shape_dist_traveled_but_no_shape_distances", "ERROR", "trips.txt", tripId="trip_id", shapeId="shape_id", stopTimeRow="timeRow")
