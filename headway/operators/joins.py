"""Checks by joining tables: usage, parents, pathways, transfers, fares, agencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..feed import Feed, distinct_in_order, first_rows
from ..notices import notices, union

FEED = "feed_id"


def location_type(df: DataFrame) -> Column:
    return F.coalesce(df["location_type"], F.lit(0))


def stop_types(feed: Feed) -> DataFrame:
    """First row of each stop: feed_id, stop_id, type, parent_station, stop_row."""
    stops = first_rows(feed["stops"].where("stop_id is not null").select(FEED, "stop_id", "location_type", "parent_station", "_row_number"), "stop_id")
    return stops.select(FEED, "stop_id", F.coalesce("location_type", F.lit(0)).alias("type"), "parent_station", F.col("_row_number").alias("stop_row"))


def usage(feed: Feed) -> DataFrame:
    trips, times = feed["trips"], feed["stop_times"]
    counts = times.where("trip_id is not null").groupBy(FEED, "trip_id").agg(F.count(F.lit(1)).alias("n"))
    joined = trips.where("trip_id is not null").select(FEED, "trip_id", "_row_number").join(counts, [FEED, "trip_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    unused = joined.where("n = 0").groupBy(FEED, "trip_id").agg(F.min("_row_number").alias("_row_number"))
    shapes = distinct_in_order(feed["shapes"].where("shape_id is not null"), "shape_id").join(trips.select(FEED, "shape_id").distinct(), [FEED, "shape_id"], "left_anti")
    stops = feed["stops"]
    stations = distinct_in_order(stops.where("location_type = 1 and stop_id is not null"), "stop_id")
    used = stops.where("coalesce(location_type, 0) = 0").select(FEED, F.col("parent_station").alias("stop_id")).where("stop_id is not null").distinct()
    return union([
        notices(unused, "unused_trip", "WARNING", "trips.txt", tripId="trip_id"),
        notices(joined.where("n < 2"), "unusable_trip", "WARNING", "trips.txt", tripId="trip_id"),
        notices(shapes, "unused_shape", "WARNING", "shapes.txt", shapeId="shape_id"),
        notices(stations.join(used, [FEED, "stop_id"], "left_anti"), "unused_station", "INFO", "stops.txt", stopId="stop_id"),
    ])


def stop_usage(feed: Feed) -> DataFrame:
    times = feed["stop_times"]
    direct = times.where("stop_id is not null").groupBy(FEED, "stop_id").agg(F.min("_row_number").alias("n"))
    groups = times.where("location_group_id is not null").groupBy(FEED, "location_group_id").agg(F.min("_row_number").alias("n"))
    through = groups.join(feed["location_group_stops"].select(FEED, "location_group_id", "stop_id"), [FEED, "location_group_id"]).where("stop_id is not null").select(FEED, "stop_id", "n")
    used = direct.unionByName(through).groupBy(FEED, "stop_id").agg(F.min("n").alias("usedRow"))
    stops = feed["stops"].where("stop_id is not null")
    idle = stops.where("coalesce(location_type, 0) = 0").join(used, [FEED, "stop_id"], "left_anti")
    wrong = stops.where("coalesce(location_type, 0) <> 0").join(used, [FEED, "stop_id"])
    return notices(idle, "stop_without_stop_time", "WARNING", "stops.txt", stopId="stop_id").unionByName(
        notices(wrong, "location_with_unexpected_stop_time", "ERROR", "stops.txt", stopId="stop_id", stopTimeRow="usedRow")
    )


def parent_type(feed: Feed) -> DataFrame:
    parents = stop_types(feed).select(FEED, F.col("stop_id").alias("parent_station"), F.col("type").alias("parent_type"), F.col("stop_row").alias("parent_row"))
    rows = feed["stops"].select(FEED, "_row_number", "stop_id", F.coalesce("location_type", F.lit(0)).alias("type"), "parent_station").join(parents, [FEED, "parent_station"])
    wrong = rows.where("type in (0, 2, 3) and parent_type <> 1 or type = 4 and parent_type <> 0")
    return notices(wrong, "wrong_parent_location_type", "ERROR", "stops.txt", stopId="stop_id", locationType="type", parentStation="parent_station", parentLocationType="parent_type")


def pathway_sides(feed: Feed) -> DataFrame:
    """Both ends of each pathway: feed_id, _row_number, pathway_id, pathway_mode, field, stop_id, other."""
    ends = F.array(*(F.struct(F.lit(f"{a}_stop_id").alias("field"), F.col(f"{a}_stop_id").alias("stop_id"), F.col(f"{b}_stop_id").alias("other")) for a, b in (("from", "to"), ("to", "from"))))
    return feed["pathways"].select(FEED, "_row_number", "pathway_id", "pathway_mode", F.explode(ends).alias("e")).select(FEED, "_row_number", "pathway_id", "pathway_mode", "e.*")


def pathway_ends(feed: Feed) -> DataFrame:
    sides = pathway_sides(feed).join(stop_types(feed), [FEED, "stop_id"])
    parents = feed["stops"].where("location_type = 4").select(FEED, F.col("parent_station").alias("stop_id")).where("stop_id is not null").distinct()
    access = first_rows(feed["stops"].where("stop_id is not null").select(FEED, "stop_id", "stop_access", "_row_number"), "stop_id").where("stop_access = 1").select(FEED, "stop_id")
    outside = sides.join(access, [FEED, "stop_id"], "left_semi").dropDuplicates([FEED, "_row_number", "stop_id"])
    file, common = "pathways.txt", {"pathwayId": "pathway_id", "fieldName": "field", "stopId": "stop_id"}
    return union([
        notices(sides.where("type = 1"), "pathway_to_wrong_location_type", "ERROR", file, **common),
        notices(sides.where("type = 0").join(parents, [FEED, "stop_id"], "left_semi"), "pathway_to_platform_with_boarding_areas", "ERROR", file, **common),
        notices(outside, "pathway_to_stop_with_access_outside_of_station_pathways", "ERROR", file, pathwayId="pathway_id", stopId="stop_id"),
    ])


def dangling_node(feed: Feed) -> DataFrame:
    """Generic nodes with one neighbour; an unnamed neighbour counts as one."""
    neighbours = pathway_sides(feed).where("stop_id is not null").groupBy(FEED, "stop_id").agg(F.count_distinct(F.coalesce("other", F.lit(""))).alias("n")).where("n = 1")
    rows = feed["stops"].where("location_type = 3").join(neighbours, [FEED, "stop_id"], "left_semi")
    return notices(rows, "pathway_dangling_generic_node", "WARNING", "stops.txt", stopId="stop_id", parentStation="parent_station")


def elevator_levels(feed: Feed) -> DataFrame:
    ends = pathway_sides(feed).where("pathway_mode = 5 and stop_id is not null").select(FEED, "stop_id").distinct()
    return notices(feed["stops"].where("level_id is null").join(ends, [FEED, "stop_id"], "left_semi"), "missing_level_id", "ERROR", "stops.txt", stopId="stop_id")


def url_reuse(feed: Feed) -> DataFrame:
    """Equal URLs of agencies, routes and stops, ASCII case apart; a notice for each pair."""
    def urls(table: str, column: str, tag: str) -> DataFrame:
        low = F.translate(F.col(column), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        return feed[table].where(F.col(column).isNotNull()).select(FEED, low.alias("url"), F.col("_row_number").alias(tag))

    agency, routes, stops = urls("agency", "agency_url", "a"), urls("routes", "route_url", "r"), urls("stops", "stop_url", "s")
    pair = lambda x, y, code, file, row, other: notices(x.join(y, [FEED, "url"]), code, "WARNING", file, row, url="url", otherRow=other)
    return union([
        pair(routes, agency, "same_route_and_agency_url", "routes.txt", "r", "a"),
        pair(stops, agency, "same_stop_and_agency_url", "stops.txt", "s", "a"),
        pair(stops, routes, "same_stop_and_route_url", "stops.txt", "s", "r"),
    ])


def ferry_bikes(feed: Feed) -> DataFrame:
    ferries = feed["routes"].where("route_type = 4").select(FEED, "route_id").distinct()
    trips = feed["trips"].where("coalesce(bikes_allowed, 0) in (0, -1)").join(ferries, [FEED, "route_id"], "left_semi")
    return notices(trips, "missing_bike_allowance", "WARNING", "trips.txt", routeId="route_id", tripId="trip_id")


def transfer_ends(feed: Feed) -> DataFrame:
    """Both ends of each transfer: feed_id, _row_number, transfer_type, side, stop_id, trip_id, route_id."""
    ends = F.array(*(F.struct(F.lit(s).alias("side"), *(F.col(f"{s}_{c}").alias(c) for c in ("stop_id", "trip_id", "route_id"))) for s in ("from", "to")))
    return feed["transfers"].select(FEED, "_row_number", "transfer_type", F.explode(ends).alias("e")).select(FEED, "_row_number", "transfer_type", "e.*")


def transfer_stop_types(feed: Feed) -> DataFrame:
    """Ends that are no stop or station; for in-seat transfers a station is wrong too."""
    rows = transfer_ends(feed).join(stop_types(feed), [FEED, "stop_id"])
    wrong = rows.where("type not in (0, 1) or type = 1 and transfer_type in (4, 5)")
    return notices(wrong, "transfer_with_invalid_stop_location_type", "ERROR", "transfers.txt", stopIdFieldName=F.concat("side", F.lit("_stop_id")), stopId="stop_id", locationType="type")


def transfer_trips(feed: Feed) -> DataFrame:
    """Transfers whose trip is of another route, or serves neither the stop nor a child of the station."""
    ends = transfer_ends(feed).where("trip_id is not null")
    routes = first_rows(feed["trips"].where("trip_id is not null").select(FEED, "trip_id", F.col("route_id").alias("expected"), "_row_number"), "trip_id").drop("_row_number")
    other = ends.where("route_id is not null").join(routes, [FEED, "trip_id"]).where("expected is not null and expected <> route_id")
    types = stop_types(feed)
    children = types.where("parent_station is not null").select(FEED, F.col("parent_station").alias("stop_id"), F.col("stop_id").alias("served"))
    own = types.where("type = 0").select(FEED, "stop_id", F.col("stop_id").alias("served"))
    stations = types.where("type = 1").join(children, [FEED, "stop_id"]).select(FEED, "stop_id", "served")
    known = ends.join(routes.select(FEED, "trip_id"), [FEED, "trip_id"]).join(types.where("type in (0, 1)").select(FEED, "stop_id"), [FEED, "stop_id"])
    # only trips that transfers name are looked up in the large table
    named = ends.select(FEED, "trip_id").distinct()
    visits = feed["stop_times"].select(FEED, "trip_id", F.col("stop_id").alias("served")).join(named, [FEED, "trip_id"], "left_semi").distinct()
    fine = known.join(own.unionByName(stations), [FEED, "stop_id"]).join(visits, [FEED, "trip_id", "served"], "left_semi").select(FEED, "_row_number", "side").distinct()
    unserved = known.join(fine, [FEED, "_row_number", "side"], "left_anti")
    field = lambda c: F.concat("side", F.lit(f"_{c}"))
    return notices(other, "transfer_with_invalid_trip_and_route", "ERROR", "transfers.txt", tripFieldName=field("trip_id"), tripId="trip_id", routeId="route_id", expectedRouteId="expected").unionByName(
        notices(unserved, "transfer_with_invalid_trip_and_stop", "ERROR", "transfers.txt", tripFieldName=field("trip_id"), tripId="trip_id", stopId="stop_id")
    )


def in_seat_ends(feed: Feed) -> DataFrame:
    """In-seat transfers: the from-stop must be the trip's last and the to-stop its first; route types must agree."""
    ends = transfer_ends(feed).where("transfer_type in (4, 5)")
    key = F.struct(F.coalesce("stop_sequence", F.lit(0)), "_row_number")
    named = ends.where("trip_id is not null").select(FEED, "trip_id").distinct()
    visits = feed["stop_times"].join(named, [FEED, "trip_id"], "left_semi").select(FEED, "trip_id", "stop_id", "stop_sequence", "_row_number")
    edges = visits.groupBy(FEED, "trip_id").agg(F.struct(F.min_by("stop_id", key).alias("first"), F.max_by("stop_id", key).alias("last"), F.collect_set("stop_id").alias("all")).alias("v"))
    stops = stop_types(feed).select(FEED, "stop_id")
    rows = ends.join(edges, [FEED, "trip_id"]).join(stops, [FEED, "stop_id"])
    edge = F.when(F.col("side") == "from", F.col("v.last")).otherwise(F.col("v.first"))
    mid = rows.where(F.array_contains("v.all", F.col("stop_id")) & (edge.isNull() | (edge != F.col("stop_id"))))
    trips = first_rows(feed["trips"].where("trip_id is not null").select(FEED, "trip_id", "route_id", "_row_number"), "trip_id").drop("_row_number")
    kinds = first_rows(feed["routes"].where("route_id is not null").select(FEED, "route_id", "route_type", "_row_number"), "route_id").drop("_row_number")
    types = trips.join(kinds, [FEED, "route_id"]).select(FEED, "trip_id", "route_type")
    t = feed["transfers"].where("transfer_type = 4").select(FEED, "_row_number", "from_trip_id", "to_trip_id")
    named_types = lambda side: types.select(FEED, F.col("trip_id").alias(f"{side}_trip_id"), F.col("route_type").alias(f"{side}_type"))
    apart = t.join(named_types("from"), [FEED, "from_trip_id"]).join(named_types("to"), [FEED, "to_trip_id"]).where("from_type <> to_type")
    return notices(mid, "transfer_with_suspicious_mid_trip_in_seat", "WARNING", "transfers.txt", tripIdFieldName=F.concat("side", F.lit("_trip_id")), tripId="trip_id", stopId="stop_id").unionByName(
        notices(apart, "inconsistent_route_type_for_in_seat_transfer", "ERROR", "transfers.txt", fromTripId="from_trip_id", toTripId="to_trip_id", fromRouteType="from_type", toRouteType="to_type")
    )


def continuous_service(feed: Feed) -> DataFrame:
    routes = feed["routes"].where("continuous_pickup in (0, 2, 3) or continuous_drop_off in (0, 2, 3)").select(FEED, "route_id").distinct()
    trips = feed["trips"].join(routes, [FEED, "route_id"], "left_semi").select(FEED, "trip_id", F.col("_row_number").alias("trip_row"))
    times = feed["stop_times"].where("start_pickup_drop_off_window is not null or end_pickup_drop_off_window is not null").join(trips, [FEED, "trip_id"])
    return notices(times, "forbidden_continuous_pickup_drop_off", "ERROR", "stop_times.txt", tripId="trip_id", tripRow="trip_row")


def zone_fares(feed: Feed) -> DataFrame:
    """Stops without a zone that routes of zone-based fares serve."""
    rules = feed["fare_rules"].where("origin_id is not null or destination_id is not null or contains_id is not null").select(FEED, F.coalesce("route_id", F.lit("")).alias("route_id")).distinct()
    trips = feed["trips"].select(FEED, "trip_id", F.coalesce("route_id", F.lit("")).alias("route_id")).join(rules, [FEED, "route_id"], "left_semi").select(FEED, "trip_id").distinct()
    lacking = feed["stops"].where("coalesce(location_type, 0) = 0 and zone_id is null and stop_id is not null").select(FEED, "stop_id", "_row_number")
    served = feed["stop_times"].select(FEED, "trip_id", "stop_id").join(lacking.select(FEED, "stop_id"), [FEED, "stop_id"], "left_semi").join(trips, [FEED, "trip_id"], "left_semi").select(FEED, "stop_id").distinct()
    return notices(lacking.join(served, [FEED, "stop_id"], "left_semi"), "stop_without_zone_id", "INFO", "stops.txt", stopId="stop_id")


def canonical_language(tag: Column) -> Column:
    """Language lower, script Title, region UPPER case, for tags of these parts."""
    case = lambda p, i: F.when(i == 0, F.lower(p)).when(F.length(p) == 4, F.initcap(p)).when(F.length(p).isin(2, 3), F.upper(p)).otherwise(F.lower(p))
    return F.array_join(F.transform(F.split(tag, "[-_]"), case), "-")


def agency_consistency(feed: Feed) -> DataFrame:
    agencies = feed["agency"]
    order = W.partitionBy(FEED).orderBy("_row_number").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = agencies.select(FEED, "_row_number", "agency_id", "agency_timezone", canonical_language(F.col("agency_lang")).alias("lang"))
    rows = rows.withColumns({"zone1": F.first("agency_timezone", True).over(order), "lang1": F.first("lang", True).over(order)})
    info = first_rows(feed["feed_info"].select(FEED, "_row_number", canonical_language(F.col("feed_lang")).alias("feed_lang"))).select(FEED, "feed_lang").where("feed_lang is not null and feed_lang <> 'mul'")
    return union([
        notices(rows.where("agency_timezone <> zone1"), "inconsistent_agency_timezone", "ERROR", "agency.txt", expected="zone1", actual="agency_timezone"),
        notices(rows.where("lang <> lang1"), "inconsistent_agency_lang", "WARNING", "agency.txt", expected="lang1", actual="lang"),
        notices(rows.join(info, FEED).where("lang <> feed_lang"), "feed_info_lang_and_agency_lang_mismatch", "WARNING", "agency.txt", feedInfoLang="feed_lang", agencyLang="lang"),
    ])


def default_riders(feed: Feed) -> DataFrame:
    """Fare products with two different default rider categories; the first two by row are named."""
    defaults = feed["rider_categories"].where("is_default_fare_category = 1").select(FEED, "rider_category_id").distinct()
    used = feed["fare_products"].where("rider_category_id is not null").join(defaults, [FEED, "rider_category_id"], "left_semi")
    firsts = used.groupBy(FEED, "fare_product_id", "rider_category_id").agg(F.min("_row_number").alias("n"))
    ranked = firsts.withColumn("k", F.row_number().over(W.partitionBy(FEED, "fare_product_id").orderBy("n"))).where("k <= 2")
    pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    found = ranked.groupBy(FEED, "fare_product_id").agg(pick(2, "n").alias("n2"), pick(1, "n").alias("n1"), pick(1, "rider_category_id").alias("c1"), pick(2, "rider_category_id").alias("c2")).where("n2 is not null")
    return notices(found, "fare_product_with_multiple_default_rider_categories", "ERROR", "fare_products.txt", "n2", fareProductId="fare_product_id", firstRow="n1", riderCategoryId1="c1", riderCategoryId2="c2")
