"""Rules over the rows of a trip or a shape in order.

All windows over stop_times partition by feed and trip, so jobs that start from one
ordered_stop_times() frame share one shuffle of the largest table.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..feed import Feed, first_rows
from ..functions.geo import haversine_m, metres
from ..notices import notices, union

FEED = "feed_id"
TRIP = (FEED, "trip_id")
#: Metres below which a difference of shape distances is told apart.
CLOSE_M, TRIP_CLOSE_M = 1.11, 11.1
FAR_M = 10_000.0
#: km/h by route type; others 200.
SPEED_LIMITS = {0: 100, 1: 150, 2: 500, 3: 150, 4: 80, 5: 30, 6: 50, 7: 50, 11: 150, 12: 150}
OTHER_SPEED = 200


def sequence() -> Column:
    return F.coalesce("stop_sequence", F.lit(0))


def ordered_stop_times(feed: Feed) -> DataFrame:
    """stop_times dealt by trip once; windows over it need no further shuffle."""
    return feed["stop_times"].where("trip_id is not null").repartition(FEED, "trip_id")


def unsorted_stop_times(feed: Feed) -> DataFrame:
    """Trips whose rows, in file order, don't ascend in sequence or don't stand together."""
    times = feed["stop_times"].where("trip_id is not null")
    before = F.last("stop_sequence", True).over(W.partitionBy(*TRIP).orderBy("_row_number").rowsBetween(W.unboundedPreceding, -1))
    rows = times.select(*TRIP, "_row_number", "stop_sequence").withColumn("falls", F.coalesce(F.col("stop_sequence") <= before, F.lit(False)))
    trips = rows.groupBy(*TRIP).agg(F.max("falls").alias("falls"), F.min("_row_number").alias("first"), F.max("_row_number").alias("last"), F.count(F.lit(1)).alias("n"))
    return notices(trips.where("falls or last - first + 1 > n"), "unsorted_stop_times", "ERROR", "stop_times.txt", "first", tripId="trip_id")


def stop_time_times(feed: Feed) -> DataFrame:
    order = W.partitionBy(*TRIP).orderBy("stop_sequence", "_row_number").rowsBetween(W.unboundedPreceding, -1)
    last = lambda c: F.last(F.when(F.col("departure_time").isNotNull(), F.col(c)), True).over(order)
    rows = feed["stop_times"].where("trip_id is not null and stop_sequence is not null").select(*TRIP, "_row_number", "stop_sequence", "arrival_time", "departure_time").withColumns({"earlier": last("departure_time"), "earlierRow": last("_row_number")})
    lone = feed["stop_times"].where("(arrival_time is null) <> (departure_time is null)")
    return notices(lone, "stop_time_with_only_arrival_or_departure_time", "ERROR", "stop_times.txt", tripId="trip_id", stopSequence="stop_sequence").unionByName(
        notices(rows.where("arrival_time < earlier"), "stop_time_with_arrival_before_previous_departure_time", "ERROR", "stop_times.txt", tripId="trip_id", stopSequence="stop_sequence", previousRow="earlierRow")
    )


def trip_edges(feed: Feed) -> DataFrame:
    """First and last rows of a trip without window that lack an arrival or departure."""
    key = F.struct(sequence(), F.col("_row_number"))
    row = F.struct("_row_number", "stop_sequence", "arrival_time", "departure_time", F.coalesce("start_pickup_drop_off_window", "end_pickup_drop_off_window").alias("window"))
    trips = feed["stop_times"].where("trip_id is not null").groupBy(*TRIP).agg(F.array(F.min_by(row, key), F.max_by(row, key)).alias("edges"))
    edges = trips.select(*TRIP, F.posexplode("edges").alias("side", "e")).where("e.window is null")
    fields = F.array(*(F.when(F.col(f"e.{f}").isNull(), F.lit(f)) for f in ("arrival_time", "departure_time")))
    lacking = edges.select(*TRIP, "side", "e.*", F.explode(F.filter(fields, lambda f: f.isNotNull())).alias("field"))
    return notices(lacking, "missing_trip_edge", "ERROR", "stop_times.txt", tripId="trip_id", stopSequence="stop_sequence", specifiedField="field", edge=F.when(F.col("side") == 0, "first").otherwise("last"))


def stop_time_distance(feed: Feed) -> DataFrame:
    order = W.partitionBy(*TRIP).orderBy(sequence(), "_row_number")
    rows = feed["stop_times"].where("trip_id is not null and stop_id is not null").select(*TRIP, "_row_number", "stop_sequence", "shape_dist_traveled")
    rows = rows.withColumns({"before": F.lag("shape_dist_traveled").over(order), "previousRow": F.lag("_row_number").over(order)})
    return notices(rows.where("shape_dist_traveled <= before"), "decreasing_or_equal_stop_time_distance", "ERROR", "stop_times.txt", tripId="trip_id", stopSequence="stop_sequence", previousRow="previousRow")


def shape_distance(feed: Feed) -> DataFrame:
    """Neighbouring shape points whose distances fall or stay the same."""
    order = W.partitionBy(FEED, "shape_id").orderBy("shape_pt_sequence", "_row_number")
    rows = feed["shapes"].where("shape_id is not null").withColumn("p", F.lag(F.struct("shape_pt_lat", "shape_pt_lon", "shape_dist_traveled", "_row_number")).over(order))
    rows = rows.withColumn("m", haversine_m(F.col("p.shape_pt_lat"), F.col("p.shape_pt_lon"), F.col("shape_pt_lat"), F.col("shape_pt_lon")))
    same = F.expr("shape_pt_lat = p.shape_pt_lat and shape_pt_lon = p.shape_pt_lon")
    code = (
        F.when(F.col("shape_dist_traveled") < F.col("p.shape_dist_traveled"), "decreasing_shape_distance")
        .when(F.col("shape_dist_traveled") != F.col("p.shape_dist_traveled"), None)
        .when(same, "equal_shape_distance_same_coordinates").when(F.col("m") >= CLOSE_M, "equal_shape_distance_diff_coordinates")
        .when(F.col("m") > 0, "equal_shape_distance_diff_coordinates_distance_below_threshold")
    )
    found = rows.where("shape_dist_traveled is not null and p.shape_dist_traveled is not null").withColumn("code", code).where("code is not null")
    severity = {"equal_shape_distance_same_coordinates": "WARNING", "equal_shape_distance_diff_coordinates_distance_below_threshold": "WARNING"}
    out = []
    for level in ("ERROR", "WARNING"):
        own = F.col("code").isin(list(severity))
        out.append(notices(found.where(own if level == "WARNING" else ~own), F.col("code"), level, "shapes.txt", shapeId="shape_id", shapePtSequence="shape_pt_sequence", previousRow="p._row_number"))
    return union(out)


def adjacent_overlap(feed: Feed) -> DataFrame:
    """Frequencies of a trip, and timeframes of a group and service, that start before the previous ends."""
    def overlaps(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
        zero = {c: F.coalesce(c, F.lit(0)) for c in ("start_time", "end_time")}
        by = W.partitionBy(FEED, *keys).orderBy(*(F.coalesce(c, F.lit(0)) for c in order), "_row_number")
        rows = df.withColumns(zero).withColumns({"before": F.lag("end_time").over(by), "previousRow": F.lag("_row_number").over(by)})
        return rows.where("start_time < before")

    frequencies = overlaps(feed["frequencies"].where("trip_id is not null"), ["trip_id"], ["start_time", "end_time", "headway_secs"])
    frames = overlaps(feed["timeframes"], ["timeframe_group_id", "service_id"], ["start_time", "end_time"])
    return notices(frequencies, "overlapping_frequency", "ERROR", "frequencies.txt", tripId="trip_id", previousRow="previousRow").unionByName(
        notices(frames, "timeframe_overlap", "ERROR", "timeframes.txt", timeframeGroupId="timeframe_group_id", serviceId="service_id", previousRow="previousRow")
    )


def trip_vs_shape_distance(feed: Feed) -> DataFrame:
    """Trips that go farther than their shape, by how far the last stop lies from the shape's farthest point."""
    last = feed["stop_times"].where("trip_id is not null and stop_sequence is not null").groupBy(*TRIP).agg(F.max_by(F.struct("stop_id", "shape_dist_traveled"), F.struct("stop_sequence", "_row_number")).alias("t"))
    distance = F.coalesce("shape_dist_traveled", F.lit(0.0))
    end = feed["shapes"].where("shape_id is not null").groupBy(FEED, "shape_id").agg(F.max_by(F.struct("shape_pt_lat", "shape_pt_lon", distance.alias("d")), F.struct(distance, -F.col("_row_number"))).alias("s"))
    places = first_rows(feed["stops"].where("stop_id is not null").select(FEED, "stop_id", "stop_lat", "stop_lon", "_row_number"), "stop_id").drop("_row_number")
    trips = feed["trips"].where("trip_id is not null and shape_id is not null").select(*TRIP, "shape_id", "_row_number")
    rows = trips.join(last, list(TRIP)).join(end, [FEED, "shape_id"]).where("t.shape_dist_traveled > s.d and s.d > 0").withColumn("stop_id", F.col("t.stop_id")).join(places, [FEED, "stop_id"])
    rows = rows.withColumn("m", haversine_m(F.col("stop_lat"), F.col("stop_lon"), F.col("s.shape_pt_lat"), F.col("s.shape_pt_lon"))).where("m is not null")
    context = {"tripId": F.col("trip_id"), "shapeId": F.col("shape_id"), "distance": metres(F.col("m"))}
    return notices(rows.where(F.col("m") > TRIP_CLOSE_M), "trip_distance_exceeds_shape_distance", "ERROR", "trips.txt", **context).unionByName(
        notices(rows.where(F.col("m") <= TRIP_CLOSE_M), "trip_distance_exceeds_shape_distance_below_threshold", "WARNING", "trips.txt", **context)
    )


def headsign(feed: Feed) -> DataFrame:
    """Headsigns that name a stop before the last. Trips after a feed's first circular trip are not looked at."""
    key = F.struct(sequence(), F.col("_row_number"))
    ends = feed["stop_times"].where("trip_id is not null").groupBy(*TRIP).agg(F.min_by("stop_id", key).alias("first"), F.max_by("stop_id", key).alias("last"), F.max(key).alias("end"), F.count(F.lit(1)).alias("n"))
    trips = feed["trips"].where("trip_id is not null and trip_headsign is not null").select(*TRIP, "trip_headsign", F.col("_row_number").alias("trip_row")).join(ends.where("n >= 2"), list(TRIP))
    circular = trips.where("first = last").groupBy(FEED).agg(F.min("trip_row").alias("stop_at"))
    trips = trips.join(circular, FEED, "left").where("stop_at is null or trip_row < stop_at")
    names = first_rows(feed["stops"].where("stop_id is not null and stop_name is not null").select(FEED, "stop_id", "stop_name", "_row_number"), "stop_id").drop("_row_number")
    visits = feed["stop_times"].select(*TRIP, "stop_id", "stop_sequence", "_row_number").join(trips, list(TRIP)).where(key < F.col("end"))
    found = visits.join(names, [FEED, "stop_id"]).where("lower(stop_name) = lower(trip_headsign)")
    return notices(found, "trip_headsign_matches_intermediate_stop", "WARNING", "stop_times.txt", tripId="trip_id", tripRow="trip_row", stopId="stop_id")


def speed_limit(route_type: Column) -> Column:
    limits = F.create_map(*map(F.lit, chain.from_iterable(SPEED_LIMITS.items())))
    return F.coalesce(F.try_element_at(limits, route_type), F.lit(OTHER_SPEED))


def speed_kph(m: Column, departure: Column, arrival: Column) -> Column:
    """Over the time between, at least a minute, and a minute more where both are whole minutes."""
    t = arrival - departure
    t = F.when(t <= 0, 60).otherwise(t) + F.when((arrival % 60 == 0) & (departure % 60 == 0), 60).otherwise(0)
    return m / 1000 * 3600 / t


def in_trip() -> W:
    """A trip's rows of measured_stop_times in order. `at` is a column, as windows share no sort by an expression."""
    return W.partitionBy(*TRIP).orderBy("at", "_row_number")


def trip_limits(feed: Feed) -> DataFrame:
    """feed_id, trip_id, limit: the speed limit of trips with a route."""
    types = first_rows(feed["routes"].where("route_id is not null").select(FEED, "route_id", "route_type", "_row_number"), "route_id").drop("_row_number")
    trips = feed["trips"].where("trip_id is not null").groupBy(*TRIP).agg(F.min_by("route_id", "_row_number").alias("route_id")).join(types, [FEED, "route_id"])
    return trips.select(*TRIP, speed_limit(F.col("route_type")).alias("limit"))


def measured_stop_times(feed: Feed) -> DataFrame:
    """stop_times with coordinates, and `k` from 0 in the trip, by `at` (their sequence).

    Rows go to their stops first and then by trip, once: what is asked of a trip's rows in order needs neither another shuffle nor another sort.
    """
    from .distances import stop_coordinates

    times = feed["stop_times"].where("trip_id is not null").select(*TRIP, "stop_id", "stop_sequence", sequence().alias("at"), "arrival_time", "departure_time", "_row_number")
    placed = times.join(stop_coordinates(feed).select(FEED, "stop_id", "lat", "lon"), [FEED, "stop_id"], "left").drop("stop_id")
    return placed.withColumn("k", F.row_number().over(in_trip()) - 1)


def fast_consecutive(feed: Feed) -> DataFrame:
    """Neighbouring measurable stops of a trip between which it is faster than its route type allows.

    Only steps beyond the lowest limit are joined to their trip's.
    """
    order = in_trip()
    rows = measured_stop_times(feed).withColumn("starts", F.first(F.expr("lat is not null and departure_time is not null")).over(order))
    kept = rows.where("starts and (k = 0 or lat is not null and arrival_time is not null)")
    kept = kept.withColumn("p", F.lag(F.struct("lat", "lon", "departure_time", "_row_number")).over(order))
    # the chain ends at the first kept row without departure
    kept = kept.withColumn("open", F.coalesce(F.min(F.col("departure_time").isNotNull()).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(True)))
    m = haversine_m(F.col("p.lat"), F.col("p.lon"), F.col("lat"), F.col("lon"))
    steps = kept.where("k > 0 and open").withColumn("kph", speed_kph(m, F.col("p.departure_time"), F.col("arrival_time"))).where(F.col("kph") > min(OTHER_SPEED, *SPEED_LIMITS.values()))
    fast = steps.join(trip_limits(feed), list(TRIP)).where(F.col("kph") > F.col("limit"))
    return notices(fast, "fast_travel_between_consecutive_stops", "WARNING", "stop_times.txt", tripId="trip_id", stopSequence="stop_sequence", previousRow="p._row_number", speedKph=F.round("kph").cast("long"))


def fast_far(feed: Feed) -> DataFrame:
    """For each trip the first pair of stops over 10 km apart between which it is too fast.

    Distances are sums of hops, held as running sums, up to the first stop without a place. Only
    trips longer than that distance are looked at further; their steps come together in one row,
    on the exchange by trip that the sums have made already.
    """
    by = in_trip()
    unresolved = F.sum(F.expr("case when lat is null then 1 else 0 end")).over(by)
    hop = haversine_m(F.lag("lat").over(by), F.lag("lon").over(by), F.col("lat"), F.col("lon"))
    rows = measured_stop_times(feed).withColumns({"gone": unresolved, "hop": F.coalesce(hop, F.lit(0.0))}).where("gone = 0")
    rows = rows.withColumn("metres", F.sum("hop").over(by))
    step = F.struct("k", "arrival_time", "departure_time", F.col("metres").alias("at"))
    trips = rows.groupBy(*TRIP).agg(F.max("metres").alias("length"), F.array_sort(F.collect_list(step)).alias("steps")).where(F.col("length") > FAR_M)
    trips = trips.join(trip_limits(feed), list(TRIP))

    def pairs(b: Column) -> Column:
        far = lambda a: (a["k"] < b["k"]) & a["departure_time"].isNotNull() & (b["at"] - a["at"] > FAR_M)
        fast = lambda a: far(a) & (speed_kph(b["at"] - a["at"], a["departure_time"], b["arrival_time"]) > F.col("limit"))
        return F.transform(F.filter("steps", fast), lambda a: F.struct(b["k"].alias("k"), (-a["k"]).alias("back")))

    arrivals = F.filter("steps", lambda b: b["arrival_time"].isNotNull())
    found = trips.withColumn("f", F.array_min(F.flatten(F.transform(arrivals, pairs)))).where("f is not null")
    return notices(found, "fast_travel_between_far_stops", "WARNING", "stop_times.txt", None, tripId="trip_id", fromStep=-F.col("f.back"), toStep="f.k")

