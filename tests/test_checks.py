"""Checks on small feeds, with results worked out by hand."""

import datetime
import re

import pytest

from headway.jobs.runner import run_checks
from headway.notices import compare, report, severity_totals
from headway.operators import aggregates, calendars, distances, graph, joins, keys, matcher, polygons, rowrules, sequences, zones
from pyspark.sql import functions as F

from .feeds import codes, feed, pairs, stop_times

USAGE = dict(
    stops=[dict(stop_id="S1"), dict(stop_id="S2"), dict(stop_id="ST1", location_type=1), dict(stop_id="S3"), dict(stop_id="E1", location_type=2, parent_station="ST1"), dict(stop_id="S4", parent_station="ST1")],
    trips=[dict(trip_id=f"T{i}", shape_id="H1" if i == 1 else None) for i in range(1, 5)],
    shapes=[dict(shape_id="H1", shape_pt_sequence=1), dict(shape_id="H2", shape_pt_sequence=1), dict(shape_id="H2", shape_pt_sequence=2)],
    stop_times=stop_times(("T1", "S1", 1), ("T1", "S4", 2), ("T3", "S1", 5), ("T3", None, 4), ("T4", "ST1", 1), ("T1", "S1", 3)),
    location_group_stops=[dict(location_group_id="G1", stop_id="S3")],
)
USAGE["stop_times"][3]["location_group_id"] = "G1"


def test_usage(spark):
    f = feed(spark, **USAGE)
    assert pairs(joins.usage(f)) == [("unusable_trip", 3), ("unusable_trip", 5), ("unused_shape", 3), ("unused_trip", 3)]
    assert pairs(joins.stop_usage(f)) == [("location_with_unexpected_stop_time", 4), ("stop_without_stop_time", 3)]
    assert pairs(sequences.unsorted_stop_times(f)) == [("unsorted_stop_times", 2), ("unsorted_stop_times", 4)]


def test_duplicate_keys(spark):
    f = feed(spark, stops=[dict(stop_id="S1"), dict(stop_id="S2"), dict(stop_id=None), dict(stop_id="S1"), dict(stop_id=None)], frequencies=[dict(trip_id="A", start_time=None), dict(trip_id="A", start_time=0), dict(trip_id="B", start_time=3661), dict(trip_id="B", start_time=3661)])
    assert codes(keys.duplicate_key(f, "stops")) == [("duplicate_key", 5, {"oldCsvRowNumber": "2", "fieldName": "stop_id", "fieldValue": "S1"})]
    found = codes(keys.duplicate_key(f, "frequencies"))
    assert [(n, c["fieldValue"]) for _, n, c in found] == [(3, "A"), (5, "B,01:01:01")]


def test_foreign_keys_and_nulls(spark):
    f = feed(spark, routes=[dict(route_id="R1"), dict(route_id=None)], trips=[dict(trip_id="T1", route_id="R1", service_id="W"), dict(trip_id="T2", route_id="GHOST", service_id="X"), dict(trip_id="T3", route_id=None)], calendar=[dict(service_id="W")])
    f.tables["trips"] = f.tables["trips"].select("feed_id", "_row_number", "trip_id", "route_id", "service_id")
    assert [(n, c["childFieldName"], c["fieldValue"]) for _, n, c in codes(keys.foreign_key_violation(f))] == [(3, "route_id", "GHOST"), (3, "service_id", "X")]


def test_feeds_do_not_mix(spark):
    a = feed(spark, "a", routes=[dict(route_id="R1")], trips=[dict(trip_id="T", route_id="R1")])
    b = feed(spark, "b", routes=[dict(route_id="R2")], trips=[dict(trip_id="T", route_id="R1")])
    for n in a.tables:
        keep = ["feed_id", "_row_number", "trip_id", "route_id"] if n == "trips" else a.tables[n].columns
        a.tables[n] = a.tables[n].select(*keep).unionByName(b.tables[n].select(*keep))
    assert [r["feed_id"] for r in keys.foreign_key_violation(a).collect()] == ["b"]
    assert keys.duplicate_key(a, "trips").count() == 0


def test_row_rules(spark):
    f = feed(
        spark,
        stops=[dict(stop_id="a", location_type=1, parent_station="b", stop_lat=0.5, stop_lon=-0.5), dict(stop_id="b", location_type=3), dict(stop_id="c", stop_name="Pole", stop_lat=89.5, stop_lon=1.0)],
        routes=[dict(route_id="r", route_color=0, route_text_color=0x202020, route_short_name="\U0001f68c" * 7), dict(route_id="q", route_short_name="10", route_long_name="10 - Main", route_color=0, route_text_color=0xFFFFFF)],
        booking_rules=[dict(booking_rule_id="k", booking_type=0, prior_notice_duration_min=5, prior_notice_last_day=1)],
    )
    found = codes(rowrules.row_notices(f))
    have = {(c, x.get("stop_id") or x.get("route_id") or x.get("booking_rule_id")) for c, _, x in found}
    assert {("missing_stop_name", "a"), ("station_with_parent_station", "a"), ("point_near_origin", "a"), ("location_without_parent_station", "b"), ("point_near_pole", "c"), ("route_color_contrast", "r"), ("route_short_name_too_long", "r"), ("route_long_name_contains_short_name", "q"), ("forbidden_real_time_booking_field_value", "k")} <= have
    assert ("stop_without_location", "b") not in have and ("route_color_contrast", "q") not in have
    assert next(x["fieldNames"] for c, _, x in found if c == "forbidden_real_time_booking_field_value") == "prior_notice_duration_min, prior_notice_last_day"


def test_own_row_rule(spark):
    f = feed(spark, stops=[dict(stop_id="a", stop_name="X")])
    rule = rowrules.RowRule("loud", "INFO", "stops", "stop_name = upper(stop_name)", ("stop_id",))
    assert codes(rowrules.row_notices(f, [rule])) == [("loud", 2, {"stop_id": "a"})]


def test_times(spark):
    f = feed(spark, stop_times=stop_times(("T", "a", 1, 100, 200), ("T", "b", 2, None, None), ("T", "c", 3, 150, None), ("T", "d", None, 1, 1), ("U", "a", 1, 5, None)))
    assert pairs(sequences.stop_time_times(f)) == [("stop_time_with_arrival_before_previous_departure_time", 4), ("stop_time_with_only_arrival_or_departure_time", 4), ("stop_time_with_only_arrival_or_departure_time", 6)]
    assert [(n, c["edge"]) for _, n, c in codes(sequences.trip_edges(f)) if c["tripId"] == "U"] == [(6, "first"), (6, "last")]


FAST = dict(
    routes=[dict(route_id="R", route_type=3)], trips=[dict(trip_id="T", route_id="R"), dict(trip_id="U", route_id="R")],
    stops=[dict(stop_id=s, stop_lat=40.0 + 0.05 * i, stop_lon=-74.0) for i, s in enumerate("ABC")],
)


def test_fast_travel(spark):
    times = stop_times(("T", "A", 1, 28800, 28800), ("T", "B", 2, 28860, 28860), ("T", "C", 3, 28920, 28920), ("U", "A", 1, 28800, 28800), ("U", "B", 2, 29400, 29400), ("U", "C", 3, 29430, 29430))
    found = codes(sequences.fast_consecutive(feed(spark, **FAST, stop_times=times)))
    # 5.5598 km in two minutes where both times are whole minutes
    assert [(n, c["speedKph"]) for _, n, c in found] == [(3, "167"), (4, "167"), (7, "667")]
    far = codes(sequences.fast_far(feed(spark, **FAST, stop_times=times)))
    assert [(c["tripId"], c["fromStep"], c["toStep"]) for _, _, c in far] == [("T", "0", "2")]


def test_fast_travel_sorts_trips_once(spark):
    """Rows go by trip once, after their stops, and all that looks at neighbours shares one sort."""
    times = stop_times(("T", "A", 1, 0, 0), ("T", "B", 2, 60, 60))
    plan = sequences.fast_consecutive(feed(spark, **FAST, stop_times=times))._jdf.queryExecution().executedPlan().toString()
    by = re.findall(r"Sort \[feed_id#[^\]]*, trip_id#[^\]]*, [^\]]*\]", plan)
    assert len(by) == 1, by


def test_fast_chain_stops_without_departure(spark):
    times = stop_times(("T", "A", 1, 0, 0), ("T", "B", 2, 10, None), ("T", "C", 3, 20, 20))
    assert [n for _, n, _ in codes(sequences.fast_consecutive(feed(spark, **FAST, stop_times=times)))] == [3]
    silent = stop_times(("T", "A", 1, 0, None), ("T", "B", 2, 10, 10), ("T", "C", 3, 20, 20))
    assert sequences.fast_consecutive(feed(spark, **FAST, stop_times=silent)).count() == 0


def test_distances(spark):
    f = feed(spark, stops=[dict(stop_id="A", stop_lat=40.0, stop_lon=-74.0), dict(stop_id="B", parent_station="A"), dict(stop_id="C", stop_lat=40.05, stop_lon=-74.0), dict(stop_id="D", parent_station="B"), dict(stop_id="E")], transfers=[dict(from_stop_id="A", to_stop_id="C"), dict(from_stop_id="B", to_stop_id="D"), dict(from_stop_id="A", to_stop_id="E")])
    assert {(r["stop_id"], r["lat"]) for r in distances.stop_coordinates(f).collect()} == {("A", 40.0), ("B", 40.0), ("C", 40.05), ("D", 40.0), ("E", None)}
    assert [(c, n, x["distance"]) for c, n, x in codes(distances.transfer_distance(f))][0] == ("transfer_distance_above_2_km", 2, "5560")
    assert pairs(distances.transfer_distance(f))[1] == ("transfer_distance_too_large", 4)


def test_closest_shape_point_beyond_nearby_cells(spark):
    # at 60 degrees a cell is 0.56 km wide: the box of the diagonal reaches the stop's neighbour
    # cells, the upright at the end lies past them and is nearer
    pts = [(60.018, 10.0), (60.045, 9.94), (60.045, 10.0215), (59.98, 10.0215)]
    f = feed(
        spark, shapes=[dict(shape_id="H", shape_pt_lat=a, shape_pt_lon=b, shape_pt_sequence=i) for i, (a, b) in enumerate(pts)],
        stops=[dict(stop_id="Near", stop_lat=60.005, stop_lon=10.0005), dict(stop_id="Far", stop_lat=60.0, stop_lon=12.0), dict(stop_id="On", stop_lat=60.045, stop_lon=10.0)],
        trips=[dict(trip_id="T", shape_id="H")], stop_times=stop_times(("T", "Near", 1), ("T", "Far", 2), ("T", "On", 3)),
    )
    found = {r["stop_id"]: r["distance_m"] for r in matcher.closest_shape_point(f).collect()}
    assert set(found) == {"Near", "Far", "On"}
    assert found["On"] < 1
    assert found["Near"] == pytest.approx(0.021 * 111_195 * 0.49992, rel=0.001)
    assert found["Far"] == pytest.approx(109_966, rel=0.001)


def test_shape_distance(spark):
    pts = [(40.0, -74.0, 1, 0.0), (40.0, -74.0, 2, 0.0), (40.1, -74.0, 3, 0.0), (40.1, -74.0, 4, None), (40.2, -74.0, 5, 3.0), (40.2, -74.0, 6, 2.0), (40.200001, -74.0, 7, 2.0)]
    f = feed(spark, shapes=[dict(shape_id="H", shape_pt_lat=a, shape_pt_lon=b, shape_pt_sequence=c, shape_dist_traveled=d) for a, b, c, d in pts])
    assert pairs(sequences.shape_distance(f)) == [("decreasing_shape_distance", 7), ("equal_shape_distance_diff_coordinates", 4), ("equal_shape_distance_diff_coordinates_distance_below_threshold", 8), ("equal_shape_distance_same_coordinates", 3)]


def test_headsign_stops_at_circular_trip(spark):
    f = feed(
        spark, stops=[dict(stop_id=s, stop_name=f"Name {s}") for s in "ABC"], trips=[dict(trip_id=t, trip_headsign="name b") for t in ("T1", "T2", "T3")],
        stop_times=stop_times(("T1", "A", 1), ("T1", "B", 2), ("T1", "C", 3), ("T2", "A", 1), ("T2", "B", 2), ("T2", "A", 3), ("T3", "A", 1), ("T3", "B", 2), ("T3", "C", 3)),
    )
    assert pairs(sequences.headsign(f)) == [("trip_headsign_matches_intermediate_stop", 3)]


WEEK = dict.fromkeys(calendars.DAYS, 1)


def day(text):
    return datetime.date.fromisoformat(text)


def test_two_readings_of_exceptions(spark):
    f = feed(spark, calendar=[WEEK | dict(service_id="W", start_date=day("2026-06-01"), end_date=day("2026-06-03"))], calendar_dates=[dict(service_id="W", date=day("2026-06-05"), exception_type=2), dict(service_id="W", date=day("2026-06-05"), exception_type=1), dict(service_id="W", date=day("2026-06-02"), exception_type=2)])
    assert sorted(str(r["date"]) for r in calendars.active_dates(f).collect()) == ["2026-06-01", "2026-06-03"]
    assert sorted((str(r["first"]), str(r["last"])) for r in calendars.service_runs(f).collect()) == [("2026-06-01", "2026-06-01"), ("2026-06-03", "2026-06-03"), ("2026-06-05", "2026-06-05")]


def test_long_spans_are_whole(spark):
    f = feed(
        spark, calendar=[WEEK | dict(service_id="W", start_date=day("1900-01-01"), end_date=day("2099-12-31")), WEEK | dict(service_id="X", start_date=day("0001-01-01"), end_date=day("9999-12-31"))],
        trips=[dict(trip_id=t, service_id=s, block_id="B") for t, s in (("T1", "W"), ("T2", "W"))], stop_times=stop_times(("T1", "A", 1, 100, 100), ("T1", "B", 2, 300, 310), ("T2", "B", 1, 200, 200), ("T2", "A", 2, 400, 400)),
        calendar_dates=[dict(service_id="W", date=day("1900-01-01"), exception_type=2)],
    )
    found = {r["service_id"]: (str(r["a"]), str(r["b"]), r["n"]) for r in calendars.active_dates(f).groupBy("service_id").agg(F.min("date").alias("a"), F.max("date").alias("b"), F.count_distinct("date").alias("n")).collect()}
    assert found == {"W": ("1900-01-02", "2099-12-31", 73048), "X": ("0001-01-01", "9999-12-31", 3652059)}
    assert [(str(r["first"]), str(r["last"])) for r in calendars.service_runs(f).where("service_id = 'W'").collect()] == [("1900-01-02", "2099-12-31")]
    assert calendars.expired_calendar(f, day("2026-06-01")).count() == 0
    assert [c["date"] for _, _, c in codes(calendars.block_overlap(f))] == ["1900-01-02"]


def test_lone_calendar_rows_are_told_without_their_dates(spark):
    """Runs and ends of rows that alone tell a service, against their dates one by one; no shuffle of dates."""
    bits = [dict(zip(calendars.DAYS, [n >> i & 1 for i in range(7)], strict=True)) for n in range(128)]
    rows = [b | dict(service_id=f"W{n}-{k}", start_date=day("2026-06-01") + datetime.timedelta(k), end_date=day("2026-06-01") + datetime.timedelta(k + length)) for n, b in enumerate(bits) for k, length in ((0, 6), (2, 17), (4, 1), (6, -3))]
    rows += [WEEK | dict(service_id="E", start_date=day("2026-06-01"), end_date=day("2026-06-05"))]
    f = feed(spark, calendar=rows, calendar_dates=[dict(service_id="E", date=day("2026-06-03"), exception_type=2)])
    dates: dict[str, set[datetime.date]] = {}
    for r in rows:
        span = [r["start_date"] + datetime.timedelta(i) for i in range(max((r["end_date"] - r["start_date"]).days, 0) + 1)]
        dates[r["service_id"]] = {d for d in span if r[calendars.DAYS[d.weekday()]]} - ({day("2026-06-03")} if r["service_id"] == "E" else set())
    one = datetime.timedelta(1)
    runs = {(s, a, min(b for b in ds if b >= a and b + one not in ds)) for s, ds in dates.items() for a in ds if a - one not in ds}
    assert sorted(tuple(r) for r in calendars.service_runs(f).select("service_id", "first", "last").collect()) == sorted(runs)
    assert sorted(tuple(r) for r in calendars.service_spans(f).select("service_id", "first", "last").collect()) == sorted((s, min(ds), max(ds)) for s, ds in dates.items() if ds)
    assert sorted(tuple(r) for r in calendars.active_dates(f).select("service_id", "date").collect()) == sorted((s, d) for s, ds in dates.items() for d in ds)
    lone, rest = calendars.service_dates(f)
    assert lone.count() == len(rows) - 1 and {r["service_id"] for r in rest.collect()} == {"E"}


def test_trips_per_date(spark):
    f = feed(spark, calendar=[WEEK | dict(service_id="W", start_date=day("2026-06-01"), end_date=day("2026-06-02"))], trips=[dict(trip_id=t, service_id="W") for t in "ABC"], frequencies=[dict(trip_id="A", start_time=28800, end_time=64800, headway_secs=600)])
    assert {(str(r["date"]), r["n_trips"]) for r in calendars.trips_per_date(f).collect()} == {("2026-06-01", 62), ("2026-06-02", 62)}
    f.tables["frequencies"] = f.tables["frequencies"].limit(0)
    assert {r["n_trips"] for r in calendars.trips_per_date(f).collect()} == {3}


@pytest.mark.parametrize(("second", "service", "want"), [((200, 200, 400, 400), "W", 1), ((300, 310, 400, 400), "W", 0), ((300, 300, 400, 400), "W", 0), ((200, 200, 400, 400), "X", 0)])
def test_block_overlap(spark, second, service, want):
    a, b, c, d = second
    f = feed(
        spark, calendar=[WEEK | dict(service_id="W", start_date=day("2026-06-01"), end_date=day("2026-06-05")), WEEK | dict(service_id="X", start_date=day("2027-06-01"), end_date=day("2027-06-05"))],
        trips=[dict(trip_id="T1", service_id="W", block_id="B"), dict(trip_id="T2", service_id=service, block_id="B")], stop_times=stop_times(("T1", "A", 1, 100, 100), ("T1", "B", 2, 300, 310), ("T2", "B", 1, a, b), ("T2", "A", 2, c, d)),
    )
    found = codes(calendars.block_overlap(f))
    assert len(found) == (want if (a, b) != (300, 300) else 1)
    assert all(c["date"] == "2026-06-01" for _, _, c in found)


def test_windows(spark):
    f = feed(
        spark, calendar=[WEEK | dict(service_id="W", start_date=day("2026-06-01"), end_date=day("2026-06-03"))], trips=[dict(trip_id="T", service_id="W")], calendar_dates=[dict(service_id="W", date=day("2026-07-01"), exception_type=1)],
        feed_info=[dict(feed_start_date=day("2026-06-02"), feed_end_date=day("2026-08-01"))],
    )
    gap = codes(calendars.service_windows(f, day("2026-01-01")))
    assert [(c, x["gapStart"], x["gapEnd"]) for c, _, x in gap] == [("big_gap_in_service", "2026-06-03", "2026-07-01")]
    assert [c for c, _, _ in codes(calendars.feed_windows(f, day("2026-01-01")))] == ["feed_valid_beyond_total_service_window", "future_calendar", "service_window_outside_feed_period"]
    assert pairs(calendars.expired_calendar(f, day("2026-08-01"))) == [("expired_calendar", 2)]
    assert pairs(calendars.feed_dates(f, day("2026-07-15"))) == [("feed_expiration_date30_days", 2)]


def test_block_types_and_single_points(spark):
    f = feed(spark, routes=[dict(route_id="R1", route_type=3), dict(route_id="R2", route_type=0)], trips=[dict(trip_id="a", route_id="R2", block_id="B"), dict(trip_id="b", route_id="R1", block_id="B"), dict(trip_id="c", route_id="R2", block_id="B")], shapes=[dict(shape_id="H", shape_pt_sequence=0), dict(shape_id="K", shape_pt_sequence=0), dict(shape_id="K", shape_pt_sequence=1)])
    assert codes(aggregates.block_route_types(f))[0][2] == {"blockId": "B", "routeIds": "R2,R1", "routeTypes": "0,3"}
    assert pairs(aggregates.single_points(f)) == [("single_shape_point", 2)]


def test_reachability(spark):
    stops = [dict(stop_id="ST", location_type=1), dict(stop_id="EN", location_type=2, parent_station="ST"), dict(stop_id="P1", parent_station="ST"), dict(stop_id="P2", parent_station="ST"), dict(stop_id="P3", parent_station="ST")]
    ways = [dict(pathway_id="w1", from_stop_id="EN", to_stop_id="P1", pathway_mode=1, is_bidirectional=1), dict(pathway_id="w2", from_stop_id="P1", to_stop_id="P3", pathway_mode=1, is_bidirectional=0)]
    found = codes(graph.pathway_unreachable_location(feed(spark, stops=stops, pathways=ways)))
    assert [(n, c["hasEntrance"], c["hasExit"]) for _, n, c in found] == [(5, "false", "false"), (6, "true", "false")]


SHAPE = dict(
    shapes=[dict(shape_id="H", shape_pt_lat=40.0, shape_pt_lon=-74 + 0.005 * i, shape_pt_sequence=i, shape_dist_traveled=float(i)) for i in range(3)],
    stops=[dict(stop_id=s, stop_lat=a, stop_lon=b) for s, a, b in (("First", 40.0, -74.0), ("Far", 40.003, -73.995), ("Near", 40.0005, -73.995), ("Last", 40.0, -73.99))],
)


@pytest.mark.parametrize(("kind", "stops", "want"), [(3, ["First", "Near", "Last"], []), (3, ["First", "Far", "Last"], ["stop_too_far_from_shape"]), (2, ["Far", "Last"], []), (3, ["Last", "Near", "First"], ["stops_match_shape_out_of_order"])])
def test_stop_to_shape(spark, kind, stops, want):
    f = feed(spark, **SHAPE, routes=[dict(route_id="R", route_type=kind)], trips=[dict(trip_id=t, route_id="R", shape_id="H") for t in ("T", "U")], stop_times=stop_times(*((t, s, i) for t in ("T", "U") for i, s in enumerate(stops))))
    assert [(c, n) for c, n, _ in codes(matcher.stop_to_shape(f))] == [(w, 2) for w in want]


def test_user_distance(spark):
    f = feed(spark, **SHAPE, routes=[dict(route_id="R", route_type=3)], trips=[dict(trip_id="T", route_id="R", shape_id="H")], stop_times=stop_times(("T", "First", 0, None, None, 0.0), ("T", "Near", 1, None, None, 1.9), ("T", "Last", 2, None, None, 2.0)))
    assert [(c, x["stopId"]) for c, _, x in codes(matcher.stop_to_shape(f))] == [("stop_too_far_from_shape_using_user_distance", "Near")]


def test_every_pattern_out_of_order(spark):
    trips = {"T": ["Last", "Near", "First"], "U": ["Last", "Near", "First", "First"], "V": ["First", "Far", "Last"], "W": ["First", "Far", "Far", "Last"]}
    f = feed(spark, **SHAPE, routes=[dict(route_id="R", route_type=3)], trips=[dict(trip_id=t, route_id="R", shape_id="H") for t in trips], stop_times=stop_times(*((t, s, i) for t, stops in trips.items() for i, s in enumerate(stops))))
    found = [(c, n, x.get("stopId"), x.get("stopId1"), x.get("stopId2")) for c, n, x in codes(matcher.stop_to_shape(f))]
    assert found == [("stop_too_far_from_shape", 4, "Far", None, None), ("stops_match_shape_out_of_order", 2, None, "Near", "Last"), ("stops_match_shape_out_of_order", 3, None, "Near", "Last")]


def test_too_far_by_either_distance_is_one(spark):
    f = feed(spark, **SHAPE, routes=[dict(route_id="R", route_type=3)], trips=[dict(trip_id="T", route_id="R", shape_id="H")], stop_times=stop_times(("T", "First", 0, None, None, 0.0), ("T", "Far", 1, None, None, 1.9), ("T", "Last", 2, None, None, 2.0)))
    assert [(c, x["stopId"]) for c, _, x in codes(matcher.stop_to_shape(f))] == [("stop_too_far_from_shape", "Far")]


RING = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]


@pytest.mark.parametrize(("coordinates", "want"), [
    ([RING], None), ([RING[:4]], "unclosed ring"), ([[[0, 0], [1, 1], [0, 0]]], "too few points"), ([[[0, 0], [4, 4], [4, 0], [0, 4], [0, 0]]], "self-crossing"), ([[[0, 0], [400, 0], [4, 4], [0, 0]]], "bad coordinates"), ("x", "bad coordinates"),
    ([RING, [[5, 5], [6, 5], [6, 6], [5, 5]]], "hole outside shell"), ([RING, [[1, 1], [3, 1], [3, 3], [1, 3], [1, 1]], [[1.5, 1.5], [2, 1.5], [2, 2], [1.5, 1.5]]], "nested holes"),
])
def test_rings(coordinates, want):
    import json

    assert polygons.geometry_problem("Polygon", json.dumps(coordinates)) == want


def test_overlaps():
    import numpy as np

    box = lambda x, y, n: [[np.array([[x, y], [x + n, y], [x + n, y + n], [x, y + n], [x, y]], float)]]
    assert zones.overlap(box(0, 0, 2), box(1, 0, 2)) and zones.overlap(box(0, 0, 2), box(1, 1, 2)) and zones.overlap(box(0, 0, 4), box(1, 1, 1)) and zones.overlap(box(0, 0, 2), box(0, 0, 2))
    assert not zones.overlap(box(0, 0, 1), box(1, 0, 1)) and not zones.overlap(box(0, 0, 1), box(5, 5, 1))


def test_translations_look_for_the_records_asked_for(spark, monkeypatch):
    """All records go past the keys that translations name; only these are held."""
    asked, real = [], keys.picked
    monkeypatch.setattr(keys, "picked", lambda rows, wanted, on: asked.append((wanted.count(), rows.count())) or real(rows, wanted, on))
    line = dict(table_name="stop_times", field_name="stop_headsign", language="fr", translation="x", record_sub_id="1")
    f = feed(spark, stop_times=[dict(trip_id=f"T{i}", stop_sequence=1) for i in range(50)], translations=[line | dict(record_id=r) for r in ("T7", "T7", "ghost")])
    found = keys.translation_references(f).where("code = 'translation_foreign_key_violation'").collect()
    assert [x["context"]["recordId"] for x in found] == ["ghost"]
    assert len(asked) == 1 and asked[0][0] == 2 and asked[0][1] >= 50


def test_missing_values_are_found_without_a_join(spark, monkeypatch):
    """Values of children and parents meet in one aggregate, so no side is sorted or held beside the other."""
    plans, real = [], keys.picked
    monkeypatch.setattr(keys, "picked", lambda rows, wanted, on: plans.append(wanted._jdf.queryExecution().executedPlan().toString()) or real(rows, wanted, on))
    f = feed(spark, trips=[dict(trip_id="T1")], stop_times=[dict(trip_id=t, stop_sequence=1) for t in ("T1", "T2", "T2", None)])
    found = keys.foreign_key_violation(f).where("filename = 'stop_times.txt'").collect()
    assert [x["context"]["fieldValue"] for x in found] == ["T2", "T2"]
    assert len(plans) == 1 and "Join" not in plans[0]


def test_compare_makes_each_run_once(spark):
    """Counts of equal notices in one aggregate: a run's notices are shuffled once, and repeated ones keep their number."""
    row = lambda n, k: ("f", "c", "ERROR", "a.txt", n, {"k": k})
    schema = "feed_id string, code string, severity string, filename string, row_number long, context map<string, string>"
    before, after = (spark.createDataFrame(rows, schema) for rows in ([row(1, "x")] * 3 + [row(2, "y")], [row(1, "x"), row(2, "z"), row(3, "z"), row(4, "z")]))
    found = compare(before, after)
    assert [tuple(x) for x in found.collect()] == [("f", "c", 4, 4, 3, 3)]
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_report_and_compare(spark):
    f = feed(spark, stops=[dict(stop_id=f"S{i}", location_type=1) for i in range(6)])
    found = joins.usage(f).where("code = 'unused_station'")
    r = report(found, 4).first()
    assert (r["totalNotices"], [m["stopId"] for m in r["sampleNotices"]]) == (6, ["S0", "S1", "S2", "S3"])
    assert {(x["severity"], x["code"], x["n_notices"]) for x in severity_totals(found).collect()} == {("INFO", "unused_station", 6), ("INFO", None, 6), (None, None, 6)}
    d = compare(found, found.where("row_number > 3")).first()
    assert (d["n_before"], d["n_after"], d["only_before"], d["only_after"]) == (6, 4, 2, 0)


def test_run_and_gating(spark):
    f = feed(spark, **USAGE)
    f.tables |= feed(spark, routes=[dict(route_id="R")], agency=[dict(agency_id="A")]).tables
    run = run_checks(f, day("2026-01-01"), only=["usage", "stop_usage", "row_rules", "duplicate_key_stops"])
    assert run.failures == [] and run.notices.where("code = 'unused_trip'").count() == 1
    f.status = spark.createDataFrame([("f", "stop_times", "UNPARSABLE_ROWS", None), ("f", "pathways", "MISSING_FILE", None)], "feed_id string, table string, status string, columns array<string>")
    assert run_checks(f, day("2026-01-01"), only=["usage"]).notices.where("code = 'unused_trip'").count() == 0
    assert f.gated(["pathways", "stops"])["stops"].count() == 6
    assert f.gated(["stop_times"])["stop_times"].count() == 0


def test_results_do_not_depend_on_partitions(spark):
    f = feed(spark, **USAGE)
    want = codes(joins.usage(f))
    for n in (1, 7):
        f.tables["stop_times"] = f.tables["stop_times"].repartition(n, F.rand(1))
        assert codes(joins.usage(f)) == want


def test_checks_by_row_do_not_shuffle_stop_times(spark):
    f = feed(spark, stop_times=USAGE["stop_times"])
    plan = lambda only: run_checks(f, day("2026-01-01"), only=[only]).notices._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan("row_rules")
    assert "Exchange" in plan("stop_time_times")
