"""Row rules: for each code a row that breaks it and one that doesn't, by the schedule format's own wording."""

import datetime

import pytest

from headway.operators import rowrules
from tests.feeds import feed

#: (table, code, a row that breaks the rule, one that keeps it).
CASES = [
    ("stops", "missing_stop_name", dict(stop_id="A", location_type=0), dict(stop_id="A", location_type=3)),
    ("stops", "stop_without_location", dict(stop_name="N", location_type=1, stop_lat=1.0), dict(stop_name="N", location_type=4)),
    ("stops", "station_with_parent_station", dict(location_type=1, parent_station="B"), dict(location_type=0, parent_station="B")),
    ("stops", "location_without_parent_station", dict(location_type=2), dict(location_type=2, parent_station="B")),
    ("stops", "platform_without_parent_station", dict(platform_code="1"), dict(platform_code="1", parent_station="B")),
    ("stops", "stop_access_specified_for_incorrect_location", dict(stop_access=1, location_type=1), dict(stop_access=1, location_type=0, parent_station="B")),
    ("stops", "stop_access_specified_for_stop_with_no_parent_station", dict(stop_access=1), dict(stop_access=1, parent_station="B")),
    ("stops", "same_name_and_description_for_stop", dict(stop_name="Main", stop_desc="main"), dict(stop_name="Main", stop_desc="On the square")),
    ("stops", "point_near_origin", dict(stop_lat=0.5, stop_lon=-0.9), dict(stop_lat=0.5, stop_lon=1.1)),
    ("stops", "point_near_pole", dict(stop_lat=-89.5, stop_lon=50.0), dict(stop_lat=88.9, stop_lon=50.0)),
    ("shapes", "point_near_origin", dict(shape_pt_lat=0.0, shape_pt_lon=0.0), dict(shape_pt_lat=1.5, shape_pt_lon=0.0)),
    ("shapes", "point_near_pole", dict(shape_pt_lat=89.0, shape_pt_lon=9.0), dict(shape_pt_lat=80.0, shape_pt_lon=9.0)),
    ("routes", "route_both_short_and_long_name_missing", dict(route_id="R"), dict(route_short_name="1")),
    ("routes", "route_short_name_too_long", dict(route_short_name="1234567890123"), dict(route_short_name="123456789012")),
    ("routes", "route_short_name_too_long", dict(route_short_name="😀😀😀😀😀😀😀"), dict(route_short_name="😀😀😀😀😀😀")),
    ("routes", "route_color_contrast", dict(route_color=0x101010, route_text_color=0x202020), dict(route_color=0xFFFFFF, route_text_color=0)),
    *(("routes", "route_long_name_contains_short_name", dict(route_short_name="N", route_long_name=bad), dict(route_short_name="N", route_long_name=good)) for bad, good in (
        ("n", "Judah"), ("N Judah", "NJudah"), ("N-Judah", "North"), ("N(x)", "N/x"), ("N)", "N_"), ("N x Judah", "N Judah"), ("N\tJ", "N x y"), ("N  (x", "N \u0085"),
    )),
    ("routes", "same_name_and_description_for_route", dict(route_long_name="Ring", route_desc="RING"), dict(route_long_name="Ring", route_desc="Circle")),
    ("stop_times", "forbidden_arrival_or_departure_time", dict(stop_id="A", start_pickup_drop_off_window=1, end_pickup_drop_off_window=9, arrival_time=5), dict(stop_id="A", arrival_time=5)),
    ("stop_times", "missing_pickup_or_drop_off_window", dict(start_pickup_drop_off_window=1), dict(start_pickup_drop_off_window=1, end_pickup_drop_off_window=2)),
    ("stop_times", "invalid_pickup_drop_off_window", dict(start_pickup_drop_off_window=2, end_pickup_drop_off_window=2), dict(start_pickup_drop_off_window=1, end_pickup_drop_off_window=2)),
    ("stop_times", "forbidden_pickup_type", dict(start_pickup_drop_off_window=1, pickup_type=3), dict(start_pickup_drop_off_window=1, pickup_type=2)),
    ("stop_times", "forbidden_drop_off_type", dict(end_pickup_drop_off_window=1), dict(end_pickup_drop_off_window=1, drop_off_type=2)),
    ("stop_times", "forbidden_geography_id", dict(stop_id="A", location_id="Z"), dict(location_id="Z")),
    ("stop_times", "missing_required_field", dict(trip_id="T"), dict(location_group_id="G")),
    ("stop_times", "forbidden_shape_dist_traveled", dict(location_id="Z", shape_dist_traveled=1.0), dict(stop_id="A", shape_dist_traveled=1.0)),
    ("stop_times", "missing_timepoint_value", dict(arrival_time=1), dict(arrival_time=1, timepoint=0)),
    ("stop_times", "stop_time_timepoint_without_times", dict(timepoint=1, arrival_time=1), dict(timepoint=1, arrival_time=1, departure_time=1)),
    ("stop_times", "missing_pickup_drop_off_booking_rule_id", dict(pickup_type=2, start_pickup_drop_off_window=1), dict(pickup_type=2, start_pickup_drop_off_window=1, pickup_booking_rule_id="K")),
    ("booking_rules", "forbidden_real_time_booking_field_value", dict(booking_type=0, prior_notice_last_day=1), dict(booking_type=0)),
    ("booking_rules", "forbidden_same_day_booking_field_value", dict(booking_type=1, prior_notice_last_time=1), dict(booking_type=1, prior_notice_duration_min=1)),
    ("booking_rules", "forbidden_prior_day_booking_field_value", dict(booking_type=2, prior_notice_duration_max=1), dict(booking_type=2, prior_notice_last_day=1)),
    ("booking_rules", "forbidden_prior_notice_start_day", dict(prior_notice_start_day=1, prior_notice_duration_max=1), dict(prior_notice_start_day=1)),
    ("booking_rules", "forbidden_prior_notice_start_time", dict(prior_notice_start_time=1), dict(prior_notice_start_time=1, prior_notice_start_day=1)),
    ("booking_rules", "missing_prior_notice_start_time", dict(prior_notice_start_day=1), dict(prior_notice_start_time=1, prior_notice_start_day=1)),
    ("booking_rules", "missing_prior_notice_duration_min", dict(booking_type=1), dict(booking_type=1, prior_notice_duration_min=1)),
    ("booking_rules", "missing_prior_notice_last_day", dict(booking_type=2), dict(booking_type=2, prior_notice_last_day=1)),
    ("booking_rules", "missing_prior_notice_last_time", dict(booking_type=2), dict(booking_type=2, prior_notice_last_time=1)),
    ("booking_rules", "invalid_prior_notice_duration_min", dict(prior_notice_duration_min=3, prior_notice_duration_max=2), dict(prior_notice_duration_min=2, prior_notice_duration_max=2)),
    ("booking_rules", "prior_notice_last_day_after_start_day", dict(prior_notice_last_day=3, prior_notice_start_day=2), dict(prior_notice_last_day=2, prior_notice_start_day=2)),
    ("fare_transfer_rules", "fare_transfer_rule_duration_limit_without_type", dict(duration_limit=1), dict(duration_limit=1, duration_limit_type=0)),
    ("fare_transfer_rules", "fare_transfer_rule_duration_limit_type_without_duration_limit", dict(duration_limit_type=0), dict(duration_limit=1, duration_limit_type=0)),
    ("fare_transfer_rules", "fare_transfer_rule_without_transfer_count", dict(from_leg_group_id="L", to_leg_group_id="L"), dict(from_leg_group_id="L", to_leg_group_id="M")),
    ("fare_transfer_rules", "fare_transfer_rule_invalid_transfer_count", dict(from_leg_group_id="L", to_leg_group_id="L", transfer_count=-2), dict(from_leg_group_id="L", to_leg_group_id="L", transfer_count=-1)),
    ("fare_transfer_rules", "fare_transfer_rule_with_forbidden_transfer_count", dict(from_leg_group_id="L", transfer_count=1), dict(from_leg_group_id="L", to_leg_group_id="L", transfer_count=1)),
    ("timeframes", "timeframe_only_start_or_end_time_specified", dict(start_time=1), dict(start_time=1, end_time=2)),
    ("timeframes", "timeframe_start_or_end_time_greater_than_twenty_four_hours", dict(start_time=1, end_time=86401), dict(start_time=1, end_time=86400)),
    ("pathways", "pathway_loop", dict(from_stop_id="A", to_stop_id="A"), dict(from_stop_id="A", to_stop_id="B")),
    ("pathways", "bidirectional_exit_gate", dict(pathway_mode=7, is_bidirectional=1), dict(pathway_mode=7, is_bidirectional=0)),
    ("calendar", "service_has_no_active_day_of_the_week", dict(monday=0), dict(sunday=1)),
    ("attributions", "attribution_without_role", dict(is_producer=0), dict(is_operator=1)),
    ("transfers", "missing_required_field", dict(transfer_type=0, from_stop_id="A"), dict(transfer_type=0, from_stop_id="A", to_stop_id="B")),
    ("transfers", "missing_required_field", dict(transfer_type=4, from_trip_id="T"), dict(transfer_type=4, from_trip_id="T", to_trip_id="U")),
    ("fare_leg_join_rules", "missing_required_field", dict(from_stop_id="A"), dict(from_stop_id="A", to_stop_id="B")),
    ("fare_media", "missing_recommended_field", dict(fare_media_type=2), dict(fare_media_type=2, fare_media_name="Card")),
    ("feed_info", "missing_feed_contact_email_and_url", dict(feed_lang="en"), dict(feed_contact_url="https://a.com")),
    ("feed_info", "missing_feed_info_date", dict(feed_start_date=datetime.date(2026, 1, 1)), dict(feed_lang="en")),
]


@pytest.fixture(scope="module")
def found(spark):
    """The codes found at each row; the rows of CASES stand in their tables one after another, broken before kept."""
    tables: dict[str, list[dict]] = {}
    places = []
    for table, _, bad, good in CASES:
        rows = tables.setdefault(table, [])
        places.append((table, len(rows) + 2))
        rows += [bad, good]
    codes: dict[tuple[str, int], set[str]] = {}
    for r in rowrules.row_notices(feed(spark, **tables)).collect():
        codes.setdefault((r["filename"].removesuffix(".txt"), r["row_number"]), set()).add(r["code"])
    return places, codes


@pytest.mark.parametrize("i", range(len(CASES)), ids=lambda i: f"{CASES[i][1]}-{i}")
def test_code(found, i):
    places, codes = found
    (table, row), code = places[i], CASES[i][1]
    assert code in codes.get((table, row), set())
    assert code not in codes.get((table, row + 1), set())


def test_every_code_has_a_case():
    assert {(r.table, r.code) for r in rowrules.RULES} == {(t, c) for t, c, *_ in CASES}
