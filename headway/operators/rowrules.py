"""Row rules: predicates on the rows of one table, all of a table's rules in one scan.

A rule's condition is SQL, so it can be shown, stored and checked by another engine as it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..feed import Feed
from ..schema import TABLES


@dataclass(frozen=True)
class RowRule:
    code: str
    severity: str
    table: str
    when: str
    context: tuple[str, ...] = ()  # columns, or name=SQL
    requires_any: tuple[str, ...] = ()  # of these columns, one must be in the table's header
    needs: tuple[str, ...] = ()  # tables that must be there

    def pairs(self) -> list[tuple[str, str]]:
        return [(x.partition("=")[0], x.partition("=")[2] or x) for x in self.context]


RULES: list[RowRule] = []


def row_rule(code: str, severity: str, table: str, when: str, context: str | tuple[str, ...] = "", requires_any: tuple[str, ...] = (), needs: tuple[str, ...] = ()) -> RowRule:
    """Registers a rule; users add their own in the same way."""
    rule = RowRule(code, severity, table, when, tuple(context.split()) if isinstance(context, str) else context, requires_any, needs)
    RULES.append(rule)
    return rule


def _register() -> None:
    stop = "coalesce(location_type, 0)"
    r = row_rule
    r("missing_stop_name", "ERROR", "stops", f"{stop} in (0, 1, 2) and coalesce(stop_name, '') = ''", "stop_id location_type")
    r("stop_without_location", "ERROR", "stops", f"{stop} in (0, 1, 2) and (stop_lat is null or stop_lon is null)", "stop_id location_type")
    r("station_with_parent_station", "ERROR", "stops", f"{stop} = 1 and parent_station is not null", "stop_id parent_station")
    r("location_without_parent_station", "ERROR", "stops", f"{stop} in (2, 3, 4) and parent_station is null", "stop_id location_type")
    r("platform_without_parent_station", "INFO", "stops", f"{stop} = 0 and platform_code is not null and parent_station is null", "stop_id platform_code")
    r("stop_access_specified_for_incorrect_location", "ERROR", "stops", f"stop_access is not null and {stop} <> 0", "stop_id stop_access", ("stop_access",))
    r("stop_access_specified_for_stop_with_no_parent_station", "ERROR", "stops", f"stop_access is not null and {stop} = 0 and parent_station is null", "stop_id stop_access", ("stop_access",))
    r("same_name_and_description_for_stop", "WARNING", "stops", "lower(stop_name) = lower(stop_desc)", "stop_id", ("stop_desc",))
    r("route_both_short_and_long_name_missing", "ERROR", "routes", "route_short_name is null and route_long_name is null", "route_id")
    # characters beyond the basic plane are two units long
    r("route_short_name_too_long", "WARNING", "routes", "length(route_short_name) + length(regexp_replace(route_short_name, '[\u0001-￿]', '', 'g')) > 12", "route_id")
    luma = lambda c: f"(0.30 * floor({c} / 65536) + 0.59 * (floor({c} / 256) % 256) + 0.11 * ({c} % 256))"
    r("route_color_contrast", "WARNING", "routes", f"abs(floor({luma('route_color')}) - floor({luma('route_text_color')})) < 72", "route_id route_color route_text_color", ("route_color", "route_text_color"))
    # after the short name: nothing, or a separator (after a blank, if any) and no line break beyond it
    after = "substr(route_long_name, length(route_short_name) + {0})"
    blank, breaks = " \t\n\x0b\f\r", "\n\r\x85\u2028\u2029"
    listed = lambda chars: ", ".join(f"'{c}'" for c in chars)
    first = lambda n, chars: f"substr(route_long_name, length(route_short_name) + {n}, 1) in ({listed(chars)})"
    whole = lambda n: f"translate({after.format(n)}, '{breaks}', '') = {after.format(n)}"
    separated = f"{first(1, blank + '-()')} and {whole(2)} or {first(1, blank)} and {first(2, blank + '-()')} and {whole(3)}"
    same = "starts_with(lower(route_long_name), lower(route_short_name))"
    r("route_long_name_contains_short_name", "WARNING", "routes", f"{same} and (length(route_long_name) = length(route_short_name) or {separated})", "route_id")
    r("same_name_and_description_for_route", "WARNING", "routes", "lower(route_desc) = lower(coalesce(route_short_name, '')) or lower(route_desc) = lower(coalesce(route_long_name, ''))", "route_id", ("route_desc",))
    start, end = "start_pickup_drop_off_window", "end_pickup_drop_off_window"
    window, whole = f"({start} is not null or {end} is not null)", f"({start} is not null and {end} is not null)"
    flex, row = (start, end), "trip_id stop_sequence"
    r("forbidden_arrival_or_departure_time", "ERROR", "stop_times", f"{window} and (arrival_time is not null or departure_time is not null)", row, flex)
    r("missing_pickup_or_drop_off_window", "ERROR", "stop_times", f"{window} and not {whole}", row, flex)
    r("invalid_pickup_drop_off_window", "ERROR", "stop_times", f"{whole} and {start} >= {end}", row, flex)
    r("forbidden_pickup_type", "ERROR", "stop_times", f"{window} and coalesce(pickup_type, 0) in (0, 3)", row, flex)
    r("forbidden_drop_off_type", "ERROR", "stop_times", f"{window} and coalesce(drop_off_type, 0) = 0", row, flex)
    places = "(case when stop_id is null then 0 else 1 end + case when location_group_id is null then 0 else 1 end + case when location_id is null then 0 else 1 end)"
    r("forbidden_geography_id", "ERROR", "stop_times", f"{places} > 1", row)
    r("missing_required_field", "ERROR", "stop_times", f"{places} = 0", "trip_id stop_sequence fieldName='stop_id'")
    r("forbidden_shape_dist_traveled", "ERROR", "stop_times", "stop_id is null and (location_id is not null or location_group_id is not null) and shape_dist_traveled is not null", row, ("location_id", "location_group_id"))
    r("missing_timepoint_value", "WARNING", "stop_times", "(arrival_time is not null or departure_time is not null) and timepoint is null", row, ("timepoint",))
    for side in ("arrival", "departure"):
        r("stop_time_timepoint_without_times", "ERROR", "stop_times", f"timepoint = 1 and {side}_time is null", f"trip_id stop_sequence specifiedField='{side}_time'", ("timepoint",))
    for side, bound in (("pickup", start), ("drop_off", end)):
        r("missing_pickup_drop_off_booking_rule_id", "WARNING", "stop_times", f"{side}_type = 2 and {bound} is not null and {side}_booking_rule_id is null", f"trip_id stop_sequence side='{side}'", flex, ("booking_rules",))
    kinds = {
        "real_time": (0, ["prior_notice_duration_min", "prior_notice_duration_max", "prior_notice_last_day", "prior_notice_last_time", "prior_notice_start_day", "prior_notice_start_time", "prior_notice_service_id"]),
        "same_day": (1, ["prior_notice_last_day", "prior_notice_last_time", "prior_notice_service_id"]),
        "prior_day": (2, ["prior_notice_duration_min", "prior_notice_duration_max"]),
    }
    for kind, (value, names) in kinds.items():
        listed = ", ".join(f"case when {n} is not null then '{n}' end" for n in names)
        r(f"forbidden_{kind}_booking_field_value", "ERROR", "booking_rules", f"booking_type = {value} and ({' or '.join(f'{n} is not null' for n in names)})", ("booking_rule_id", f"fieldNames=concat_ws(', ', {listed})"))
    b = lambda code, when: r(code, "ERROR", "booking_rules", when, "booking_rule_id booking_type")
    b("forbidden_prior_notice_start_day", "prior_notice_start_day is not null and prior_notice_duration_max is not null")
    b("forbidden_prior_notice_start_time", "prior_notice_start_time is not null and prior_notice_start_day is null")
    b("missing_prior_notice_start_time", "prior_notice_start_day is not null and prior_notice_start_time is null")
    b("missing_prior_notice_duration_min", "booking_type = 1 and prior_notice_duration_min is null")
    b("missing_prior_notice_last_day", "booking_type = 2 and prior_notice_last_day is null")
    b("missing_prior_notice_last_time", "booking_type = 2 and prior_notice_last_time is null")
    b("invalid_prior_notice_duration_min", "prior_notice_duration_max < prior_notice_duration_min")
    b("prior_notice_last_day_after_start_day", "prior_notice_last_day > prior_notice_start_day")
    own = "(from_leg_group_id is not null and to_leg_group_id is not null and from_leg_group_id = to_leg_group_id)"
    f = lambda code, when: r(code, "ERROR", "fare_transfer_rules", when, "from_leg_group_id to_leg_group_id transfer_count")
    f("fare_transfer_rule_duration_limit_without_type", "duration_limit is not null and duration_limit_type is null")
    f("fare_transfer_rule_duration_limit_type_without_duration_limit", "duration_limit is null and duration_limit_type is not null")
    f("fare_transfer_rule_without_transfer_count", f"{own} and transfer_count is null")
    f("fare_transfer_rule_invalid_transfer_count", f"{own} and (transfer_count < -1 or transfer_count = 0)")
    f("fare_transfer_rule_with_forbidden_transfer_count", f"not {own} and transfer_count is not null")
    r("timeframe_only_start_or_end_time_specified", "ERROR", "timeframes", "(start_time is null) <> (end_time is null)", "timeframe_group_id")
    for side in ("start", "end"):
        r("timeframe_start_or_end_time_greater_than_twenty_four_hours", "ERROR", "timeframes", f"{side}_time > 86400", f"timeframe_group_id fieldName='{side}_time'")
    r("pathway_loop", "WARNING", "pathways", "from_stop_id = to_stop_id", "pathway_id from_stop_id")
    r("bidirectional_exit_gate", "ERROR", "pathways", "pathway_mode = 7 and is_bidirectional = 1", "pathway_id")
    days = " and ".join(f"coalesce({d}, 0) = 0" for d in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"))
    r("service_has_no_active_day_of_the_week", "WARNING", "calendar", days, "service_id")
    r("attribution_without_role", "WARNING", "attributions", "coalesce(is_producer, 0) <> 1 and coalesce(is_operator, 0) <> 1 and coalesce(is_authority, 0) <> 1", "attribution_id")
    for side in ("from", "to"):
        r("missing_required_field", "ERROR", "transfers", f"transfer_type is not null and transfer_type not in (4, 5) and {side}_stop_id is null", f"fieldName='{side}_stop_id'")
        r("missing_required_field", "ERROR", "transfers", f"transfer_type in (4, 5) and {side}_trip_id is null", f"fieldName='{side}_trip_id'")
    for side, other in (("from", "to"), ("to", "from")):
        r("missing_required_field", "ERROR", "fare_leg_join_rules", f"{side}_stop_id is null and {other}_stop_id is not null", f"fieldName='{side}_stop_id'")
    r("missing_recommended_field", "WARNING", "fare_media", "fare_media_type in (2, 4) and fare_media_name is null", "fare_media_id")
    r("missing_feed_contact_email_and_url", "WARNING", "feed_info", "feed_contact_email is null and feed_contact_url is null")
    r("missing_feed_info_date", "WARNING", "feed_info", "(feed_start_date is null) <> (feed_end_date is null)")
    r("point_near_origin", "ERROR", "stops", "abs(stop_lat) <= 1 and abs(stop_lon) <= 1", "stop_id")
    r("point_near_pole", "ERROR", "stops", "abs(stop_lat) >= 89", "stop_id")
    r("point_near_origin", "ERROR", "shapes", "abs(shape_pt_lat) <= 1 and abs(shape_pt_lon) <= 1", "shape_id")
    r("point_near_pole", "ERROR", "shapes", "abs(shape_pt_lat) >= 89", "shape_id")


_register()


def spark_sql(text: str) -> Column:
    # the global flag of regexp_replace is implied in Spark
    return F.expr(text.replace(", 'g')", ")").replace("starts_with(", "startswith("))


def applicable(feed: Feed, table: str, rules: list[RowRule]) -> list[RowRule]:
    return [r for r in rules if r.table == table and (not r.requires_any or any(feed.has(table, c) for c in r.requires_any)) and all(t in feed for t in r.needs)]


def row_notices(feed: Feed, rules: list[RowRule] | None = None) -> DataFrame | None:
    """The notices of all row rules: each table is read once, and each row yields its list of notices."""
    rules = RULES if rules is None else rules
    parts = []
    for table in dict.fromkeys(r.table for r in rules):
        own = applicable(feed, table, rules) if table in feed else []
        if not own:
            continue
        def pairs(r: RowRule) -> Column:
            each = [F.struct(F.lit(k).alias("key"), spark_sql(v).cast("string").alias("value")) for k, v in r.pairs()]
            return F.array(*each) if each else F.array().cast("array<struct<key:string,value:string>>")

        def holds(r: RowRule) -> Column:
            return spark_sql(r.when) & feed.declares(table, *r.requires_any) if r.requires_any else spark_sql(r.when)

        hits = [F.when(holds(r), F.struct(F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity"), pairs(r).alias("pairs"))) for r in own]
        # exploded as they are and filtered then, so that conditions are compiled; lambdas see hits only
        found = feed[table].select("feed_id", "_row_number", F.explode(F.array(*hits)).alias("hit")).where("hit is not null")
        context = F.map_from_entries(F.filter("hit.pairs", lambda p: p["value"].isNotNull()))
        parts.append(found.select("feed_id", "hit.code", "hit.severity", F.lit(TABLES[table].file).alias("filename"), F.col("_row_number").cast("long").alias("row_number"), context.alias("context")))
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def oracle(rules: list[RowRule], columns: dict[str, list[str]], tables: set[str]) -> str:
    """The same notices as plain SQL, one SELECT for each rule. columns: those of each projected table."""
    selects = []
    for r in rules:
        if r.table not in columns or any(t not in tables for t in r.needs) or r.requires_any and not any(c in columns[r.table] for c in r.requires_any):
            continue
        missing = [n for n in TABLES[r.table].names if n not in columns[r.table]]
        source = f"(SELECT *{''.join(f', NULL AS {n}' for n in missing)} FROM {r.table}) q"
        text = ", ".join(f"'{k}=' || CAST({v} AS VARCHAR)" for k, v in r.pairs())
        selects.append(f"SELECT '{r.code}' AS code, '{TABLES[r.table].file}' AS filename, CAST(_row_number AS BIGINT) AS row_number, {f'concat_ws({chr(39)};{chr(39)}, {text})' if text else chr(39) * 2} AS context FROM {source} WHERE {r.when}")
    return " UNION ALL ".join(selects)
