"""Tables of a transit feed: fields, keys and references, as data.

Types: id and text (string), time (seconds as int), date, enum and int (int), float (double),
decimal and amount (string), and url, email, color, currency, language, timezone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

SPARK_TYPES = {
    "time": T.IntegerType(), "date": T.DateType(), "enum": T.IntegerType(), "int": T.IntegerType(), "color": T.IntegerType(),
    "float": T.DoubleType(), "latitude": T.DoubleType(), "longitude": T.DoubleType(),
}


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "text"
    presence: str = "optional"  # required, recommended, optional
    values: tuple[int, ...] = ()  # of an enum
    bounds: str = ""  # non_negative, positive, non_zero
    mixed_case: bool = False
    end_of: str = ""  # start column of a range that this column ends
    may_equal: bool = True  # whether the range may be empty
    currency: str = ""  # column with the currency of an amount


@dataclass(frozen=True)
class Table:
    name: str
    fields: tuple[Field, ...]
    key: tuple[str, ...] = ()
    presence: str = "optional"
    single_row: bool = False
    filename: str = field(default="", compare=False)

    @property
    def file(self) -> str:
        return self.filename or f"{self.name}.txt"

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def field(self, name: str) -> Field:
        return next(f for f in self.fields if f.name == name)

    def struct(self) -> T.StructType:
        """The typed rows of the table."""
        own = [T.StructField(f.name, SPARK_TYPES.get(f.type, T.StringType())) for f in self.fields]
        return T.StructType([T.StructField("feed_id", T.StringType()), T.StructField("_row_number", T.LongType()), *own])


def _parse(text: str) -> tuple[Field, ...]:
    """`name:type:mark,mark` parts; marks: ! required, ? recommended, ~ mixed case, a bound, >start, $currency, 0|1 values."""
    out = []
    for part in text.split():
        name, kind, marks, *_ = (part + "::").split(":")
        args: dict = {}
        for m in filter(None, marks.split(",")):
            if m in "!?":
                args["presence"] = "required" if m == "!" else "recommended"
            elif m == "~":
                args["mixed_case"] = True
            elif m[0] == ">":
                args["end_of"] = m[1:].rstrip("=")
                args["may_equal"] = m.endswith("=")
            elif m[0] == "$":
                args["currency"] = m[1:]
            elif m[0].isdigit():
                args["values"] = tuple(map(int, m.split("|")))
            else:
                args["bounds"] = m
        out.append(Field(name, kind or "text", **args))
    return tuple(out)


_DAYS = " ".join(f"{d}:enum:!,0|1" for d in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"))
_STOP_TYPES = "0|1|2|3"

TABLES: dict[str, Table] = {
    t.name: t
    for t in (
        Table("agency", _parse("agency_id:id agency_name::!,~ agency_url:url:! agency_timezone:timezone:! agency_lang:language agency_phone agency_fare_url:url agency_email:email cemv_support:enum:0|1|2"), ("agency_id",), "required"),
        Table("stops", _parse("stop_id:id:! stop_code stop_name::~ tts_stop_name stop_desc::~ stop_lat:latitude stop_lon:longitude zone_id:id stop_url:url location_type:enum:0|1|2|3|4 parent_station:id stop_timezone:timezone wheelchair_boarding:enum:0|1|2 level_id:id platform_code stop_access:enum:0|1"), ("stop_id",)),
        Table("routes", _parse("route_id:id:! agency_id:id route_short_name::~ route_long_name::~ route_desc::~ route_type:enum:!,0|1|2|3|4|5|6|7|11|12 route_url:url route_color:color route_text_color:color route_sort_order:int:non_negative continuous_pickup:enum:0|1|2|3 continuous_drop_off:enum:0|1|2|3 network_id:id cemv_support:enum:0|1|2"), ("route_id",), "required"),
        Table("trips", _parse("route_id:id:! service_id:id:! trip_id:id:! trip_headsign::~ trip_short_name direction_id:enum:0|1 block_id:id shape_id:id wheelchair_accessible:enum:0|1|2 bikes_allowed:enum:0|1|2 cars_allowed:enum:0|1|2"), ("trip_id",), "required"),
        Table("stop_times", _parse(f"trip_id:id:! arrival_time:time departure_time:time stop_id:id location_group_id:id location_id:id stop_sequence:int:!,non_negative stop_headsign::~ start_pickup_drop_off_window:time end_pickup_drop_off_window:time pickup_type:enum:{_STOP_TYPES} drop_off_type:enum:{_STOP_TYPES} continuous_pickup:enum:{_STOP_TYPES} continuous_drop_off:enum:{_STOP_TYPES} shape_dist_traveled:float:non_negative timepoint:enum:0|1 pickup_booking_rule_id:id drop_off_booking_rule_id:id"), ("trip_id", "stop_sequence"), "required"),
        Table("calendar", _parse(f"service_id:id:! {_DAYS} start_date:date:! end_date:date:!,>start_date="), ("service_id",)),
        Table("calendar_dates", _parse("service_id:id:! date:date:! exception_type:enum:!,1|2"), ("service_id", "date")),
        Table("shapes", _parse("shape_id:id:! shape_pt_lat:latitude:! shape_pt_lon:longitude:! shape_pt_sequence:int:!,non_negative shape_dist_traveled:float:non_negative"), ("shape_id", "shape_pt_sequence")),
        Table("frequencies", _parse("trip_id:id:! start_time:time:! end_time:time:!,>start_time headway_secs:int:!,positive exact_times:enum:0|1"), ("trip_id", "start_time")),
        Table("transfers", _parse("from_stop_id:id to_stop_id:id from_route_id:id to_route_id:id from_trip_id:id to_trip_id:id transfer_type:enum:0|1|2|3|4|5 min_transfer_time:int:non_negative"), ("from_stop_id", "to_stop_id", "from_trip_id", "to_trip_id", "from_route_id", "to_route_id")),
        Table("pathways", _parse("pathway_id:id:! from_stop_id:id:! to_stop_id:id:! pathway_mode:enum:!,1|2|3|4|5|6|7 is_bidirectional:enum:!,0|1 length:float:non_negative traversal_time:int:positive stair_count:int max_slope:float min_width:float:positive signposted_as reversed_signposted_as"), ("pathway_id",)),
        Table("levels", _parse("level_id:id:! level_index:float:! level_name"), ("level_id",)),
        Table("feed_info", _parse("feed_publisher_name::! feed_publisher_url:url:! feed_lang:language:! default_lang:language feed_start_date:date:? feed_end_date:date:?,>feed_start_date= feed_version::? feed_contact_email:email feed_contact_url:url"), (), "recommended", True),
        Table("translations", _parse("table_name::! field_name::! language:language:! translation::! record_id record_sub_id field_value")),
        Table("fare_attributes", _parse("fare_id:id:! price:amount:!,$currency_type currency_type:currency:! payment_method:enum:0|1 transfers:enum:0|1|2 agency_id:id transfer_duration:int:non_negative"), ("fare_id",)),
        Table("fare_rules", _parse("fare_id:id:! route_id:id origin_id:id destination_id:id contains_id:id")),
        Table("fare_media", _parse("fare_media_id:id:! fare_media_name::~ fare_media_type:enum:!,0|1|2|3|4"), ("fare_media_id",)),
        Table("fare_products", _parse("fare_product_id:id:! fare_product_name::~ rider_category_id:id fare_media_id:id amount:amount:!,$currency currency:currency:!"), ("fare_product_id", "rider_category_id", "fare_media_id")),
        Table("rider_categories", _parse("rider_category_id:id:! rider_category_name::! is_default_fare_category:enum:0|1 eligibility_url:url"), ("rider_category_id",)),
        Table("fare_leg_rules", _parse("leg_group_id:id network_id:id from_area_id:id to_area_id:id from_timeframe_group_id:id to_timeframe_group_id:id fare_product_id:id:! rule_priority:int:non_negative"), ("network_id", "from_area_id", "to_area_id", "from_timeframe_group_id", "to_timeframe_group_id", "fare_product_id")),
        Table("fare_transfer_rules", _parse("from_leg_group_id:id to_leg_group_id:id transfer_count:int:non_zero duration_limit:int:positive duration_limit_type:enum:0|1|2|3 fare_transfer_type:enum:!,0|1|2 fare_product_id:id"), ("from_leg_group_id", "to_leg_group_id", "fare_product_id", "transfer_count", "duration_limit")),
        Table("fare_leg_join_rules", _parse("from_network_id:id:! to_network_id:id:! from_stop_id:id to_stop_id:id"), ("from_network_id", "to_network_id", "from_stop_id", "to_stop_id")),
        Table("timeframes", _parse("timeframe_group_id:id:! start_time:time end_time:time service_id:id:!"), ("timeframe_group_id", "start_time", "end_time", "service_id")),
        Table("booking_rules", _parse("booking_rule_id:id:! booking_type:enum:!,0|1|2 prior_notice_duration_min:int prior_notice_duration_max:int prior_notice_last_day:int prior_notice_last_time:time prior_notice_start_day:int prior_notice_start_time:time prior_notice_service_id:id message"), ("booking_rule_id",)),
        Table("attributions", _parse("attribution_id:id agency_id:id route_id:id trip_id:id organization_name::! is_producer:enum:0|1 is_operator:enum:0|1 is_authority:enum:0|1 attribution_url:url attribution_email:email"), ("attribution_id",)),
        Table("location_groups", _parse("location_group_id:id:! location_group_name::~"), ("location_group_id",)),
        Table("location_group_stops", _parse("location_group_id:id:! stop_id:id:!"), ("location_group_id", "stop_id")),
        Table("networks", _parse("network_id:id:! network_name::~"), ("network_id",)),
        Table("route_networks", _parse("network_id:id:! route_id:id:!"), ("route_id",)),
        Table("areas", _parse("area_id:id:! area_name::~"), ("area_id",)),
        Table("stop_areas", _parse("area_id:id:! stop_id:id:!"), ("area_id", "stop_id")),
        Table("zones", _parse("feature_id:id feature_index:int geometry_type coordinates"), (), filename="locations.geojson"),
    )
}


@dataclass(frozen=True)
class Reference:
    """Values of child.column must be in the union of the parents' columns."""

    child: str
    column: str
    parents: tuple[tuple[str, str], ...]
    skip_empty: bool = False


def _reference(text: str) -> Reference:
    child, parents = text.split(">")
    table, column = child.split(".")
    return Reference(table, column, tuple(tuple(p.split(".")) for p in parents.split("|")))


REFERENCES: tuple[Reference, ...] = tuple(
    _reference(x)
    for x in (
        "routes.agency_id>agency.agency_id fare_attributes.agency_id>agency.agency_id attributions.agency_id>agency.agency_id attributions.route_id>routes.route_id attributions.trip_id>trips.trip_id "
        "stops.parent_station>stops.stop_id stops.level_id>levels.level_id trips.route_id>routes.route_id trips.shape_id>shapes.shape_id trips.service_id>calendar.service_id|calendar_dates.service_id "
        "stop_times.trip_id>trips.trip_id stop_times.stop_id>stops.stop_id stop_times.location_group_id>location_groups.location_group_id stop_times.location_id>zones.feature_id "
        "stop_times.pickup_booking_rule_id>booking_rules.booking_rule_id stop_times.drop_off_booking_rule_id>booking_rules.booking_rule_id frequencies.trip_id>trips.trip_id "
        "transfers.from_stop_id>stops.stop_id transfers.to_stop_id>stops.stop_id transfers.from_route_id>routes.route_id transfers.to_route_id>routes.route_id transfers.from_trip_id>trips.trip_id transfers.to_trip_id>trips.trip_id "
        "pathways.from_stop_id>stops.stop_id pathways.to_stop_id>stops.stop_id fare_rules.fare_id>fare_attributes.fare_id fare_rules.route_id>routes.route_id fare_rules.origin_id>stops.zone_id "
        "fare_rules.destination_id>stops.zone_id fare_rules.contains_id>stops.zone_id fare_products.rider_category_id>rider_categories.rider_category_id fare_products.fare_media_id>fare_media.fare_media_id "
        "fare_leg_rules.network_id>networks.network_id|routes.network_id fare_leg_rules.from_area_id>areas.area_id fare_leg_rules.to_area_id>areas.area_id fare_leg_rules.fare_product_id>fare_products.fare_product_id "
        "fare_leg_rules.from_timeframe_group_id>timeframes.timeframe_group_id fare_leg_rules.to_timeframe_group_id>timeframes.timeframe_group_id fare_transfer_rules.from_leg_group_id>fare_leg_rules.leg_group_id "
        "fare_transfer_rules.to_leg_group_id>fare_leg_rules.leg_group_id fare_transfer_rules.fare_product_id>fare_products.fare_product_id fare_leg_join_rules.from_network_id>networks.network_id|routes.network_id "
        "fare_leg_join_rules.to_network_id>networks.network_id|routes.network_id fare_leg_join_rules.from_stop_id>stops.stop_id fare_leg_join_rules.to_stop_id>stops.stop_id timeframes.service_id>calendar.service_id|calendar_dates.service_id "
        "booking_rules.prior_notice_service_id>calendar.service_id|calendar_dates.service_id location_group_stops.location_group_id>location_groups.location_group_id location_group_stops.stop_id>stops.stop_id "
        "route_networks.network_id>networks.network_id route_networks.route_id>routes.route_id stop_areas.area_id>areas.area_id stop_areas.stop_id>stops.stop_id"
    ).split()
)
