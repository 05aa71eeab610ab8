"""Feed tables projected from the driver's star-schema tables, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..feed import Feed

SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

PROJECTION: dict[str, str] = {
    "agency": """select cast(r_regionkey as bigint)+2 as _row_number, case when r_regionkey=4 then null else concat('A',r_regionkey) end as agency_id, r_name as agency_name, concat('http://agency',r_regionkey,'.example.com') as agency_url, case when r_regionkey=3 then 'Europe/Paris' else 'America/New_York' end as agency_timezone, case when r_regionkey=0 then null when r_regionkey=3 then 'fr' else 'en' end as agency_lang from region""",
    "routes": """select _row_number, concat('R',n) as route_id, case when m%7=0 then null else concat('A',rk) end as agency_id, case when m%6=0 then null else concat('N',m%9) end as route_short_name, case when m%4=0 then null else concat('N',m%9,' - Line') end as route_long_name, case m%8 when 6 then 11 when 7 then 12 else m%8 end as route_type, (n*1048573)%16777216 as route_color, (n*3145739)%16777216 as route_text_color, case when n%5=0 then concat('http://AGENCY',rk,'.example.com') end as route_url, case when n%3=0 then 0 else 1 end as continuous_pickup from (select cast(n_nationkey as bigint)+2 as _row_number, n_nationkey as n, n_regionkey as rk, case when n_nationkey>=22 then n_nationkey-20 else n_nationkey end as m from nation) x""",
    "stops": """select p_partkey+2 as _row_number, concat('P',p_partkey) as stop_id, case when p_partkey%31=0 then null else concat(p_name,' ',p_size) end as stop_name, case when p_partkey%37=0 then null else 4e1+(p_partkey%100)*2e-3 end as stop_lat, case when p_partkey%37=0 then null else -7.4e1+floor(p_partkey/100)*2e-3 end as stop_lon, case p_partkey%10 when 7 then 2 when 8 then 3 when 9 then 4 else 0 end as location_type, case when p_partkey%3=0 then null when p_partkey%50=49 then concat('P',p_partkey-2) when p_partkey%10=9 then concat('P',p_partkey-9) else concat('S',p_partkey%110) end as parent_station, case when p_partkey%4=0 then null else concat('Z',p_partkey%5) end as zone_id, case when p_partkey%6=0 then concat('L',p_partkey%3) end as level_id from part union all select s_suppkey+1000002, concat('S',s_suppkey), s_name, 4e1+(s_suppkey%50)*4e-3, -7.4e1+floor(s_suppkey/50)*4e-3, 1, case when s_suppkey%40=0 then 'S1' end, null, null from supplier""",
    "trips": """select o_orderkey+2 as _row_number, concat('T',o_orderkey) as trip_id, concat('R',o_orderkey%26) as route_id, concat('W',o_custkey%45) as service_id, case when o_orderkey%9=0 then null else concat('B',cast(floor(o_orderkey/5) as bigint)) end as block_id, concat('H',o_orderkey%50) as shape_id, case when o_orderkey%2=0 then concat('small ring ',o_orderkey%50+1) end as trip_headsign, cast(o_orderkey%4-1 as int) as bikes_allowed from orders""",
    "stop_times": """select l_orderkey*64+row_number() over (partition by l_orderkey order by l_linenumber desc, l_partkey, l_suppkey, l_extendedprice, l_shipdate)+1 as _row_number, concat('T',case when l_partkey%211=0 then l_orderkey+100000000 else l_orderkey end) as trip_id, case when l_partkey%97=0 then null when l_partkey%89=0 then concat('X',l_partkey) else concat('P',l_partkey) end as stop_id, l_linenumber as stop_sequence, case when l_suppkey%9=0 then null else cast(21600+(l_orderkey%40)*600+l_linenumber*300+cast(l_quantity as int)*20 as int) end as arrival_time, case when l_suppkey%11=0 then null else cast(21600+(l_orderkey%40)*600+l_linenumber*300+cast(l_quantity as int)*20+30 as int) end as departure_time, case when l_suppkey%8=0 then null else round(l_linenumber*100+l_quantity,1) end as shape_dist_traveled, case when l_suppkey%3=0 then null else cast(l_suppkey%2 as int) end as timepoint from lineitem""",
    "calendar": """select c_custkey+2 as _row_number, concat('W',c_custkey) as service_id, cast(c_custkey%2 as int) as monday, cast(floor(c_custkey/2)%2 as int) as tuesday, cast(floor(c_custkey/4)%2 as int) as wednesday, cast(floor(c_custkey/8)%2 as int) as thursday, cast(floor(c_custkey/16)%2 as int) as friday, case when c_custkey%5=0 then 0 else 1 end as saturday, 0 as sunday, date '1995-01-01' as start_date, case when c_custkey%4=0 then date '1996-06-30' else date '1997-12-31' end as end_date from customer""",
    "calendar_dates": """select o_orderkey+2 as _row_number, concat('W',o_custkey%45) as service_id, cast(o_orderdate as date) as date, cast(o_orderkey%2+1 as int) as exception_type from orders""",
    "shapes": """select p_partkey+2 as _row_number, case when p_partkey=7 then 'HX' else concat('H',p_partkey%52) end as shape_id, 4e1+floor(p_partkey/104)*2e-3+case when p_partkey%3=1 then 5e-6 else 0e0 end+case when p_partkey%7=0 then 5e-5 else 0e0 end as shape_pt_lat, -7.4e1+(p_partkey%52)*1e-3 as shape_pt_lon, cast(floor(p_partkey/52) as int) as shape_pt_sequence, case when p_partkey%41=0 then null else floor(p_partkey/104)*2e2-case when p_partkey%29=0 then 3e2 else 0e0 end end as shape_dist_traveled from part""",
    "frequencies": """select event_id+2 as _row_number, concat('T',user_id) as trip_id, cast((event_id%20)*3600 as int) as start_time, cast((event_id%20)*3600+3600*(1+event_id%3) as int) as end_time, cast(300*(1+event_id%4) as int) as headway_secs from events""",
    "transfers": """select event_id+2 as _row_number, concat('P',event_id%191) as from_stop_id, case when event_id%23=0 then null else concat('P',(event_id*7)%193) end as to_stop_id, cast(event_id%6 as int) as transfer_type, case when event_id%3=0 then concat('T',user_id) end as from_trip_id, case when event_id%4=0 then concat('T',(user_id*3)%150) end as to_trip_id, concat('R',event_id%26) as from_route_id, concat('R',(event_id*5)%26) as to_route_id from events""",
    "pathways": """select p_partkey+2 as _row_number, concat('W',p_partkey) as pathway_id, concat('P',p_partkey) as from_stop_id, case when p_partkey%19=0 then concat('S',p_partkey%100) else concat('P',cast(floor(p_partkey/200)*200+(p_partkey*3+1)%200 as bigint)) end as to_stop_id, cast(p_partkey%7+1 as int) as pathway_mode, cast(p_partkey%2 as int) as is_bidirectional from part""",
    "feed_info": """select cast(r_regionkey as bigint)+2 as _row_number, r_name as feed_publisher_name, 'en' as feed_lang, date '1995-02-01' as feed_start_date, date '1997-06-30' as feed_end_date, cast(null as string) as feed_contact_email from region where r_regionkey<2""",
    "fare_rules": """select cast(n_nationkey as bigint)+2 as _row_number, concat('F',n_nationkey) as fare_id, case when n_nationkey%5=0 then null else concat('R',n_nationkey) end as route_id, case when n_nationkey%3=0 then concat('Z',n_nationkey%7) end as origin_id from nation""",
    "flex_stop_times": """select event_id+2 as _row_number, concat('T',user_id) as trip_id, cast(event_id%50 as int) as stop_sequence, case when event_id%3=0 then null else concat('P',event_id%200) end as stop_id, case when event_id%5=0 then concat('Z',event_id%7) end as location_id, case when event_id%11=0 then concat('G',event_id%3) end as location_group_id, case when event_id%4=0 then cast(30000+(event_id%30)*600 as int) end as start_pickup_drop_off_window, case when event_id%4=0 and event_id%9<>0 or event_id%25=0 then cast(33000+(event_id%37)*500 as int) end as end_pickup_drop_off_window, case when event_id%6=0 then cast(30000+event_id%1000 as int) end as arrival_time, case when event_id%6=0 or event_id%8=0 then cast(30100+event_id%1000 as int) end as departure_time, case when event_id%7=0 then null else cast(event_id%4 as int) end as pickup_type, case when event_id%7=1 then null else cast(floor(event_id/2)%4 as int) end as drop_off_type, case when event_id%5=2 or event_id%35=0 then 1e0*(event_id%90) end as shape_dist_traveled, case when event_id%3=1 then cast(event_id%2 as int) end as timepoint, case when event_id%12=0 then concat('K',event_id%9) end as pickup_booking_rule_id, cast(null as string) as drop_off_booking_rule_id from events""",
    "booking_rules": """select p_partkey+2 as _row_number, concat('K',p_partkey) as booking_rule_id, cast(p_partkey%3 as int) as booking_type, case when p_partkey%2=0 then cast(p_partkey%60 as int) end as prior_notice_duration_min, case when p_partkey%5=0 then cast(p_partkey%45 as int) end as prior_notice_duration_max, case when p_partkey%7<3 then cast(p_partkey%7 as int) end as prior_notice_last_day, case when p_partkey%4=0 then 36000 end as prior_notice_last_time, case when p_partkey%6<2 then cast(p_partkey%6 as int) end as prior_notice_start_day, case when p_partkey%8<3 then 28800 end as prior_notice_start_time from part""",
    "timeframes": """select event_id+2 as _row_number, concat('TF',event_id%15) as timeframe_group_id, concat('W',event_id%4) as service_id, case when event_id%10=0 then null else cast((event_id*37%24)*3600 as int) end as start_time, case when event_id%14=0 then null else cast((event_id*37%24)*3600+(event_id%5)*1800 as int) end as end_time from events""",
    "fare_media": """select cast(n_nationkey as bigint)+2 as _row_number, concat('M',n_nationkey) as fare_media_id, case when n_nationkey%4=0 then null else concat('Card ',n_nationkey%6) end as fare_media_name, cast(n_nationkey%5 as int) as fare_media_type from nation""",
    "fare_products": """select p_partkey+2 as _row_number, concat('FP',p_partkey%40) as fare_product_id, case when p_partkey%9=0 then null else concat('RC',p_partkey%11) end as rider_category_id, case when p_partkey%2=0 then concat('M',p_partkey%25) end as fare_media_id from part""",
    "rider_categories": """select cast(n_nationkey as bigint)+2 as _row_number, concat('RC',n_nationkey) as rider_category_id, concat('Riders ',n_nationkey) as rider_category_name, cast(case when n_nationkey%3=0 then 1 else 0 end as int) as is_default_fare_category from nation""",
    "translations": """select p_partkey+2 as _row_number, case when p_partkey%10=3 then 'ghosts' when p_partkey%4=0 then 'routes' when p_partkey%4=1 then 'stop_times' when p_partkey%4=2 then 'feed_info' else 'stops' end as table_name, 'stop_name' as field_name, 'fr' as language, 'x' as translation, case when p_partkey%7=0 then null when p_partkey%4=0 then concat('R',p_partkey%30) when p_partkey%4=1 then concat('T',p_partkey) when p_partkey%4=3 then concat('P',p_partkey*2) end as record_id, case when p_partkey%4=1 and p_partkey%3=0 then cast(p_partkey%7 as string) end as record_sub_id, case when p_partkey%11=0 then 'Main' end as field_value from part""",
    "location_groups": """select cast(n_nationkey as bigint)+2 as _row_number, case when n_nationkey%8=7 then concat('P',n_nationkey) else concat('G',n_nationkey%20) end as location_group_id, n_name as location_group_name from nation""",
    "location_group_stops": """select p_partkey+2 as _row_number, concat('G',p_partkey%20) as location_group_id, concat('P',p_partkey*3) as stop_id from part""",
    "attributions": """select cast(n_nationkey as bigint)+2 as _row_number, concat('AT',n_nationkey) as attribution_id, concat('A',n_regionkey) as agency_id, case when n_nationkey%3=0 then 1 end as is_producer, case when n_nationkey%5=0 then 0 end as is_operator, case when n_nationkey%7=0 then 1 end as is_authority from nation""",
    "fare_attributes": """select cast(n_nationkey as bigint)+2 as _row_number, case when n_nationkey>=20 then concat('FX',n_nationkey) else concat('F',n_nationkey) end as fare_id, case when n_nationkey%4=0 then null else concat('A',n_regionkey) end as agency_id from nation""",
    "fare_transfer_rules": """select p_partkey+2 as _row_number, concat('LG',p_partkey%6) as from_leg_group_id, case when p_partkey%7=0 then null else concat('LG',p_partkey%4) end as to_leg_group_id, case when p_partkey%3=0 then null else cast(p_partkey%9-2 as int) end as transfer_count, case when p_partkey%2=0 then 3600 end as duration_limit, case when p_partkey%5<2 then cast(p_partkey%4 as int) end as duration_limit_type from part""",
    "fare_leg_join_rules": """select cast(n_nationkey as bigint)+2 as _row_number, concat('NW',n_nationkey%5) as from_network_id, concat('NW',n_nationkey%3) as to_network_id, case when n_nationkey%2=0 then concat('P',n_nationkey) end as from_stop_id, case when n_nationkey%3=0 then concat('P',n_nationkey) end as to_stop_id from nation""",
    "networks": """select cast(r_regionkey as bigint)+2 as _row_number, concat('NW',r_regionkey) as network_id, r_name as network_name from region""",
    "zones": """select cast(n_nationkey as bigint) as feature_index, cast(n_nationkey as bigint)+2 as _row_number, case when n_nationkey%9=8 then 'Z1' when n_nationkey%10=7 then concat('P',n_nationkey) else concat('Z',n_nationkey) end as feature_id, 'Polygon' as geometry_type, cast(null as string) as coordinates from nation""",
}

#: Tables of a second feed: the flexible services, with windows and zones.
FLEX = {"stop_times": "flex_stop_times"}


class Projected(dict):
    """Tables by name, each projected when it is first asked for."""

    def __getitem__(self, name: str):
        found = super().__getitem__(name)
        if callable(found):
            found = self[name] = found()
        return found

    def items(self):
        return [(name, self[name]) for name in self]

    def __or__(self, more: dict) -> Projected:
        return Projected({**{name: super(Projected, self).__getitem__(name) for name in self}, **more})


def feed_of(spark: SparkSession, sf_dir: str, *names: str, feed_id: str = "feed", flex: bool = False) -> Feed:
    """The named feed tables (all where none is named), projected from the tables in sf_dir."""

    def project(name: str):
        sql = PROJECTION[FLEX.get(name, name) if flex else name]
        frames = {s: spark.read.parquet(f"{sf_dir}/{s}.parquet") for s in SOURCES if re.search(rf"\bfrom {s}\b", sql)}
        text = re.sub(r"\bfrom (\w+)\b", lambda m: f"from {{{m[1]}}}" if m[1] in frames else m[0], sql)
        return spark.sql(text, **frames).withColumn("feed_id", F.lit(feed_id))

    wanted = names or [n for n in PROJECTION if not n.startswith("flex_")]
    return Feed(spark, Projected({n: (lambda n=n: project(n)) for n in wanted}))


def with_feed(sql: str, flex: bool = False) -> str:
    """sql with the feed tables it names as leading common table expressions."""
    used = [n for n in PROJECTION if not n.startswith("flex_") and re.search(rf"\b(from|join) {n}\b", sql, re.I)]
    ctes = [f"{n} AS ({PROJECTION[FLEX.get(n, n) if flex else n]})" for n in used]
    own = re.match(r"\s*WITH (RECURSIVE )?", sql, re.I)
    if own:
        return f"WITH {own[1] or ''}{', '.join(ctes)}{', ' if ctes else ''}{sql[own.end():]}"
    return f"WITH {', '.join(ctes)} {sql}" if ctes else sql
