"""Stations and what can be reached in them."""

from __future__ import annotations

import uuid
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..feed import Feed
from ..notices import notices
from ..shared import shared_folder, stored
from .joins import stop_types

FEED = "feed_id"


def including_station(feed: Feed) -> DataFrame:
    """feed_id, stop_id, station: the station at most three steps up (a station is its own)."""
    s = stop_types(feed).select(FEED, "stop_id", "type", "parent_station")
    rows = s.select(FEED, "stop_id", F.col("type").alias("t0"), F.col("parent_station").alias("u1"))
    for i in (1, 2, 3):
        up = s.select(FEED, F.col("stop_id").alias(f"u{i}"), F.col("type").alias(f"t{i}"), F.col("parent_station").alias(f"u{i + 1}"))
        rows = rows.join(up, [FEED, f"u{i}"], "left")
    station = F.when(F.col("t0") == 1, F.col("stop_id"))
    for i in (1, 2, 3):
        station = station.when(F.col(f"t{i}") == 1, F.col(f"u{i}"))
    return rows.select(FEED, "stop_id", station.alias("station")).where("station is not null")


def reached(edges: DataFrame, start: DataFrame) -> DataFrame:
    """All (feed_id, way, stop_id) reachable from start (the same columns) along edges (feed_id, way, a, b) of one way.

    What a round finds is appended to a table by round number, and the next round joins that part
    alone. Rounds are as many as the longest shortest path, which within a station is short, and
    end when one finds nothing.
    """
    spark = edges.sparkSession
    path = f"{shared_folder(spark)}/reached-{uuid.uuid4().hex}"
    keys = [FEED, "way", "stop_id"]
    schema = f"{FEED} string, way string, stop_id string"
    found = start.select(*keys).distinct()
    for n in count():
        found.write.parquet(f"{path}/round={n:05d}")
        last = spark.read.schema(schema).parquet(f"{path}/round={n:05d}")
        if last.isEmpty():
            return spark.read.schema(schema).parquet(path).select(*keys)
        step = last.join(edges.withColumnRenamed("a", "stop_id"), keys).select(FEED, "way", F.col("b").alias("stop_id")).distinct()
        found = step.join(spark.read.schema(schema).parquet(path).select(*keys), keys, "left_anti")


def pathway_unreachable_location(feed: Feed) -> DataFrame:
    """In stations with pathways: places that no entrance leads to, or from which none is reached."""
    ways = feed["pathways"].where("from_stop_id is not null and to_stop_id is not null")
    forth = ways.select(FEED, F.col("from_stop_id").alias("a"), F.col("to_stop_id").alias("b"))
    back = ways.where("is_bidirectional = 1").select(FEED, F.col("to_stop_id").alias("a"), F.col("from_stop_id").alias("b"))
    edges = stored(forth.unionByName(back).distinct())
    stations = stored(including_station(feed))
    ends = ways.select(FEED, F.explode(F.array("from_stop_id", "to_stop_id")).alias("stop_id")).distinct()
    with_ways = ends.join(stations, [FEED, "stop_id"]).select(FEED, "station").distinct()
    types = stop_types(feed)
    inside = stations.join(with_ways, [FEED, "station"], "left_semi").join(types.select(FEED, "stop_id", "type", "stop_row"), [FEED, "stop_id"])
    parents = types.where("parent_station is not null").select(FEED, F.col("parent_station").alias("stop_id")).distinct()
    places = inside.where("type in (3, 4)").unionByName(inside.where("type = 0").join(parents, [FEED, "stop_id"], "left_anti"))
    entrances = inside.where("type = 2")
    turned = edges.select(FEED, F.lit("out").alias("way"), F.col("b").alias("a"), F.col("a").alias("b"))
    both = edges.select(FEED, F.lit("in").alias("way"), "a", "b").unionByName(turned)
    start = entrances.select(FEED, F.explode(F.array(F.lit("in"), F.lit("out"))).alias("way"), "stop_id")
    ways_of = reached(both, start).groupBy(FEED, "stop_id").agg(F.collect_set("way").alias("ways"))
    on = lambda way: F.coalesce(F.array_contains("ways", way), F.lit(False))
    rows = places.join(ways_of, [FEED, "stop_id"], "left").withColumns({"hasEntrance": on("in"), "hasExit": on("out")})
    return notices(rows.where("not hasEntrance or not hasExit"), "pathway_unreachable_location", "ERROR", "stops.txt", "stop_row", stopId="stop_id", hasEntrance="hasEntrance", hasExit="hasExit")
