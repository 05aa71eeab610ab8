"""Coordinates and distances of stops, transfers and shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..feed import Feed, first_rows
from ..functions.geo import chord_angle_m, haversine_m, metres
from ..notices import notices

FEED = "feed_id"


def stop_coordinates(feed: Feed) -> DataFrame:
    """feed_id, stop_id, lat, lon: a stop's own coordinates, else its parent's, else the grandparent's."""
    own = first_rows(feed["stops"].where("stop_id is not null").select(FEED, "stop_id", "stop_lat", "stop_lon", "parent_station", "_row_number"), "stop_id")
    place = F.when(F.col("stop_lat").isNotNull() & F.col("stop_lon").isNotNull(), F.struct(F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon")))
    s = own.select(FEED, "stop_id", "parent_station", place.alias("p0"))
    up = lambda i: s.select(FEED, F.col("stop_id").alias(f"up{i}"), F.col("p0").alias(f"p{i}"), F.col("parent_station").alias(f"up{i + 1}"))
    rows = s.withColumnRenamed("parent_station", "up1").join(up(1), [FEED, "up1"], "left").join(up(2).drop("up3"), [FEED, "up2"], "left")
    return rows.select(FEED, "stop_id", F.coalesce("p0", "p1", "p2").alias("p")).select(FEED, "stop_id", "p.lat", "p.lon")


def transfer_distance(feed: Feed) -> DataFrame:
    """Transfers over 2 km, and over 10 km; an end without coordinates lies at (0, 0)."""
    places = stop_coordinates(feed)
    end = lambda side: places.select(FEED, F.col("stop_id").alias(f"{side}_stop_id"), F.coalesce("lat", F.lit(0.0)).alias(f"{side}_lat"), F.coalesce("lon", F.lit(0.0)).alias(f"{side}_lon"))
    t = feed["transfers"].where("from_stop_id is not null and to_stop_id is not null").select(FEED, "_row_number", "from_stop_id", "to_stop_id")
    rows = t.join(end("from"), [FEED, "from_stop_id"], "left").join(end("to"), [FEED, "to_stop_id"], "left").na.fill(0.0, ["from_lat", "from_lon", "to_lat", "to_lon"])
    rows = rows.withColumn("m", chord_angle_m(F.col("from_lat"), F.col("from_lon"), F.col("to_lat"), F.col("to_lon")))
    context = {"fromStopId": F.col("from_stop_id"), "toStopId": F.col("to_stop_id"), "distance": metres(F.col("m"))}
    return notices(rows.where("m > 2000 and m <= 10000"), "transfer_distance_above_2_km", "INFO", "transfers.txt", **context).unionByName(
        notices(rows.where("m > 10000"), "transfer_distance_too_large", "WARNING", "transfers.txt", **context)
    )


def shape_running_distance(feed: Feed) -> DataFrame:
    """Each shape point with metres along the shape and the largest user distance so far."""
    by = W.partitionBy(FEED, "shape_id").orderBy("shape_pt_sequence", "_row_number")
    hop = haversine_m(F.lag("shape_pt_lat").over(by), F.lag("shape_pt_lon").over(by), F.col("shape_pt_lat"), F.col("shape_pt_lon"))
    rows = feed["shapes"].where("shape_id is not null").withColumn("hop", F.coalesce(hop, F.lit(0.0)))
    return rows.select(FEED, "shape_id", "_row_number", F.sum("hop").over(by).alias("metres"), F.max("shape_dist_traveled").over(by).alias("user_distance"))
