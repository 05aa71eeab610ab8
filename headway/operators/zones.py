"""Zones: structure, ring validity, and windows of overlapping zones in one trip."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..feed import Feed
from ..notices import notices, union
from ..shared import stored
from .polygons import geometry_problem, polygons_of

FEED = "feed_id"
FILE = "locations.geojson"


def zone_structure(files: DataFrame) -> DataFrame:
    """files (feed_id, value: the whole text) -> notices on missing and unknown elements and types."""
    top = files.select(FEED, "value", F.get_json_object("value", "$.type").alias("type"), F.get_json_object("value", "$.features").alias("features"), F.json_object_keys("value").alias("keys"), F.expr("try_parse_json(value) is null").alias("broken"))
    fine = top.where("not broken")
    known = F.filter("keys", lambda k: ~k.isin("type", "features"))
    feature = "struct<type:string,id:string,geometry:string,properties:string>"
    parsed = F.from_json("features", "array<string>")
    each = fine.select(FEED, F.posexplode(parsed).alias("i", "text")).select(FEED, "i", F.json_object_keys("text").alias("keys"), F.from_json("text", feature).alias("f"), F.get_json_object("text", "$.geometry.type").alias("kind"), F.get_json_object("text", "$.geometry.coordinates").alias("coordinates"))
    lacking = F.filter(F.array(*(F.when(c.isNull(), F.lit(n)) for n, c in (("features.id", F.col("f.id")), ("features.type", F.col("f.type")), ("features.geometry", F.col("f.geometry")), ("features.properties", F.col("f.properties")), ("features.geometry.type", F.when(F.col("f.geometry").isNull(), "").otherwise(F.col("kind"))), ("features.geometry.coordinates", F.when(F.col("f.geometry").isNull(), "").otherwise(F.col("coordinates")))))), lambda x: x.isNotNull())
    put = lambda df, code, severity, **c: notices(df, code, severity, FILE, None, **c)
    return union([
        put(top.where("broken"), "malformed_json", "ERROR"),
        put(fine.where("type is null"), "missing_required_element", "ERROR", missingElement=F.lit("type")), put(fine.where("features is null"), "missing_required_element", "ERROR", missingElement=F.lit("features")),
        put(fine.where("type <> 'FeatureCollection'"), "unsupported_geo_json_type", "ERROR", geoJsonType="type"), put(fine.select(FEED, F.explode(known).alias("k")), "geo_json_unknown_element", "INFO", unknownElement="k"),
        put(each.select(FEED, "i", F.explode(lacking).alias("k")), "missing_required_element", "ERROR", featureIndex="i", missingElement="k"),
        put(each.where("f.type <> 'Feature'"), "unsupported_feature_type", "ERROR", featureIndex="i", featureType="f.type"), put(each.where("kind not in ('Polygon', 'MultiPolygon')"), "unsupported_geometry_type", "ERROR", featureIndex="i", geometryType="kind"),
        put(each.select(FEED, "i", F.explode(F.filter("keys", lambda k: ~k.isin("type", "id", "geometry", "properties"))).alias("k")), "geo_json_unknown_element", "INFO", featureIndex="i", unknownElement="k"),
    ])


# ---- rings


def side(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which side of a-b c lies on: -1, 0 or 1."""
    v = (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])
    return np.where(np.abs(v) < 1e-15, 0, np.sign(v))


def crossings(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether segment i of path p and segment j of path q cross in a point inside both."""
    a, b, c, d = p[:-1, None], p[1:, None], q[None, :-1], q[None, 1:]
    return (side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)


def zone_points(feed: Feed) -> DataFrame:
    """Points of zones within a degree of (0, 0), or of a pole; one notice for each point of each ring, a closing point too."""
    pair = lambda p: F.struct(F.try_element_at(p, F.lit(1)).try_cast("double").alias("x"), F.try_element_at(p, F.lit(2)).try_cast("double").alias("y"))
    rings = F.when(F.col("geometry_type") == "MultiPolygon", F.flatten(F.from_json("coordinates", "array<array<array<array<string>>>>"))).otherwise(
        F.from_json("coordinates", "array<array<array<string>>>"))
    rows = feed["zones"].select(FEED, "feature_id", "feature_index", F.explode(F.flatten(rings)).alias("p")).select(FEED, "feature_id", "feature_index", pair(F.col("p")).alias("p"))
    origin = (F.abs("p.x") <= 1) & (F.abs("p.y") <= 1)
    code = F.when(origin, "point_near_origin").when(F.abs("p.y") >= 89, "point_near_pole")
    found = rows.withColumn("_code", code).where("_code is not null")
    return notices(
        found, F.col("_code"), "ERROR", "locations.geojson", None,
        featureIndex="feature_index", entityId="feature_id", latFieldValue="p.y", lonFieldValue="p.x",
    )


def spans(polygon: list[np.ndarray], y: float) -> np.ndarray:
    """The stretches (from, to) of the level y that lie inside a polygon."""
    xs = []
    for r in polygon:
        (x1, y1), (x2, y2) = r[:-1].T, r[1:].T
        cut = (y1 > y) != (y2 > y)
        xs += ((x2 - x1)[cut] * (y - y1[cut]) / (y2 - y1)[cut] + x1[cut]).tolist()
    return np.array(sorted(xs)).reshape(-1, 2)


def overlap(a: list[list[np.ndarray]], b: list[list[np.ndarray]]) -> bool:
    """Whether the insides of two geometries meet.

    They do if edges cross. Without crossings it is enough to look at levels between corners.
    """
    for p in a:
        for q in b:
            if (p[0].max(axis=0) <= q[0].min(axis=0)).any() or (q[0].max(axis=0) <= p[0].min(axis=0)).any():
                continue
            if any(crossings(r, s).any() for r in p for s in q):
                return True
            levels = np.unique(np.concatenate([r[:, 1] for r in p + q]))
            for y in (levels[:-1] + levels[1:]) / 2:
                u, v = spans(p, y), spans(q, y)
                if (np.minimum(u[:, None, 1], v[None, :, 1]) - np.maximum(u[:, None, 0], v[None, :, 0]) > 1e-12).any():
                    return True
    return False


def zone_rings(feed: Feed) -> DataFrame:
    """Zones with an invalid geometry, and what is wrong with it."""
    @F.pandas_udf("string")
    def problem(kinds: pd.Series, coordinates: pd.Series) -> pd.Series:
        return pd.Series([geometry_problem(k, c) for k, c in zip(kinds, coordinates, strict=True)], dtype=object)

    found = feed["zones"].where("coordinates is not null").withColumn("problem", problem("geometry_type", "coordinates"))
    return notices(found.where("problem is not null"), "invalid_geometry", "ERROR", FILE, None, featureId="feature_id", featureIndex="feature_index", message="problem")


def zone_window_pairs(feed: Feed) -> DataFrame:
    """Pairs of rows of a trip in different zones, of the same kind of pickup or drop-off, whose windows overlap.

    Windows are dealt into half hours, and a pair is formed in that in which the later one starts.
    """
    start, end = "start_pickup_drop_off_window", "end_pickup_drop_off_window"
    rows = feed["stop_times"].where(f"trip_id is not null and location_id is not null and {start} < {end}").select(
        FEED, "trip_id", "location_id", F.col(start).alias("s"), F.col(end).alias("e"), F.col("_row_number").alias("n"), F.coalesce("pickup_type", F.lit(0)).alias("p"), F.coalesce("drop_off_type", F.lit(0)).alias("d")
    )
    slot = lambda c: F.floor(F.col(c) / 1800)
    a = rows.select(FEED, "trip_id", *(F.col(c).alias(f"{c}1") for c in ("location_id", "s", "e", "n", "p", "d")), F.explode(F.sequence(slot("s"), slot("e"))).alias("slot"))
    b = rows.withColumn("slot", slot("s"))
    kind = (F.col("p") == F.col("p1")) & (F.col("p") != -1) | (F.col("d") == F.col("d1")) & (F.col("d") != -1)
    later = F.struct("s1", "n1") < F.struct("s", "n")
    return a.join(b, [FEED, "trip_id", "slot"]).where(later & (F.col("s") < F.col("e1")) & (F.col("location_id") != F.col("location_id1")) & kind)


def zone_window_overlap(feed: Feed) -> DataFrame:
    """Of those pairs, the ones whose zones are valid and overlap; each zone and each pair of zones is tested once."""
    pairs = zone_window_pairs(feed)
    zones = feed["zones"].where("feature_id is not null and coordinates is not null").groupBy(FEED, "feature_id").agg(F.min_by(F.struct("geometry_type", "coordinates"), "feature_index").alias("z"))

    @F.pandas_udf("boolean")
    def valid(kinds: pd.Series, coordinates: pd.Series) -> pd.Series:
        return pd.Series([geometry_problem(k, c) is None for k, c in zip(kinds, coordinates, strict=True)], dtype=bool)

    @F.pandas_udf("boolean")
    def meet(k1: pd.Series, c1: pd.Series, k2: pd.Series, c2: pd.Series) -> pd.Series:
        return pd.Series([overlap(polygons_of(a, x), polygons_of(b, y)) for a, x, b, y in zip(k1, c1, k2, c2, strict=True)], dtype=bool)

    # only zones of some pair are looked at, each once
    asked = pairs.select(FEED, F.explode(F.array("location_id", "location_id1")).alias("feature_id")).distinct()
    fine = stored(zones.join(asked, [FEED, "feature_id"]).where(valid("z.geometry_type", "z.coordinates")))
    named = lambda i: fine.select(FEED, F.col("feature_id").alias(f"z{i}"), F.col("z.geometry_type").alias(f"k{i}"), F.col("z.coordinates").alias(f"c{i}"))
    keyed = pairs.withColumns({"z1": F.least("location_id", "location_id1"), "z2": F.greatest("location_id", "location_id1")})
    tested = keyed.select(FEED, "z1", "z2").distinct().join(named(1), [FEED, "z1"]).join(named(2), [FEED, "z2"]).where(meet("k1", "c1", "k2", "c2")).select(FEED, "z1", "z2")
    found = keyed.join(tested, [FEED, "z1", "z2"])
    return notices(found, "overlapping_zone_and_pickup_drop_off_window", "ERROR", "stop_times.txt", "n", tripId="trip_id", locationId1="location_id1", locationId2="location_id", otherRow="n1")
