"""Small feeds as rows."""

from headway.feed import Feed
from headway.schema import TABLES


def feed(spark, feed_id="f", **tables):
    """tables: name -> list of dicts; rows are numbered from 2 unless they say."""
    out = {}
    for name, rows in tables.items():
        schema = TABLES[name].struct()
        full = [{f.name: None for f in schema} | {"feed_id": feed_id, "_row_number": i + 2} | r for i, r in enumerate(rows)]
        out[name] = spark.createDataFrame([tuple(r[f.name] for f in schema) for r in full], schema)
    return Feed(spark, out)


def codes(found):
    """Sorted (code, row_number, context) of notices."""
    return sorted(((r["code"], r["row_number"], dict(r["context"])) for r in found.collect()), key=str)


def pairs(found):
    return sorted(((c, n) for c, n, _ in codes(found)), key=str)


def stop_times(*rows):
    names = ("trip_id", "stop_id", "stop_sequence", "arrival_time", "departure_time", "shape_dist_traveled")
    return [dict(zip(names, r, strict=False)) for r in rows]
