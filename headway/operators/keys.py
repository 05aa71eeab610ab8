"""Keys and references: duplicates, anti-joins to parents, and rules on which keys must be there."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..feed import Feed
from ..notices import context_of, notices, union
from ..schema import REFERENCES, TABLES, Reference
from ..shared import stored

#: Keys that are broadcast to the rows that have them; more are joined by a shuffle.
BROADCAST_ROWS = 20_000


def clock(seconds: Column) -> Column:
    part = lambda n: F.lpad(F.floor(n).cast("string"), 2, "0")
    return F.concat(part(seconds / 3600), F.lit(":"), part(seconds / 60 % 60), F.lit(":"), part(seconds % 60))


def shown(table: str, column: str) -> Column:
    """A key part as text; times as HH:MM:SS."""
    return clock(F.col(column)) if TABLES[table].field(column).type == "time" else F.col(column).cast("string")


def picked(rows: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """rows joined to the few of their keys that are wanted, which are found first.

    Up to BROADCAST_ROWS keys go to the rows, so rows aren't shuffled; beyond, both are.
    """
    wanted = stored(wanted)
    return rows.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, on)


def duplicate_key(feed: Feed, table: str) -> DataFrame:
    """Rows after the first of their key. Null parts of a composite key are 0 or empty; a single null key is no key.

    Only keys that occur twice are sorted: they are counted first, with partial sums, so a table
    without duplicates moves one row per key.
    """
    key, df = TABLES[table].key, feed[table]
    parts = [F.col(k) if len(key) == 1 else F.coalesce(F.col(k).cast("string"), F.lit("" if TABLES[table].struct()[k].dataType.simpleString() == "string" else "0")) for k in key]
    names = [f"_k{i}" for i in range(len(key))]
    rows = df.select("feed_id", "_row_number", *key, *(p.alias(n) for p, n in zip(parts, names, strict=True)))
    rows = rows.where("_k0 is not null") if len(key) == 1 else rows
    repeated = rows.groupBy("feed_id", *names).agg(F.count(F.lit(1)).alias("_n"), F.min("_row_number").alias("_old")).where("_n > 1")
    again = picked(rows, repeated, ["feed_id", *names])
    # the key as its first row has it, formatted for repeated keys only
    first = W.partitionBy("feed_id", *names).orderBy("_row_number")
    value = F.first(F.concat_ws(",", *(shown(table, k) for k in key))).over(first)
    named = F.first(F.concat_ws(",", *(F.when(F.col(k).isNotNull(), F.lit(k)) for k in key))).over(first)
    later = again.withColumns({"_value": value, "_names": named}).where("_row_number > _old")
    return notices(later, "duplicate_key", "ERROR", TABLES[table].file, oldCsvRowNumber="_old", fieldName=F.col("_names"), fieldValue=F.col("_value"))


def single_row_tables(feed: Feed) -> DataFrame:
    """Tables that must have one row and have more."""
    parts = []
    for t in TABLES.values():
        if t.single_row:
            counts = feed[t.name].groupBy("feed_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            parts.append(notices(counts, "more_than_one_entity", "ERROR", t.file, None, rowCount="n"))
    return union(parts)


def parent_names(r: Reference) -> str:
    return "|".join(f"{t}.{c}" for t, c in r.parents)


def is_single_key(table: str, column: str) -> bool:
    return TABLES[table].key == (column,)


def foreign_key_violation(feed: Feed, references: Iterable[Reference] = REFERENCES) -> DataFrame:
    """Child values that no parent has, for each reference whose child column is declared.

    Parent nulls count as empty text unless the parent column is its table's key. The references
    of a child table become rows, whose different values (partial sums leave few) are grouped
    with those of the parents in one aggregate; only the values found missing go back to the rows
    of the tables, so popular values are never shuffled by row unless many values are missing.
    """
    used = [r for r in references if feed.has(r.child, r.column)]
    groups = {name: g for g, name in enumerate(dict.fromkeys(parent_names(r) for r in used))}
    children, parents = [], []
    for table in dict.fromkeys(r.child for r in used):
        own = [(i, r) for i, r in enumerate(used) if r.child == table]
        # a reference travels as its number
        cells = F.array(*(
            F.when(F.col(r.column) != "" if r.skip_empty else F.col(r.column).isNotNull(), F.struct(F.lit(i).alias("i"), F.lit(groups[parent_names(r)]).alias("g"), F.col(r.column).alias("value")))
            for i, r in own
        ))
        children.append(feed[table].select("feed_id", "_row_number", F.explode(cells).alias("c")).where("c is not null"))
    for r in {parent_names(r): r for r in used}.values():
        for t, c in r.parents:
            value = F.col(c) if is_single_key(t, c) else F.coalesce(F.col(c), F.lit(""))
            parents.append(feed[t].select("feed_id", F.lit(groups[parent_names(r)]).alias("g"), value.alias("value")).where("value is not null"))
    cells = union(children).select("feed_id", "_row_number", "c.*")
    asked = ["feed_id", "g", "value"]
    values = cells.select(*asked, F.lit(False).alias("known")).unionByName(union(parents).withColumn("known", F.lit(True)))
    missing = values.groupBy(*asked).agg(F.max("known").alias("known")).where("not known").select(*asked)
    found = picked(cells, missing, asked)
    of = lambda values: F.get(F.array(*map(F.lit, values)), F.col("i"))
    if feed.status is not None:
        # a reference is checked for feeds whose tables it names loaded cleanly
        needs = F.get(F.array(*(F.array(*map(F.lit, (r.child, *(t for t, _ in r.parents)))) for r in used)), F.col("i"))
        found = found.join(feed.unclean().groupBy("feed_id").agg(F.collect_set("table").alias("_bad")), "feed_id", "left")
        found = found.where(~F.coalesce(F.arrays_overlap("_bad", needs), F.lit(False)))
    return found.select(
        "feed_id", F.lit("foreign_key_violation").alias("code"), F.lit("ERROR").alias("severity"), of([TABLES[r.child].file for r in used]).alias("filename"),
        F.col("_row_number").cast("long").alias("row_number"), context_of({
            "childFieldName": of([r.column for r in used]), "parentFilename": of([" or ".join(TABLES[t].file for t, _ in r.parents) for r in used]), "fieldValue": "value",
        }).alias("context"),
    )


def duplicate_geography_id(feed: Feed) -> DataFrame:
    """Ids that at least two of stops, location groups and zones use."""
    sources = (("stops", "stop_id"), ("location_groups", "location_group_id"), ("zones", "feature_id"))
    tagged = union([feed[t].where(F.col(c).isNotNull()).select("feed_id", F.col(c).alias("id"), F.lit(i).alias("s"), F.col("_row_number").cast("long").alias("n")) for i, (t, c) in enumerate(sources)])
    at = [F.min(F.when(F.col("s") == i, F.col("n"))) for i in range(3)]
    found = tagged.groupBy("feed_id", "id").agg(F.count_distinct("s").alias("k"), *(a.alias(f"at{i}") for i, a in enumerate(at))).where("k > 1")
    return notices(found, "duplicate_geography_id", "ERROR", "stops.txt", None, geographyId="id", stopRow="at0", groupRow="at1", zoneRow="at2")


def duplicate_zone_key(feed: Feed) -> DataFrame:
    zones = feed["zones"].where("feature_id is not null")
    first = zones.withColumn("first", F.min("feature_index").over(W.partitionBy("feed_id", "feature_id")))
    return notices(first.where("feature_index > first"), "duplicate_geo_json_key", "ERROR", "locations.geojson", None, featureId="feature_id", firstIndex="first", secondIndex="feature_index")


def later_twins(df: DataFrame, *columns: str) -> DataFrame:
    """Rows that equal an earlier row in the columns (null equals empty), with the first such row as _old."""
    names = [f"_k{i}" for i in range(len(columns))]
    keyed = df.withColumns({n: F.coalesce(F.col(c).cast("string"), F.lit("")) for n, c in zip(names, columns, strict=True)})
    return keyed.withColumn("_old", F.min("_row_number").over(W.partitionBy("feed_id", *names))).where("_row_number > _old")


def duplicate_names(feed: Feed) -> DataFrame:
    routes = later_twins(feed["routes"], "route_long_name", "route_short_name", "route_type", "agency_id")
    media = later_twins(feed["fare_media"], "fare_media_name", "fare_media_type")
    return notices(routes, "duplicate_route_name", "WARNING", "routes.txt", routeId="route_id", firstRow="_old").unionByName(
        notices(media, "duplicate_fare_media", "WARNING", "fare_media.txt", fareMediaId="fare_media_id", firstRow="_old")
    )


def translation_references(feed: Feed) -> DataFrame:
    """Rows of translations that are incomplete, contradictory, or name no table or record.

    If a row of a feed lacks a required field, nothing else is checked for that feed.
    """
    t = feed["translations"]
    required = ("field_name", "language", "table_name")
    lacking = union([notices(t.where(F.col(c).isNull()), "missing_required_field", "ERROR", "translations.txt", fieldName=F.lit(c)) for c in required])
    incomplete = t.where(" or ".join(f"{c} is null" for c in required)).select("feed_id").distinct()
    t = t.join(incomplete, "feed_id", "left_anti")
    unexpected = []
    for c in ("record_id", "record_sub_id"):
        unexpected.append((t.where(f"field_value is not null and {c} is not null"), c))
    tables = {n for n in TABLES if n in feed and n != "zones"}
    unknown = t.where(~F.col("table_name").isin(sorted(tables)))
    by_record = t.where(F.col("field_value").isNull() & F.col("table_name").isin(sorted(tables)))
    keys = {n: TABLES[n].key for n in tables}
    single, composite = [n for n in tables if len(keys[n]) >= 1], [n for n in tables if len(keys[n]) >= 2]
    wants_id, wants_sub = F.col("table_name").isin(sorted(single)), F.col("table_name").isin(sorted(composite))
    missing = [(by_record.where(wants_id & F.col("record_id").isNull()), "record_id"), (by_record.where(wants_sub & F.col("record_sub_id").isNull()), "record_sub_id")]
    extra = [(by_record.where(~wants_id & F.col("record_id").isNotNull()), "record_id"), (by_record.where(~wants_sub & F.col("record_sub_id").isNotNull()), "record_sub_id")]
    complete = by_record.where((wants_id == F.col("record_id").isNotNull()) & (wants_sub == F.col("record_sub_id").isNotNull()))
    records = []
    for n in sorted(tables):
        k = keys[n]
        ids = [shown(n, c) for c in k[:2]] + [F.lit("")] * (2 - min(2, len(k)))
        records.append(feed[n].select("feed_id", F.lit(n).alias("table_name"), F.coalesce(ids[0], F.lit("")).alias("_r"), F.coalesce(ids[1], F.lit("")).alias("_s")))
    wanted = complete.withColumns({"_r": F.coalesce("record_id", F.lit("")), "_s": F.coalesce("record_sub_id", F.lit(""))})
    # the few records that are asked for are found first; all records, different or not, are never held
    record = ["feed_id", "table_name", "_r", "_s"]
    known = picked(union(records), wanted.select(*record).distinct(), record).distinct()
    ghosts = wanted.join(known, record, "left_anti")
    file = "translations.txt"
    return union(
        [lacking, notices(unknown, "translation_unknown_table_name", "WARNING", file, tableName="table_name")]
        + [notices(df, "translation_unexpected_value", "ERROR", file, fieldName=F.lit(c)) for df, c in unexpected + extra]
        + [notices(df, "missing_required_field", "ERROR", file, fieldName=F.lit(c)) for df, c in missing]
        + [notices(ghosts, "translation_foreign_key_violation", "ERROR", file, tableName="table_name", recordId="record_id", recordSubId="record_sub_id")]
    )


def rows_missing_agency(feed: Feed) -> DataFrame:
    """Null agency ids: an error where a feed has several agencies, a hint where it has one."""
    agencies = feed["agency"].groupBy("feed_id").agg(F.count(F.lit(1)).alias("n_agencies"))
    parts = []
    for t in ("agency", "routes", "fare_attributes"):
        if feed.has(t, "agency_id"):
            rows = feed[t].where("agency_id is null").select("feed_id", "_row_number").join(agencies, "feed_id")
            parts.append(notices(rows.where("n_agencies > 1"), "missing_required_agency_id", "ERROR", TABLES[t].file))
            parts.append(notices(rows.where("n_agencies = 1"), "missing_recommended_field", "WARNING", TABLES[t].file, fieldName=F.lit("agency_id")))
    return union(parts)


def network_files_conflict(feed: Feed) -> DataFrame:
    """Routes that declare network_id in a feed that has network files as well."""
    base = feed.declaring("routes", "network_id")
    files = union([feed.having(t).select("feed_id", F.lit(TABLES[t].file).alias("file")) for t in ("route_networks", "networks")])
    names = files.groupBy("feed_id").agg(F.array_join(F.array_sort(F.collect_set("file")), ",").alias("files"))
    return notices(base.join(names, "feed_id"), "route_networks_specified_in_more_than_one_file", "ERROR", "routes.txt", None, fileNames="files")


