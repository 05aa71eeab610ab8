"""Service calendars: active dates, runs of dates, windows, trips per date, block conflicts.

Runs, first and last dates of a calendar row that alone tells a service follow from the row. Other
dates are rows, so trips per date and shared dates are aggregates and joins. Long spans are
expanded whole, in chunks of CHUNK_DAYS.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..feed import Feed
from ..notices import notices, union

FEED = "feed_id"
SERVICE = [FEED, "service_id"]
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
#: Days of a span that are expanded at once, so that no array of dates is long.
CHUNK_DAYS = 3_660
GAP_DAYS, FAR_DAYS, OUTSIDE_DAYS = 13, 730, 14


def weekly_rows(calendar: DataFrame) -> DataFrame:
    """Calendar rows with a service and both dates: days (a list of bits, Monday first; only a value's low bit counts), start_date, end."""
    days = F.array(*(F.coalesce(F.col(d), F.lit(0)).bitwiseAND(1) for d in DAYS))
    set_ = calendar.where("service_id is not null and start_date is not null and end_date is not null")
    return set_.select(*SERVICE, days.alias("days"), "start_date", F.greatest("end_date", "start_date").alias("end"))


def weekly_dates(calendar: DataFrame) -> DataFrame:
    """feed_id, service_id, date for the days of the week set in [start, end]."""
    offsets = F.sequence(F.lit(0), F.datediff("end", "start_date"), F.lit(CHUNK_DAYS))
    chunks = weekly_rows(calendar).select(*SERVICE, "days", "start_date", "end", F.explode(offsets).alias("offset"))
    first = F.date_add("start_date", F.col("offset"))
    spans = chunks.select(*SERVICE, "days", F.explode(F.sequence(first, F.least("end", F.date_add(first, CHUNK_DAYS - 1)))).alias("date"))
    return spans.where(F.element_at("days", F.weekday("date") + 1) == 1).select(*SERVICE, "date")


def weekly_ends(calendar: DataFrame) -> DataFrame:
    """feed_id, service_id, first, last: the first and last of each row's weekly dates, for rows that have any."""
    on = lambda i, date: F.when(F.col("days")[i] == 1, date)
    first = F.least(*(on(i, F.date_add("start_date", F.pmod(i - F.weekday("start_date"), F.lit(7)))) for i in range(7)))
    last = F.greatest(*(on(i, F.date_sub("end", F.pmod(F.weekday("end") - i, F.lit(7)))) for i in range(7)))
    return weekly_rows(calendar).select(*SERVICE, first.alias("first"), last.alias("last"), "end").where("first <= end").drop("end")


def weekly_runs(calendar: DataFrame) -> DataFrame:
    """feed_id, service_id, first, last: the unbroken runs of each row's weekly dates, a row of work for each run and not for each date."""
    twice = F.array_join(F.concat("days", "days"), "")
    # days of the week that begin a run, and how long it is; the whole week is one run over the span
    begins = [
        F.when((F.col("days")[i] == 1) & (F.col("days")[(i + 6) % 7] == 0), F.struct(F.lit(i).alias("day"), (F.locate("0", F.col("twice"), i + 1) - (i + 1)).alias("n")))
        for i in range(7)
    ]
    rows = weekly_rows(calendar).withColumn("twice", twice)
    whole = F.col("twice") == "1" * 14
    parts = rows.where(~whole).select(*SERVICE, "start_date", "end", F.explode(F.array_compact(F.array(*begins))).alias("run"))
    before = F.date_sub("start_date", F.pmod(F.weekday("start_date") - F.col("run.day"), F.lit(7)))
    chunks = parts.select(*SERVICE, "start_date", "end", "run.n", before.alias("before")).select(
        "*", F.explode(F.sequence(F.lit(0), F.datediff("end", "before"), F.lit(7 * CHUNK_DAYS))).alias("offset"))
    offsets = F.sequence("offset", F.least(F.datediff("end", "before"), F.col("offset") + 7 * (CHUNK_DAYS - 1)), F.lit(7))
    each = chunks.select(*SERVICE, "start_date", "end", "n", "before", F.explode(offsets).alias("at"))
    first = F.date_add("before", F.col("at"))
    runs = each.select(*SERVICE, F.greatest("start_date", first).alias("first"), F.least("end", F.date_add(first, F.col("n") - 1)).alias("last")).where("first <= last")
    return runs.unionByName(rows.where(whole).select(*SERVICE, F.col("start_date").alias("first"), F.col("end").alias("last")))


def lone_rows(calendar: DataFrame, extra: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calendar rows that alone tell their service's dates (no other row, no exception), and the rest.

    What is asked of the former follows from the row itself, so their dates are not shuffled.
    """
    excepted = extra.select(*SERVICE).distinct().withColumn("_excepted", F.lit(True))
    rows = calendar.where("service_id is not null").withColumn("_rows", F.count(F.lit(1)).over(W.partitionBy(*SERVICE))).join(excepted, SERVICE, "left")
    lone = (F.col("_rows") == 1) & F.col("_excepted").isNull()
    return rows.where(lone), rows.where(~lone)


def asked(df: DataFrame, used: DataFrame | None) -> DataFrame:
    """Rows of the services in used (feed_id, service_id); None: all."""
    return df if used is None else df.join(used.select(*SERVICE).distinct(), SERVICE, "left_semi")


def active(feed: Feed, used: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Calendar rows that alone tell the active dates of their service, and the active dates of all other services (see active_dates)."""
    order = W.partitionBy(*SERVICE).orderBy(F.desc("_row_number"))
    last = asked(feed["calendar"].where("service_id is not null"), used).withColumn("_k", F.row_number().over(order)).where("_k = 1")
    extra = asked(feed["calendar_dates"].where("service_id is not null and date is not null").select(*SERVICE, "date", "exception_type"), used)
    lone, rest = lone_rows(last, extra)
    added = weekly_dates(rest).unionByName(extra.where("exception_type = 1").drop("exception_type")).distinct()
    return lone, added.join(extra.where("exception_type = 2").drop("exception_type").distinct(), [*SERVICE, "date"], "left_anti")


def active_dates(feed: Feed, used: DataFrame | None = None) -> DataFrame:
    """Dates on which each service runs: weekly dates and added ones, without removed ones.

    The last calendar row of a service counts. used (feed_id, service_id): the services asked
    for, so that no others' spans are expanded; None: all.
    """
    lone, rest = active(feed, used)
    return weekly_dates(lone).unionByName(rest)


def service_dates(feed: Feed, used: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The variant for windows: all calendar rows, and of a date's exceptions the last in the file decides.

    Calendar rows that alone tell their service's dates, and the dates of all other services.
    """
    extra = asked(feed["calendar_dates"].where("service_id is not null and date is not null and exception_type in (1, 2)"), used)
    last = extra.groupBy(*SERVICE, "date").agg(F.max_by("exception_type", "_row_number").alias("kind"))
    lone, rest = lone_rows(asked(feed["calendar"], used), extra)
    weekly = weekly_dates(rest).distinct()
    return lone, weekly.join(last.select(*SERVICE, "date"), [*SERVICE, "date"], "left_anti").unionByName(last.where("kind = 1").select(*SERVICE, "date"))


def runs_of(dates: DataFrame) -> DataFrame:
    island = F.date_sub("date", F.row_number().over(W.partitionBy(*SERVICE).orderBy("date")))
    return dates.withColumn("island", island).groupBy(*SERVICE, "island").agg(F.min("date").alias("first"), F.max("date").alias("last")).drop("island")


def service_runs(feed: Feed) -> DataFrame:
    """Unbroken runs of service dates: feed_id, service_id, first, last."""
    lone, dates = service_dates(feed)
    return weekly_runs(lone).unionByName(runs_of(dates))


def service_spans(feed: Feed, used: DataFrame | None = None) -> DataFrame:
    """First and last service date of each service with any: feed_id, service_id, first, last."""
    lone, dates = service_dates(feed, used)
    return weekly_ends(lone).unionByName(dates.groupBy(*SERVICE).agg(F.min("date").alias("first"), F.max("date").alias("last")))


def service_windows(feed: Feed, today: datetime.date) -> DataFrame:
    """Gaps of over GAP_DAYS in a service, and services that reach over FAR_DAYS ahead, for each calendar row.

    Weekly dates of one row are at most a week apart, so only the other services can have a gap.
    """
    order = W.partitionBy(*SERVICE).orderBy("first")
    rows = feed["calendar"].where("service_id is not null").select(*SERVICE, "_row_number")
    gaps = runs_of(service_dates(feed)[1]).withColumn("next", F.lead("first").over(order)).where(F.datediff("next", "last") - 1 > GAP_DAYS)
    ends = service_spans(feed).select(*SERVICE, "last").where(F.col("last") > F.lit(today + datetime.timedelta(days=FAR_DAYS)))
    return notices(rows.join(gaps, SERVICE), "big_gap_in_service", "WARNING", "calendar.txt", serviceId="service_id", gapStart="last", gapEnd="next").unionByName(
        notices(rows.join(ends, SERVICE), "service_extends_far_in_the_future", "WARNING", "calendar.txt", serviceId="service_id", lastDate="last")
    )


def feed_period(feed: Feed) -> DataFrame:
    """feed_id, from, to of a feed's first feed_info row, where it has both dates."""
    first = feed["feed_info"].groupBy(FEED).agg(F.min_by(F.struct(F.col("feed_start_date").alias("from"), F.col("feed_end_date").alias("to")), "_row_number").alias("p"))
    return first.select(FEED, "p.*").where("from is not null and to is not null")


def feed_windows(feed: Feed, today: datetime.date) -> DataFrame:
    """A feed's first service date in the future; services outside the feed period; a period far beyond all service."""
    used = feed["trips"].where("service_id is not null").select(*SERVICE).distinct()
    spans = service_spans(feed, used)
    total = spans.groupBy(FEED).agg(F.min("first").alias("first"), F.max("last").alias("last"))
    period = feed_period(feed)
    late = total.where(F.col("first") > F.lit(today))
    before, after = F.greatest(F.datediff("from", "first"), F.lit(0)), F.greatest(F.datediff("last", "to"), F.lit(0))
    outside = spans.join(period, FEED).where("first < from or last > to")
    beyond = total.join(period, FEED).where((F.datediff("first", "from") > OUTSIDE_DAYS) | (F.datediff("to", "last") > OUTSIDE_DAYS))
    return union([
        notices(late, "future_calendar", "INFO", "calendar.txt", None, firstDate="first"),
        notices(outside, "service_window_outside_feed_period", "WARNING", "calendar.txt", None, serviceId="service_id", daysBefore=before, daysAfter=after),
        notices(beyond, "feed_valid_beyond_total_service_window", "WARNING", "feed_info.txt", None, serviceStart="first", serviceEnd="last"),
    ])


def expired_calendar(feed: Feed, today: datetime.date) -> DataFrame:
    """Services whose last date is past; those of calendar_dates alone only if all are, and no calendar row exists."""
    lone, dates = active(feed)
    last = weekly_ends(lone).drop("first").unionByName(dates.groupBy(*SERVICE).agg(F.max("date").alias("last")))
    rows = feed["calendar"].where("service_id is not null").groupBy(*SERVICE).agg(F.min("_row_number").alias("_row_number"))
    past = F.col("last") < F.lit(today)
    weekly = rows.join(last, SERVICE).where(past)
    without = last.join(feed["calendar"].select(FEED).distinct(), FEED, "left_anti")
    all_past = without.groupBy(FEED).agg(F.bool_and(past).alias("all")).where("all").select(FEED)
    dates = feed["calendar_dates"].where("service_id is not null").groupBy(*SERVICE).agg(F.min("_row_number").alias("_row_number"))
    lone = dates.join(without, SERVICE).join(all_past, FEED, "left_semi")
    return notices(weekly, "expired_calendar", "WARNING", "calendar.txt", serviceId="service_id", lastDate="last").unionByName(
        notices(lone, "expired_calendar", "WARNING", "calendar_dates.txt", serviceId="service_id", lastDate="last")
    )


def feed_dates(feed: Feed, today: datetime.date) -> DataFrame:
    """Feeds that end within 7 or 30 days, or start in the future."""
    info = feed["feed_info"]
    soon = lambda days: F.col("feed_end_date") < F.lit(today + datetime.timedelta(days=days))
    return union([
        notices(info.where(soon(7)), "feed_expiration_date7_days", "WARNING", "feed_info.txt", feedEndDate="feed_end_date"),
        notices(info.where(soon(30) & ~soon(7)), "feed_expiration_date30_days", "WARNING", "feed_info.txt", feedEndDate="feed_end_date"),
        notices(info.where(F.col("feed_start_date") > F.lit(today)), "future_feed", "INFO", "feed_info.txt", feedStartDate="feed_start_date"),
    ])


def trip_runs(feed: Feed) -> DataFrame:
    """How often each trip runs a day: once, or as its frequencies say."""
    runs = F.sum(1 + F.expr("cast((end_time - start_time - 1) / headway_secs as int)"))
    often = feed["frequencies"].where("trip_id is not null and start_time is not null and end_time is not null and headway_secs > 0").groupBy(FEED, "trip_id").agg(runs.alias("runs"))
    trips = feed["trips"].where("service_id is not null").select(*SERVICE, "trip_id")
    return trips.join(often, [FEED, "trip_id"], "left").select(*SERVICE, "trip_id", F.coalesce("runs", F.lit(1)).alias("runs"))


def trips_per_date(feed: Feed) -> DataFrame:
    """feed_id, date, n_trips. Trips are summed by service before dates come in."""
    services = trip_runs(feed).groupBy(*SERVICE).agg(F.sum("runs").alias("runs"))
    used = feed["trips"].where("service_id is not null").select(*SERVICE)
    return services.join(active_dates(feed, used), SERVICE).groupBy(FEED, "date").agg(F.sum("runs").alias("n_trips"))


def majority_coverage(feed: Feed, today: datetime.date) -> DataFrame:
    """Feeds whose dates with a usual number of trips don't cover the next seven days."""
    dates = trips_per_date(feed)
    ranked = dates.withColumns({"i": F.row_number().over(W.partitionBy(FEED).orderBy("n_trips", "date")) - 1, "n": F.count(F.lit(1)).over(W.partitionBy(FEED))})
    pick = ranked.where(F.col("i") == F.greatest(F.floor(F.col("n") * 0.9).cast("int"), F.col("n").cast("int") - 30)).select(FEED, F.floor(F.col("n_trips") * 0.75).alias("least"))
    window = dates.join(pick, FEED).where("n_trips >= least").groupBy(FEED).agg(F.min("date").alias("first"), F.max("date").alias("last"))
    short = window.where((F.col("first") > F.lit(today)) | (F.datediff("last", F.lit(today)) < 7))
    return notices(short, "trip_coverage_not_active_for_next7_days", "WARNING", "trips.txt", None, currentDate=F.lit(today), serviceStart="first", serviceEnd="last")


def trip_spans(feed: Feed) -> DataFrame:
    """First and last arrival and departure of each trip in a block."""
    key = F.struct(F.coalesce("stop_sequence", F.lit(0)), "_row_number")
    trips = feed["trips"].where("block_id is not null and trip_id is not null and service_id is not null").select(FEED, "block_id", "trip_id", "service_id", "_row_number")
    times = F.struct("arrival_time", "departure_time")
    edges = feed["stop_times"].where("trip_id is not null").groupBy(FEED, "trip_id").agg(F.min_by(times, key).alias("a"), F.max_by(times, key).alias("b"))
    return trips.join(edges, [FEED, "trip_id"]).select(
        FEED, "block_id", "trip_id", "service_id", "_row_number", F.col("a.arrival_time").alias("arr0"), F.col("a.departure_time").alias("dep0"), F.col("b.arrival_time").alias("arr1"), F.col("b.departure_time").alias("dep1")
    ).where("arr0 is not null and dep0 is not null and arr1 is not null and dep1 is not null")


def block_overlap(feed: Feed) -> DataFrame:
    """Trips of a block that overlap on a day when both run; the first such day is named.

    Pairs meet only where their times overlap: spans are dealt into hours, and a pair is kept in
    the hour in which the later trip starts, so a block with many trips is spread over hours.
    """
    spans = trip_spans(feed)
    hours = F.sequence(F.floor(F.col("arr0") / 3600), F.floor(F.greatest("arr0", "dep1") / 3600))
    early = spans.select(FEED, "block_id", F.explode(hours).alias("hour"), *(F.col(c).alias(f"{c}_a") for c in ("trip_id", "service_id", "_row_number", "arr0", "dep0", "arr1", "dep1")))
    late = spans.withColumn("hour", F.floor(F.col("arr0") / 3600))
    before: Column = F.struct("arr0_a", "dep1_a", "_row_number_a") < F.struct("arr0", "dep1", "_row_number")
    handover = F.expr("arr0 = arr1_a and dep0 = dep1_a")
    pairs = early.join(late, [FEED, "block_id", "hour"]).where(before & (F.col("arr0") < F.col("dep1_a")) & ~handover)
    services = pairs.select(FEED, "service_id_a", "service_id").distinct()
    dates = active_dates(feed, feed["trips"].where("block_id is not null and service_id is not null").select(*SERVICE))
    shared = services.join(dates, SERVICE).join(dates.select(FEED, F.col("service_id").alias("service_id_a"), "date"), [FEED, "service_id_a", "date"]).groupBy(FEED, "service_id_a", "service_id").agg(F.min("date").alias("date"))
    return notices(pairs.join(shared, [FEED, "service_id_a", "service_id"]), "block_trips_with_overlapping_stop_times", "ERROR", "trips.txt", None, blockId="block_id", tripIdA="trip_id_a", tripIdB="trip_id", date="date")
