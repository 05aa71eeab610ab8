"""Runs many checks over a feed, or over all feeds at once."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from ..feed import Feed
from ..notices import COLUMNS, union
from ..operators import aggregates, calendars, distances, graph, joins, keys, matcher, rowrules, sequences, zones
from ..shared import clustered

#: Checks that run side by side, and what their notices are stored as.
AT_ONCE = 4
#: Checks that look at each row of stop_times by itself, or only count its rows, which partial sums do before any shuffle.
BY_ROW = {"row_rules", "usage", "stop_usage"}
SCHEMA = "feed_id string, code string, severity string, filename string, row_number long, context map<string,string>"


@dataclass(frozen=True)
class FeedRule:
    name: str
    check: Callable[[Feed, datetime.date], DataFrame]
    depends: tuple[str, ...]


FEED_RULES: dict[str, FeedRule] = {}


def feed_rule(name: str, depends: str) -> Callable:
    """Registers a check of a whole feed; it runs on feeds whose tables in depends loaded cleanly."""

    def add(check: Callable[[Feed, datetime.date], DataFrame]) -> Callable:
        FEED_RULES[name] = FeedRule(name, check, tuple(depends.split()))
        return check

    return add


def _plain(check: Callable[[Feed], DataFrame], depends: str) -> None:
    feed_rule(check.__name__, depends)(lambda feed, today: check(feed))


for _check, _depends in (
    (keys.foreign_key_violation, ""), (keys.single_row_tables, "feed_info"), (keys.duplicate_geography_id, "stops location_groups zones"), (keys.duplicate_zone_key, "zones"), (keys.duplicate_names, "routes fare_media"),
    (keys.translation_references, "translations"), (keys.rows_missing_agency, "agency routes"), (keys.network_files_conflict, "routes networks route_networks"), (joins.usage, "trips stop_times shapes stops"), (joins.stop_usage, "stops stop_times location_group_stops"),
    (joins.parent_type, "stops"), (joins.pathway_ends, "stops pathways"), (joins.dangling_node, "stops pathways"), (joins.elevator_levels, "stops pathways"), (joins.url_reuse, "agency routes stops"), (joins.ferry_bikes, "routes trips"),
    (joins.transfer_stop_types, "transfers stops"), (joins.transfer_trips, "transfers trips stops stop_times"), (joins.in_seat_ends, "transfers trips routes stops stop_times"), (joins.continuous_service, "routes trips stop_times"), (joins.zone_fares, "fare_rules stops trips stop_times"),
    (joins.agency_consistency, "agency feed_info"), (joins.default_riders, "fare_products rider_categories"), (aggregates.block_route_types, "trips routes"), (aggregates.single_points, "shapes"), (aggregates.lone_flex_stop, "stop_times"), (aggregates.shape_distance_gaps, "trips shapes stop_times"),
    (sequences.unsorted_stop_times, "stop_times"), (sequences.stop_time_times, "stop_times"), (sequences.trip_edges, "stop_times"), (sequences.stop_time_distance, "stop_times"), (sequences.shape_distance, "shapes"), (sequences.adjacent_overlap, "frequencies timeframes"),
    (sequences.trip_vs_shape_distance, "trips stop_times shapes stops"), (sequences.headsign, "trips stops stop_times"), (sequences.fast_consecutive, "routes trips stops stop_times"), (sequences.fast_far, "routes trips stops stop_times"), (calendars.block_overlap, "trips stop_times calendar calendar_dates"),
    (distances.transfer_distance, "transfers stops"), (graph.pathway_unreachable_location, "pathways stops"), (matcher.stop_to_shape, "routes trips stops stop_times shapes"),
    (zones.zone_rings, "zones"), (zones.zone_points, "zones"), (zones.zone_window_overlap, "stop_times zones"),
):
    _plain(_check, _depends)
for _dated, _depends in (
    (calendars.service_windows, "calendar calendar_dates"), (calendars.feed_windows, "trips calendar calendar_dates feed_info"), (calendars.expired_calendar, "calendar calendar_dates"), (calendars.feed_dates, "feed_info"), (calendars.majority_coverage, "trips frequencies calendar calendar_dates"),
):
    feed_rule(_dated.__name__, _depends)(_dated)


@dataclass
class Run:
    """notices: all of them, None where there is no check; failures: (check, message)."""

    notices: DataFrame | None
    failures: list[tuple[str, str]]


def planned(feed: Feed, today: datetime.date, only: Iterable[str] | None = None, as_read: Feed | None = None) -> Iterator[tuple[str, Callable[[], DataFrame | None]]]:
    """The checks by name, each a function that plans it. as_read: the feed that those in BY_ROW read instead."""
    of = lambda name: as_read if as_read is not None and name in BY_ROW else feed
    wanted = set(only) if only is not None else None
    checks = [("row_rules", lambda: rowrules.row_notices(of("row_rules")))]
    for table in [t for t in feed.tables if t != "zones" and keys.TABLES[t].key]:
        checks.append((f"duplicate_key_{table}", lambda t=table: keys.duplicate_key(feed.gated([t]), t)))
    checks += [(rule.name, lambda r=rule: r.check(of(r.name).gated(r.depends), today)) for rule in FEED_RULES.values()]
    return ((name, make) for name, make in checks if wanted is None or name in wanted)


def run_checks(feed: Feed, today: datetime.date, only: Iterable[str] | None = None) -> Run:
    """The notices of the checks as one DataFrame, not yet computed; checks that can't be planned are listed in failures.

    For a few checks that share their reading: stop_times, which most read by trip, is dealt by trip for these. Each takes the
    columns it reads; checks in BY_ROW take the rows as they are. For all of them see run_all.
    """
    as_read = feed
    if "stop_times" in feed:
        feed = Feed(feed.spark, feed.tables | {"stop_times": feed.tables["stop_times"].repartition("feed_id", "trip_id")}, feed.status)
    parts, failures = [], []
    for name, make in planned(feed, today, only, as_read):
        try:
            found = make()
            if found is not None:
                found.schema  # noqa: B018  so that a plan that can't be resolved fails here
                parts.append(found)
        except Exception as e:  # noqa: BLE001  one check's failure leaves the others
            failures.append((name, str(e)))
    return Run(union(parts) if parts else None, failures)


@contextmanager
def by_trip(feed: Feed, path: str) -> Iterator[Feed]:
    """The feed with stop_times in buckets by feed and trip, in the order of each trip."""
    if "stop_times" not in feed:
        yield feed
        return
    with clustered(feed.tables["stop_times"], ["feed_id", "trip_id"], ["feed_id", "trip_id", "stop_sequence"], path) as dealt:
        yield Feed(feed.spark, feed.tables | {"stop_times": dealt}, feed.status)


def run_all(feed: Feed, today: datetime.date, path: str, only: Iterable[str] | None = None, at_once: int = AT_ONCE) -> Run:
    """Runs the checks and writes their notices below path, in folders by check; each is planned and run by itself.

    So planning takes as long as the checks' own plans, and a check that fails, in planning or in
    running, is listed in failures and leaves the others. at_once checks run side by side, whose
    jobs Spark interleaves. A table that isn't cheap to read should be stored before. stop_times is
    shuffled once for all checks, into buckets by trip below path.
    """
    def attempt(check: tuple[str, Callable[[], DataFrame | None]]) -> tuple[str, str] | None:
        name, make = check
        try:
            found = make()
            if found is not None:
                found.select(*COLUMNS).write.mode("overwrite").parquet(f"{path}/check={name}")
            return None
        except Exception as e:  # noqa: BLE001  one check's failure leaves the others
            return name, str(e)

    with by_trip(feed, f"{path}/_clustered") as dealt, ThreadPoolExecutor(at_once) as pool:
        failures = [f for f in pool.map(attempt, planned(dealt, today, only)) if f]
    try:
        return Run(feed.spark.read.schema(SCHEMA).parquet(path).select(*COLUMNS), failures)
    except AnalysisException:  # no check wrote anything
        return Run(None, failures)
