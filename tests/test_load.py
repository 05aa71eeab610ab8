"""From archives to notices: broken CSV, zones, declared columns, status kept with stored tables."""

import datetime
import json
import zipfile

import pytest

from headway.feed import Feed
from headway.jobs import runner

from .test_raw import FILES


def zone(name, ring, kind="Polygon"):
    return {"type": "Feature", "id": name, "properties": {}, "geometry": {"type": kind, "coordinates": [ring]}}


SQUARE = [[0, 50], [1, 50], [1, 51], [0, 51], [0, 50]]
GOOD = FILES | {
    "stop_times.txt": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nT,8:00:00,8:00:00,S1,1\nT,8:10:00,8:10:00,S3,2\nU,9:00:00,9:00:00,S1,1\nU,9:10:00,9:10:00,S2,2\n",
    "networks.txt": "network_id,network_name\nN,Net\n",
    "locations.geojson": json.dumps({"type": "FeatureCollection", "features": [zone("Z1", SQUARE), zone("Z2", SQUARE[:-1] + [[0, 50.5]])]}, indent=1),
}
STRICT = GOOD | {
    "stop_times.txt": GOOD["stop_times.txt"].replace("stop_sequence", "stop_sequence,timepoint").replace("S1,1\n", "S1,1,\n").replace("S3,2\n", "S3,2,1\n").replace("S2,2\n", "S2,2,\n"),
    "routes.txt": "route_id,agency_id,route_short_name,route_type,network_id\nR,A,1,3,\n",
    "locations.geojson": '{"type":"FeatureCollection","features":[{"type":"Feature","id":"Z1","geometry":null}]}',
}
BROKEN = GOOD | {
    "stops.txt": 'stop_id,stop_name,stop_lat,stop_lon\nS1,5" Pipe,40.0,-74.0\nS2,Second,40.0,-73.99\nS3,Third Stop,41.0,-74.0\n',
    "shapes.txt": "\n \n" + FILES["shapes.txt"], "trips.txt": 'route_id,service_id,trip_id,shape_id\nR,W,T,H\nR,W,"U,H\n' + "R,W,X,H\n" * 600, "routes.txt": "route_id,route_id\nR,R\n", "agency.txt": "agency_id,agency_name,agency_url,agency_timezone,odd\n",
    "locations.geojson": "{",
}


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("raw")
    for name, files in (("good", GOOD), ("strict", STRICT), ("broken", BROKEN)):
        with zipfile.ZipFile(top / f"{name}.zip", "w", zipfile.ZIP_DEFLATED if name != "good" else zipfile.ZIP_STORED) as z:
            for file, text in files.items():
                z.writestr(file, text)
    (top / "bad.zip").write_bytes(b"no archive")
    feed, notes = Feed.load_raw(spark, f"{top}/*.zip", f"{top}/stored")
    return feed, {(r["feed_id"], r["code"], r["filename"], r["row_number"]) for r in notes.collect()}, top


def ids(feed, table, column, name):
    return sorted(r[0] for r in feed[table].where(f"feed_id = '{name}'").select(column).collect())


def test_rows_survive_quotes_and_blank_lines(loaded):
    feed, told, _ = loaded
    assert ids(feed, "stops", "stop_name", "broken") == ['5" Pipe', "Second", "Third Stop"]
    assert ids(feed, "shapes", "shape_pt_sequence", "broken") == [1, 2]
    assert ids(feed, "trips", "trip_id", "broken") == ["T"] and ("broken", "csv_parsing_failed", "trips.txt", None) in told
    assert ("broken", "duplicated_column", "routes.txt", None) in told and ids(feed, "routes", "route_id", "broken") == []
    assert ("broken", "unknown_column", "agency.txt", None) in told  # a file of a header alone
    assert ("bad", "missing_required_file", "stops.txt", None) in told


def test_zones_arrive(loaded):
    feed, told, _ = loaded
    assert ids(feed, "zones", "feature_id", "good") == ["Z1", "Z2"]
    assert ids(feed, "zones", "feature_id", "strict") == [] and ids(feed, "zones", "feature_id", "broken") == []
    assert ("broken", "malformed_json", "locations.geojson", None) in told and ("strict", "missing_required_element", "locations.geojson", None) in told


def test_status_stays_with_the_stored_tables(spark, loaded):
    feed, _, top = loaded
    again = Feed.load(spark, f"{top}/stored/typed")
    status = {(r["feed_id"], r["table"]): r["status"] for r in again.status.collect()}
    want = {
        ("good", "zones"): "PARSABLE", ("broken", "zones"): "UNPARSABLE_ROWS", ("strict", "zones"): "UNPARSABLE_ROWS", ("broken", "trips"): "UNPARSABLE_ROWS", ("broken", "routes"): "INVALID_HEADERS",
        ("good", "routes"): "PARSABLE", ("bad", "stops"): "MISSING_FILE", ("broken", "agency"): "PARSABLE", ("good", "levels"): "MISSING_FILE",
    }
    assert {k: status[k] for k in want} == want
    gated = again.gated(["routes"])
    assert {r["feed_id"] for r in gated["routes"].select("feed_id").distinct().collect()} == {"good", "strict"}


def test_rules_ask_for_declared_columns(spark, loaded, tmp_path):
    feed, _, _ = loaded
    run = runner.run_all(feed, datetime.date(2026, 6, 1), f"{tmp_path}/n", only=["row_rules", "network_files_conflict", "zone_rings", "foreign_key_violation"])
    assert run.failures == []
    found = sorted((r["feed_id"], r["code"], r["row_number"] or 0) for r in run.notices.collect() if r["code"] in ("missing_timepoint_value", "route_networks_specified_in_more_than_one_file", "invalid_geometry"))
    assert found == [
        ("good", "invalid_geometry", 0), ("strict", "missing_timepoint_value", 2), ("strict", "missing_timepoint_value", 4), ("strict", "missing_timepoint_value", 5),
        ("strict", "route_networks_specified_in_more_than_one_file", 0),
    ]
