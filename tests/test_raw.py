"""From archives to a report: files, types, status, all checks."""

import datetime
import zipfile

from headway.feed import Feed
from headway.jobs import runner
from headway.notices import report

FILES = {
    "agency.txt": "agency_id,agency_name,agency_url,agency_timezone\nA,City,https://city.berlin,Europe/Berlin\n",
    "stops.txt": "stop_id,stop_name,stop_lat,stop_lon\nS1,First Stop,40.0,-74.0\nS2,\"Second, Stop\",40.0,-73.99\nS3,Third Stop,41.0,-74.0\n",
    "routes.txt": "route_id,agency_id,route_short_name,route_type\nR,A,1,3\n",
    "trips.txt": "route_id,service_id,trip_id,shape_id\nR,W,T,H\nR,W,U,H\n",
    "stop_times.txt": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nT,8:00:00,8:00:00,S1,1\nT,8:10:00,8:10:00,S3,2\nT,8:20:00,8:20:00,S9,3\nU,9:00:00,9:00:00,S1,1\nU,9:10:00,9:10:00,S2,2\n",
    "calendar.txt": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nW,1,1,1,1,1,0,0,20260101,20261231\n",
    "shapes.txt": "shape_id,shape_pt_lat,shape_pt_lon,shape_pt_sequence\nH,40.0,-74.0,1\nH,40.0,-73.99,2\n",
}


def archive(folder, name, files):
    with zipfile.ZipFile(folder / f"{name}.zip", "w") as z:
        for file, text in files.items():
            z.writestr(file, text)


def test_archives_to_report(spark, tmp_path):
    archive(tmp_path, "good", FILES)
    archive(tmp_path, "bad", FILES | {"routes.txt": FILES["routes.txt"].replace(",3\n", ",x\n"), "notes.txt": "x\n", "shapes.txt": ""})
    feed, notes = Feed.load_raw(spark, f"{tmp_path}/*.zip", f"{tmp_path}/stored")
    status = {(r["feed_id"], r["table"]): r["status"] for r in feed.status.collect()}
    assert status[("good", "routes")] == "PARSABLE" and status[("bad", "routes")] == "UNPARSABLE_ROWS"
    assert status[("bad", "shapes")] == "EMPTY_FILE" and status[("good", "levels")] == "MISSING_FILE"
    told = {(r["feed_id"], r["code"]) for r in notes.collect()}
    assert {("bad", "invalid_integer"), ("bad", "unknown_file"), ("bad", "empty_file")} <= told
    assert ("good", "unknown_file") not in told
    assert feed["stops"].where("feed_id = 'good'").count() == 3

    run = runner.run_all(feed, datetime.date(2026, 6, 1), f"{tmp_path}/notices")
    assert run.failures == []
    found = {(r["feed_id"], r["code"]) for r in run.notices.collect()}
    assert {("good", "stop_too_far_from_shape"), ("good", "foreign_key_violation"), ("bad", "foreign_key_violation")} <= found
    # references are gated one by one: to stops and to shapes (empty), which loaded cleanly, and not to routes
    assert {r["context"]["childFieldName"] for r in run.notices.where("feed_id = 'bad' and code = 'foreign_key_violation'").collect()} == {"shape_id", "stop_id"}
    # routes lost a row, so checks that ask for clean routes leave the feed out
    assert ("bad", "stop_too_far_from_shape") not in found
    codes = {r["code"] for r in report(run.notices.unionByName(notes)).where("feed_id = 'good'").collect()}
    assert {"stop_too_far_from_shape", "foreign_key_violation", "missing_recommended_file"} <= codes


def test_a_failing_check_leaves_the_others(spark, tmp_path):
    from tests.feeds import feed

    runner.feed_rule("breaks_in_planning", "stops")(lambda f, today: f["stops"].select("no such column"))
    runner.feed_rule("breaks_in_running", "stops")(lambda f, today: f["stops"].selectExpr(
        "feed_id", "'x' as code", "'INFO' as severity", "'f' as filename", "cast(raise_error('late') as bigint) as row_number", "map('a', 'b') as context"))
    try:
        f = feed(spark, stops=[dict(stop_id="A"), dict(stop_id="A", location_type=1)])
        run = runner.run_all(f, datetime.date(2026, 6, 1), f"{tmp_path}/n", only=["breaks_in_planning", "breaks_in_running", "duplicate_key_stops"])
    finally:
        runner.FEED_RULES.pop("breaks_in_planning")
        runner.FEED_RULES.pop("breaks_in_running")
    assert sorted(name for name, _ in run.failures) == ["breaks_in_planning", "breaks_in_running"]
    assert [r["code"] for r in run.notices.collect()] == ["duplicate_key"]
