"""Registered queries from archives to notices, over archives that Spark builds from customers."""

from __future__ import annotations

import datetime
import io
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TABLES
from ..sources import csvrows, files
from ..sources.raw import load_lines
from .registry_files import scratch
from .runner import run_all

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Checks that look at what only files tell: declared columns, zones, references.
CHECKS = ("row_rules", "network_files_conflict", "zone_rings", "foreign_key_violation")
RINGS = ("[[0,50],[1,50],[1,51],[0,51],[0,50]]", "[[0,50],[1,50],[1,51],[0,51],[0,50.5]]", "[[0,50],[1,51],[1,50],[0,51],[0,50]]")


def stop_name(n: int, k: int) -> str:
    """A stop's name as it stands in a file: with a stray quote, with a comma, over two lines (in some feeds), padded within quotes, or plain."""
    kinds = {0: f'5" Pipe {k}', 1: f'"Oak, {k}"', 3: f'" Padded {k} "'} | ({2: f'"Two\nLines {k}"'} if n % 3 == 2 else {})
    return kinds.get(k % 7, f" Plain {k} ")


def members(n: int, keys: list[int]) -> dict[str, str]:
    """The files of feed n, which has some fault for each remainder of n."""
    point, network = n % 2 == 0, n % 3 == 0
    out = {
        "agency.txt": "agency_id,agency_name,agency_url,agency_timezone" + (",odd" if n % 5 == 1 else "") + "\nA,Agency,https://a.brussels,UTC+05:00:30" + ("," if n % 5 == 1 else "") + "\n",
        "stops.txt": "\n \n" * (n % 5 == 2) + "stop_id,stop_name,stop_lat,stop_lon\n" + "".join(f"S{k},{stop_name(n, k)},{40 + k % 100 / 1000},-74\n" for k in keys),
        "routes.txt": "route_id,agency_id,route_short_name,route_type" + ",network_id" * network + "\nR,A,1,3" + "," * network + "\n",
        "trips.txt": "route_id,service_id,trip_id\n" + "".join(f"R,W,T{k}\n" for k in keys),
        "calendar.txt": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nW,1,1,1,1,1,1,1,20260101,20261231\n",
        "stop_times.txt": "trip_id,arrival_time,departure_time,stop_id,stop_sequence" + ",timepoint" * point + "\n"
        + "".join(f"T{k},8:00:00,8:00:00,{'X' if k % 17 == 0 else 'S'}{k},1" + (f",{'' if k % 5 == 0 else 1}" if point else "") + "\n" for k in keys),
    }
    if n % 4 < 2:
        out["networks.txt"] = "network_id,network_name\n"
    if n % 6 < 3:
        out["locations.geojson"] = '{"type":"FeatureCollection","features":[\n{"type":"Feature","id":"Z","properties":{},"geometry":{"type":"Polygon","coordinates":[' + RINGS[n % 6] + "]}}\n]}"
    elif n % 6 == 3:
        out["locations.geojson"] = "{"
    return out


def archive(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members(int(key[0]), sorted(rows["c_custkey"])).items():
            z.writestr(name, text)
    return pd.DataFrame({"path": [f"store/F{key[0]}.zip"], "content": [held.getvalue()]})


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive for each nation, with a stop and a trip for each of its customers."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    return rows.groupBy("c_nationkey").applyInPandas(archive, "path string, content binary")


def raw_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = csvrows.split_rows(files.unpack(archives(spark, sf_dir)))
    stops = csvrows.raw_table(rows, "stops")
    declared = F.expr(" + ".join(f"cast(_declared >> {i} & 1 as int)" for i in range(len(TABLES["stops"].names))))
    return stops.select(F.col("feed_id").alias("feed"), "_row_number", "stop_id", "stop_name", declared.alias("n_declared"))


def archives_to_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices by feed and code: of files and cells, and of CHECKS."""
    path = scratch(spark)
    feed, notes = load_lines(files.unpack(archives(spark, sf_dir)), path)
    run = run_all(feed, datetime.date(2026, 6, 1), f"{path}/checks", only=CHECKS)
    if run.failures:
        raise RuntimeError(str(run.failures))
    return notes.unionByName(run.notices).groupBy(F.col("feed_id").alias("feed"), "code").agg(F.count(F.lit(1)).alias("n"))


_C = "c AS (SELECT c_custkey AS k, c_nationkey AS n, 'F' || c_nationkey AS feed FROM customer)"
QUERIES["a2_tolerant_rows"] = raw_stops
SQL["a2_tolerant_rows"] = f"""WITH {_C}
 SELECT feed, 1 + CASE WHEN n % 5 = 2 THEN 2 ELSE 0 END + count(*) OVER w + count(*) FILTER (k % 7 = 2 AND n % 3 = 2) OVER w AS _row_number, 'S' || k AS stop_id,
  CASE k % 7 WHEN 0 THEN '5" Pipe ' WHEN 1 THEN 'Oak, ' WHEN 2 THEN CASE WHEN n % 3 = 2 THEN 'Two' || chr(10) || 'Lines ' ELSE 'Plain ' END WHEN 3 THEN ' Padded ' ELSE 'Plain ' END || k || CASE WHEN k % 7 = 3 THEN ' ' ELSE '' END AS stop_name, 4 AS n_declared
 FROM c WINDOW w AS (PARTITION BY feed ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
QUERIES["l4_archives_to_notices"] = archives_to_notices
SQL["l4_archives_to_notices"] = f"""WITH {_C}, f AS (SELECT DISTINCT n, feed FROM c),
 p(code, feed, n) AS (SELECT 'missing_recommended_file', feed, 1 FROM f UNION ALL SELECT 'unknown_column', feed, 1 FROM f WHERE n % 5 = 1 UNION ALL SELECT 'malformed_json', feed, 1 FROM f WHERE n % 6 = 3
  UNION ALL SELECT 'invalid_geometry', feed, 1 FROM f WHERE n % 6 IN (1, 2) UNION ALL SELECT 'leading_or_trailing_whitespaces', feed, 1 FROM c WHERE k % 7 = 3 UNION ALL SELECT 'new_line_in_value', feed, 1 FROM c WHERE k % 7 = 2 AND n % 3 = 2
  UNION ALL SELECT 'missing_timepoint_value', feed, 1 FROM c WHERE n % 2 = 0 AND k % 5 = 0 UNION ALL SELECT 'route_networks_specified_in_more_than_one_file', feed, 1 FROM f WHERE n % 3 = 0 AND n % 4 < 2
  UNION ALL SELECT 'foreign_key_violation', feed, 1 FROM c WHERE k % 17 = 0 AND feed NOT IN (SELECT feed FROM c WHERE k % 7 = 2 AND n % 3 = 2))
 SELECT feed, code, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY 1, 2"""
