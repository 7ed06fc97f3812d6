"""Views over the given tables that stand for gusts, scans, stations, radars, hourly grids, tracks, masks and profiles.

The same text runs in Spark SQL and in the checking engine; names in braces are tables or other views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "obs": """SELECT event_id, user_id AS stn_id, user_id % 25 AS rid, ts AS dt_utc, value AS gust,
 CASE WHEN event_type = 'error' THEN 'N' ELSE 'Y' END AS q FROM {events}""",
    "scan_at_station": """SELECT user_id AS stn_no, ts AS scan_time, event_id AS scan, (event_id * 31) % 97 AS uid10, value AS field_max,
 CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS in10km FROM {events} WHERE event_type IN ('view', 'click')""",
    "stations": """SELECT c_custkey AS stn_no, -44.0 + CAST((c_custkey * 7919) % 3400 AS DOUBLE) / 100 AS lat,
 113.0 + CAST((c_custkey * 104729) % 4000 AS DOUBLE) / 100 AS lon, CAST(c_custkey % 900 AS DOUBLE) AS hgt_asl,
 1990 + c_custkey % 25 AS y1, 1990 + c_custkey % 25 + c_custkey % 17 AS y2, 90.0 + CAST(c_custkey % 100 AS DOUBLE) / 10 AS qc_pct FROM {customer}""",
    "radars": """SELECT n_nationkey AS rid, -43.0 + CAST((n_nationkey * 1237) % 3200 AS DOUBLE) / 100 AS lat0,
 114.0 + CAST((n_nationkey * 2741) % 3800 AS DOUBLE) / 100 AS lon0, n_regionkey AS region FROM {nation}""",
    "env": """SELECT i, j, CAST(-44 + 2 * i AS DOUBLE) AS lat, CAST(113 + 2 * j AS DOUBLE) AS lon, CAST((i * 7 + j * 3) % 10 AS DOUBLE) / 10 AS lsm, h,
 8.0 + CAST(q AS DOUBLE) / n AS s06, 4.0 + CAST(d AS DOUBLE) / n AS qmean01, 5.0 + CAST(t AS DOUBLE) / n AS lr13, 2.0 + CAST(p AS DOUBLE) / n AS umean06
 FROM (SELECT l_partkey % 16 AS i, l_orderkey % 18 AS j, l_linenumber - 1 AS h, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS q,
 sum(CAST(round(l_discount * 100) AS BIGINT)) AS d, sum(CAST(round(l_tax * 50) AS BIGINT)) AS t, sum(CAST(round(l_extendedprice / 5000) AS BIGINT)) AS p
 FROM {lineitem} GROUP BY l_partkey % 16, l_orderkey % 18, l_linenumber - 1) AS g""",
    "tracks": """SELECT o_custkey % 500 AS uid, o_orderkey AS scan, o_orderdate AS time, count(*) AS local_max,
 sum(l_quantity) AS major_axis_length, sum(l_quantity) / (1 + o_orderkey % 5) AS minor_axis_length,
 CAST(4 + o_orderkey % 9 AS DOUBLE) AS max_alt, CAST(o_orderkey % 100 AS DOUBLE) / 12.5 AS azi_shear,
 CAST(o_orderkey % 40 AS DOUBLE) AS speed, CAST((o_orderkey * 37) % 360 AS DOUBLE) AS angle,
 CAST(o_orderkey % 7 AS DOUBLE) AS speed_rnge, CAST(o_orderkey % 11 AS DOUBLE) / 10 AS conv_pct FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey
 GROUP BY o_custkey, o_orderkey, o_orderdate""",
    "skill": """SELECT l_orderkey * 10 + l_linenumber AS row_id, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS scw,
 CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS in10km, l_partkey % 3 AS cluster, year(l_shipdate) AS yr, month(l_shipdate) AS mon,
 l_quantity, l_extendedprice, l_discount, l_tax FROM {lineitem}""",
    "ensemble": """SELECT l_suppkey % 12 AS model, CASE WHEN year(l_shipdate) < 1998 THEN 'past' ELSE 'future' END AS experiment,
 l_partkey % 50 AS point, year(l_shipdate) AS yr, month(l_shipdate) AS mon, l_quantity AS days FROM {lineitem}""",
    "mask": """SELECT scan, uid, (scan * 17) % 180 + di + 5 AS i, (scan * 29) % 180 + dj + 5 AS j FROM
 (SELECT o_orderkey AS scan, o_custkey % 500 AS uid FROM {orders}) AS s
 CROSS JOIN range(-2, 3) AS a(di) CROSS JOIN range(-2, 3) AS b(dj) WHERE di * di + dj * dj <= 1 + (scan % 4)""",
    "scan_storms": """SELECT CAST(floor(o_orderkey / 4.0) AS BIGINT) % 25 AS rid, CAST(floor(o_orderkey / 4.0) AS BIGINT) AS scan, o_orderkey AS uid, o_totalprice AS field_max, o_totalprice / (1 + o_orderkey % 7) AS vol,
 make_timestamp(2024, 1, CAST(1 + (CAST(floor(o_orderkey / 100.0) AS BIGINT) * 97) % 30 AS INT), CAST((CAST(floor(o_orderkey / 100.0) AS BIGINT) * 7) % 24 AS INT), CAST((CAST(floor(o_orderkey / 100.0) AS BIGINT) * 13) % 60 AS INT), 0) AS scan_time FROM {orders}""",
    "scan_masks": """SELECT rid, scan, uid, (uid * 17) % 180 + di + 5 AS i, (uid * 29) % 180 + dj + 5 AS j FROM {scan_storms}
 CROSS JOIN range(-2, 3) AS a(di) CROSS JOIN range(-2, 3) AS b(dj) WHERE di * di + dj * dj <= 1 + (uid % 4) OR di = 2 AND dj = uid % 2""",
    "grid_points": """SELECT c_custkey % 25 AS rid, c_custkey AS stn_id, (c_custkey * 37) % 190 AS pi, (c_custkey * 53) % 190 AS pj FROM {customer}""",
    "levels": """SELECT l_orderkey AS profile_id, min(l_partkey) % 3 AS cluster, l_linenumber AS level, CAST(1000 - 90 * l_linenumber AS DOUBLE) AS p,
 CAST(250 * l_linenumber + min(l_partkey) % 50 AS DOUBLE) AS z, CAST(20 - 5 * l_linenumber AS DOUBLE) + max(l_tax) * 50 AS t, CAST(max(l_quantity) AS DOUBLE) AS u,
 CAST(max(l_discount) AS DOUBLE) * 100 AS v FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table where no view has the name; timestamps without zone become plain ones on request of operators only."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    return spark.sql(text, **{t: view(spark, sf_dir, t) for t in set(re.findall(r"{(\w+)}", text))})


def ctes(*names: str, recursive: bool = False) -> str:
    """WITH clause for views, for the checking engine."""
    return "WITH " + "RECURSIVE " * recursive + ", ".join(f"{n} AS ({VIEWS[n].replace('{', '').replace('}', '')})" for n in names)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Double columns rounded, so that the order of sums does not show."""
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])
