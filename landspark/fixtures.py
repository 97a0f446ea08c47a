"""Domain tables derived from the given benchmark tables by integer arithmetic.

Little more than ``%``, ``+`` and ``*`` is used, so that another engine computes the same rows from
:data:`SQL`. Geometry is added on the Spark side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.geometry import st_box, st_point
from .session import shares

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]



def sized(table: str, usual: int) -> str:
    """The table with ``m``, the side of the map: 10,000 at the usual row count, growing with the square
    root of the rows, so that features are as dense at every size."""
    return f"(SELECT *, (SELECT cast(floor(10000*sqrt(count(*)/{usual}.0)) AS bigint) FROM {table}) AS m FROM {table})"


_ORDERS, _SUPPLIER, _EVENTS = sized("orders", 15000), sized("supplier", 100), sized("events", 10000)

SQL = {
    "parcels": f"""
        SELECT o_orderkey AS code, concat('Farm ', cast(o_custkey AS varchar(20))) AS name,
          CASE o_orderkey % 3 WHEN 0 THEN 'certified' WHEN 1 THEN 'legacy' ELSE 'registry' END AS source,
          CASE WHEN o_custkey % 11 = 0 THEN NULL
               ELSE concat('Town ', cast(o_custkey % 25 AS varchar(5))) END AS town,
          (o_orderkey*7919)%m AS x0, (o_orderkey*104729)%(m-9) AS y0,
          (o_orderkey*7919)%m+5+o_custkey%40 AS x1,
          (o_orderkey*104729)%(m-9)+5+o_orderkey%37 AS y1
        FROM {_ORDERS}""",
    "territories": f"""
        SELECT s_suppkey AS tid, concat('Land ', cast(s_nationkey AS varchar(5))) AS name,
          CASE s_suppkey % 4 WHEN 0 THEN 'indigenous' WHEN 1 THEN 'quilombola'
                             WHEN 2 THEN 'federal_unit' ELSE 'embargo' END AS source,
          (s_suppkey*6151)%(m-1000) AS x0, (s_suppkey*3571)%(m-1000) AS y0,
          (s_suppkey*6151)%(m-1000)+200+s_nationkey*10 AS x1,
          (s_suppkey*3571)%(m-1000)+150+s_nationkey*7 AS y1
        FROM {_SUPPLIER}""",
    "points": f"""
        SELECT event_id AS pid, user_id, event_type,
          (event_id*7907)%m AS x, (event_id*10007+user_id*13)%m AS y
        FROM {_EVENTS}""",
    "cases": """
        SELECT o_orderkey AS seq,
          CASE WHEN o_orderkey % 10 = 9 THEN o_orderkey - 1 ELSE o_orderkey END AS id,
          CASE o_orderkey % 2 WHEN 0 THEN 'TJPE' ELSE 'TRF5' END AS court,
          concat(lpad(cast(o_orderkey % 10000000 AS varchar(10)),7,'0'),'42',
                 cast(year(o_orderdate) AS varchar(4)),'817',
                 lpad(cast(8299 + o_custkey % 19 AS varchar(5)),4,'0')) AS raw_number,
          CASE o_custkey % 5 WHEN 0 THEN 1707 WHEN 1 THEN 49 WHEN 2 THEN 91
                             WHEN 3 THEN 34 ELSE 65 END AS class_code,
          CASE WHEN o_custkey % 7 = 0 THEN NULL
               ELSE cast(2600000 + (o_custkey % 25) * 100 AS int) END AS muni_code,
          concat(cast(1 + o_custkey % 38 AS varchar(3)),
                 CASE WHEN o_custkey % 3 = 0 THEN 'ª Vara' ELSE ' Office' END) AS chamber
        FROM orders""",
    "gazetteer": """
        SELECT cast(2600000 + n*100 AS int) AS code, concat('São Nação-', cast(n AS varchar(9))) AS name,
          cast(2600000 + n%5*100 AS int) AS seat_code, cast(-41 + n%40*0.25 AS double) AS lon,
          cast(-9 + n%40*0.05 AS double) AS lat
        FROM (SELECT s_suppkey AS n FROM supplier)""",
    "versions": """
        SELECT o_custkey AS code, o_orderkey AS version,
          row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ord,
          100 + o_orderkey % 977 AS area
        FROM orders""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _derive(spark: SparkSession, sf_dir: str, name: str, *tables: str) -> DataFrame:
    return spark.sql(SQL[name].replace(f"FROM {tables[0]}", f"FROM {{{tables[0]}}}"),
                     **{t: table(spark, sf_dir, t) for t in tables})


def parcels(spark, sf_dir) -> DataFrame:
    """Dealt out before anything is worked out of a row: a table in few row groups would keep few cores busy."""
    rows = _derive(spark, sf_dir, "parcels", "orders").repartition(shares(spark), "code")
    return rows.withColumn("geom", st_box("x0", "y0", "x1", "y1"))


def territories(spark, sf_dir) -> DataFrame:
    return _derive(spark, sf_dir, "territories", "supplier").withColumn(
        "geom", st_box("x0", "y0", "x1", "y1"))


def points(spark, sf_dir) -> DataFrame:
    return _derive(spark, sf_dir, "points", "events").withColumn("geom", st_point("x", "y"))


def cases(spark, sf_dir) -> DataFrame:
    return _derive(spark, sf_dir, "cases", "orders")


def gazetteer(spark, sf_dir) -> DataFrame:
    return _derive(spark, sf_dir, "gazetteer", "supplier")


def versions(spark, sf_dir) -> DataFrame:
    return _derive(spark, sf_dir, "versions", "orders")
