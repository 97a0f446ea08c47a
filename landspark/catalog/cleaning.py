"""Cleaning and territorial filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import geometry as g
from ..functions.text import strip_accents
from ..operators import cleaning as cl
from ..plans.layers import clean_layer
from ..sources.files import load_boundary, sanitize_columns
from . import ctes, query
from .spatial import CELL
from .text import derive

# latitude first, with gaps and sentinels
_SWAPPED = """SELECT o_orderkey AS code, cast(-9 AS double) + (o_orderkey*104729)%10000*0.0002 AS a0,
    cast(-41 AS double) + (o_orderkey*7919)%10000*0.0006 AS b0, o_orderkey % 50 AS kind FROM orders"""


@query("cleaned_layer", ctes(t=_SWAPPED) + """
    SELECT code, round(b0, 6) AS minx, round(a0, 6) AS miny, round(b0 + 0.01, 6) AS maxx, round(a0 + 0.02, 6) AS maxy FROM t WHERE kind > 2""")
def cleaned_layer(spark, d):
    t = derive(spark, d, _SWAPPED, "orders")
    box = g.st_box("a0", "b0", F.col("a0") + 0.02, F.col("b0") + 0.01)
    far = g.st_box(F.lit(-1.79e308), F.lit(-1.79e308), F.lit(-1.79e308), F.lit(-1.79e308))
    geom = F.when(F.col("kind") == 0, F.lit(None)).when(F.col("kind") == 1, far).when(
        F.col("kind") == 2, g.st_from_parts(F.lit("polygon"), F.array().cast(g.PARTS_TYPE))).otherwise(box)
    layer = t.select(F.col("code").alias("Código"), geom.alias("geom"))
    out = clean_layer(layer, crs="EPSG:4674")
    r = lambda c: F.round(F.col("geom")[c], 6).alias(c)
    return out.select(F.col("codigo").alias("code"), r("minx"), r("miny"), r("maxx"), r("maxy"))


_STATE_BOX = "SELECT r_regionkey AS rk, -41.0 + r_regionkey AS x0, -9.0 + r_regionkey*0.25 AS y0, -39.5 + r_regionkey AS x1, -8.2 + r_regionkey*0.25 AS y1 FROM (SELECT DISTINCT s_nationkey % 5 AS r_regionkey FROM supplier)"
_FEATURES = """SELECT o_orderkey AS key, CASE o_orderkey % 4 WHEN 0 THEN ' pe' WHEN 1 THEN 'PB' WHEN 2 THEN 'PE ' ELSE NULL END AS uf,
    CASE o_custkey % 3 WHEN 0 THEN 'Pernambuco' WHEN 1 THEN 'BAHIA' ELSE NULL END AS state,
    CASE o_custkey % 5 WHEN 0 THEN concat('PE-', cast(o_custkey AS varchar(9))) ELSE concat('BA-', cast(o_custkey AS varchar(9))) END AS cod,
    cast(-42 AS double) + (o_orderkey*7919)%10000*0.0012 AS x0, cast(-10 AS double) + (o_orderkey*104729)%10000*0.0006 AS y0 FROM orders"""
_INSIDE = "EXISTS (SELECT 1 FROM b WHERE f.x0 <= b.x1 AND b.x0 <= f.x0 + 0.01 AND f.y0 <= b.y1 AND b.y0 <= f.y0 + 0.01)"
_BOXED = "((x0 BETWEEN -41.60 AND -34.70 AND y0 BETWEEN -9.60 AND -7.20) OR (x0 BETWEEN -32.60 AND -32.30 AND y0 BETWEEN -4.00 AND -3.70))"
_FROM = ctes(f=_FEATURES, b=_STATE_BOX)


def _features(spark, d):
    f = derive(spark, d, _FEATURES, "orders").withColumn("geom", g.st_box("x0", "y0", F.col("x0") + 0.01, F.col("y0") + 0.01))
    boxes = derive(spark, d, _STATE_BOX, "supplier").withColumn("geom", g.st_box("x0", "y0", "x1", "y1"))
    return f, load_boundary(boxes, 1.0)


def _filtered(rule, with_boundary=True, **names):
    def run(spark, d):
        f, b = _features(spark, d)
        f = f.withColumnsRenamed(names)
        return cl.filter_territory(f, rule, b if with_boundary else None, "key", 0.5).select("key")
    return run


query("units_in_state", _FROM + f"SELECT key FROM f WHERE {_INSIDE}")(_filtered("units"))
query("notices_in_state", _FROM + f"SELECT key FROM f WHERE {_INSIDE} OR (upper(trim(uf)) = 'PE' AND {_BOXED})")(_filtered("notices"))
query("notices_without_boundary", _FROM + f"SELECT key FROM f WHERE upper(trim(uf)) = 'PE' AND {_BOXED}")(_filtered("notices", False))
query("alerts_in_state", _FROM + f"SELECT key FROM f WHERE state = 'Pernambuco' AND {_INSIDE}")(_filtered("alerts", state="STATE"))
query("registry_alerts_in_state", _FROM + f"SELECT key FROM f WHERE (cod LIKE 'PE-%' OR state = 'Pernambuco') AND {_INSIDE}")(
    _filtered("registry_alerts", state="STATE", cod="CODSICAR"))

_POINTS = """SELECT event_id AS k, CASE event_id % 3 WHEN 0 THEN cast(-9 AS double) + user_id % 100 * 0.01 ELSE cast(-36 AS double) - user_id % 900 * 0.01 END AS lon,
    CASE event_id % 3 WHEN 0 THEN cast(-36 AS double) - user_id % 900 * 0.01 ELSE cast(-9 AS double) + user_id % 100 * 0.01 END AS lat FROM events"""


@query("mended_points", ctes(t=_POINTS) + """
    SELECT k, round(lo, 6) AS lon, round(la, 6) AS lat FROM (SELECT k, least(lon, lat) AS lo, greatest(lon, lat) AS la FROM t)
    WHERE lo BETWEEN -42.5 AND -32.0 AND la BETWEEN -10.5 AND -3.0""")
def mended_points(spark, d):
    t = cl.within_bounds(cl.fix_point_axes(derive(spark, d, _POINTS, "events")), "lon", "lat")
    return t.select("k", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("kept_parts", ctes("parcels") + """
    SELECT code, CASE WHEN code % 2 = 1 THEN 2 WHEN x1 - 5000 >= 0 THEN 2 ELSE 1 END AS parts FROM parcels""")
def kept_parts(spark, d):
    p = fx.parcels(spark, d)
    # two parts, the second far to the east; the rule holds for one of two files and discards what ends before 5000
    parts = F.array(F.array(g.box_ring("x0", "y0", "x1", "y1")),
                    F.array(g.box_ring(F.col("x0") + 20000, "y0", F.col("x1") + 20000, "y1")))
    t = p.select("code", F.concat(F.lit("f"), (F.col("code") % 2).cast("string")).alias("file"),
                 g.st_from_parts(F.lit("multipolygon"), parts).alias("geom"))
    out = cl.as_multipolygon(cl.drop_parts(t, "file", {"f0": 5000.0}))
    return out.select("code", F.size("geom.parts").alias("parts"))


@query("chosen_phases", "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus IN ('F', 'O')")
def chosen_phases(spark, d):
    o = fx.table(spark, d, "orders")
    return cl.filter_category(o, "o_orderstatus", ["F", "O"], ["F", "O", "P"]).select(F.col("o_orderkey").alias("k"))


@query("classified_only", ctes("parcels") + "SELECT code FROM parcels WHERE town IS NOT NULL")
def classified_only(spark, d):
    return cl.require(fx.parcels(spark, d), ["town"]).select("code")


@query("safe_columns", "SELECT doc_id AS id_documento, lang AS lingua, source AS lingua_2, n_chars AS n_chars FROM documents")
def safe_columns(spark, d):
    t = fx.table(spark, d, "documents")
    return sanitize_columns(t.select(F.col("doc_id").alias("ID-Documento"), F.col("lang").alias("Língua"),
                                     F.col("source").alias("lingua!"), F.col("n_chars").alias(" n  chars ")))


@query("accent_free_pages", "SELECT page_id, md5(strip_accents(html)) AS plain FROM pages")
def accent_free_pages(spark, d):
    return fx.table(spark, d, "pages").select("page_id", F.md5(strip_accents("html")).alias("plain"))
