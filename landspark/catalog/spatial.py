"""Geometry functions and spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import geometry as g
from ..operators import cleaning, crossings, overlap
from ..operators.dissolve import dissolve
from ..operators.polygons import make_valid, with_intersection
from ..sources.files import load_boundary
from . import ctes, query

CELL = 256.0

MEET = "p.x0 < t.x1 AND t.x0 < p.x1 AND p.y0 < t.y1 AND t.y0 < p.y1"
SHARED = ("(least(p.x1,t.x1)-greatest(p.x0,t.x0))*(least(p.y1,t.y1)-greatest(p.y0,t.y0))")


def shared(a: str, b: str) -> str:
    """Area shared by two boxes given as (x0, y0, x1, y1) expressions."""
    ax0, ay0, ax1, ay1 = a.split(",")
    bx0, by0, bx1, by1 = b.split(",")
    return (f"greatest(0, least({ax1},{bx1})-greatest({ax0},{bx0}))"
            f"*greatest(0, least({ay1},{by1})-greatest({ay0},{by0}))")


def frame(df, margin):
    """Boxes with a rectangular hole ``margin`` inside the border."""
    m = margin
    return df.withColumn("geom", g.st_rings(
        g.box_ring("x0", "y0", "x1", "y1"),
        g.box_ring(F.col("x0") + m, F.col("y0") + m, F.col("x1") - m, F.col("y1") - m)))


def union_area(boxes: str, by: str) -> str:
    """Area of the union of boxes per group, by cutting the plane at all box sides."""
    return f"""
      WITH b AS ({boxes}),
      xs AS (SELECT {by}, x, lead(x) OVER (PARTITION BY {by} ORDER BY x) AS nx
             FROM (SELECT {by}, x0 AS x FROM b UNION SELECT {by}, x1 FROM b)),
      ys AS (SELECT {by}, y, lead(y) OVER (PARTITION BY {by} ORDER BY y) AS ny
             FROM (SELECT {by}, y0 AS y FROM b UNION SELECT {by}, y1 FROM b)),
      f AS (SELECT DISTINCT {by}, x, nx, y, ny FROM b JOIN xs USING ({by}) JOIN ys USING ({by})
            WHERE x0 <= x AND nx <= x1 AND y0 <= y AND ny <= y1)
      SELECT {by}, sum((nx-x)*(ny-y)) AS area FROM f GROUP BY {by}"""


@query("overlap_pairs", ctes("parcels", "territories") + f"""
    SELECT p.code, t.tid, cast({SHARED} AS bigint) AS area FROM parcels p JOIN territories t ON {MEET}""")
def overlap_pairs(spark, d):
    pairs = overlap.overlap_join(fx.parcels(spark, d), fx.territories(spark, d), CELL, "code", "tid",
                                 rectangles=True)
    return pairs.select(F.col("l_code").alias("code"), F.col("r_tid").alias("tid"),
                        F.col("area").cast("bigint").alias("area"))


_P_HOLE, _T_HOLE = "p.x0+2,p.y0+2,p.x1-2,p.y1-2", "t.x0+40,t.y0+40,t.x1-40,t.y1-40"
_P_BOX, _T_BOX = "p.x0,p.y0,p.x1,p.y1", "t.x0,t.y0,t.x1,t.y1"
_FRAMES = (f"{shared(_P_BOX, _T_BOX)} - {shared(_P_HOLE, _T_BOX)} - {shared(_P_BOX, _T_HOLE)}"
           f" + {shared(_P_HOLE, _T_HOLE)}")


@query("overlap_polygons_with_holes", ctes("parcels", "territories") + f"""
    SELECT p.code, t.tid, cast({_FRAMES} AS bigint) AS area FROM parcels p JOIN territories t ON {MEET}
    WHERE {_FRAMES} > 0""")
def overlap_polygons_with_holes(spark, d):
    pairs = overlap.overlap_join(frame(fx.parcels(spark, d), 2), frame(fx.territories(spark, d), 40), CELL,
                                 "code", "tid")
    return pairs.select(F.col("l_code").alias("code"), F.col("r_tid").alias("tid"),
                        F.round("area").cast("bigint").alias("area"))


def comb(df, teeth=6):
    """Boxes with slits cut in from above: 4 vertices more per slit, each slit 2 wide and 60 deep."""
    top, foot = [], []
    for i in range(teeth, 0, -1):
        x = F.col("x0") + 20 * i
        top += [g.vertex(x + 2, "y1"), g.vertex(x + 2, F.col("y1") - 60), g.vertex(x, F.col("y1") - 60), g.vertex(x, "y1")]
    foot = [g.vertex("x0", "y0"), g.vertex("x1", "y0"), g.vertex("x1", "y1")]
    ring = F.array(*foot, *top, g.vertex("x0", "y1"), g.vertex("x0", "y0"))
    return df.withColumn("geom", g.st_rings(ring))


_TEETH = " - ".join([shared(_P_BOX, _T_BOX)] + [
    shared(_P_BOX, f"t.x0+{20*i},t.y1-60,t.x0+{20*i}+2,t.y1") for i in range(1, 7)])


@query("overlap_subdivided", ctes("parcels", "territories") + f"""
    SELECT p.code, t.tid, cast({_TEETH} AS bigint) AS area FROM parcels p JOIN territories t ON {MEET}
    WHERE {_TEETH} > 0""")
def overlap_subdivided(spark, d):
    pairs = overlap.overlap_join(fx.parcels(spark, d), comb(fx.territories(spark, d)), CELL, "code", "tid",
                                 max_vertices=16)
    return pairs.select(F.col("l_code").alias("code"), F.col("r_tid").alias("tid"),
                        F.round(g.st_area("geom")).cast("bigint").alias("area"))


@query("points_in_territories", ctes("points", "territories") + """
    SELECT t.tid, count(*) AS points FROM points p JOIN territories t
      ON p.x > t.x0 AND p.x < t.x1 AND p.y > t.y0 AND p.y < t.y1 GROUP BY t.tid""")
def points_in_territories(spark, d):
    hits = overlap.point_in_polygon_join(fx.points(spark, d), fx.territories(spark, d), CELL)
    return hits.groupBy(F.col("r_tid").alias("tid")).agg(F.count(F.lit(1)).alias("points"))


@query("points_in_frames", ctes("points", "territories") + """
    SELECT p.pid, t.tid FROM points p JOIN territories t
      ON p.x > t.x0 AND p.x < t.x1 AND p.y > t.y0 AND p.y < t.y1
     AND NOT (p.x >= t.x0+40 AND p.x <= t.x1-40 AND p.y >= t.y0+40 AND p.y <= t.y1-40)""")
def points_in_frames(spark, d):
    hits = overlap.point_in_polygon_join(fx.points(spark, d), frame(fx.territories(spark, d), 40), CELL)
    return hits.select(F.col("l_pid").alias("pid"), F.col("r_tid").alias("tid"))


# boundary: the union of one box per region, overlapping their neighbours
BOUNDARY = """SELECT r_regionkey AS rk, 1500 + r_regionkey*900 AS x0, 2000 + (r_regionkey*1700)%4000 AS y0,
    3000 + r_regionkey*900 AS x1, 5500 + (r_regionkey*1700)%4000 AS y1
    FROM (SELECT DISTINCT s_nationkey % 7 AS r_regionkey FROM supplier)"""
TOUCHES = "p.x0 <= b.x1 AND b.x0 <= p.x1 AND p.y0 <= b.y1 AND b.y0 <= p.y1"


def boundary(spark, d):
    boxes = spark.sql(BOUNDARY.replace("FROM supplier", "FROM {supplier}"), supplier=fx.table(spark, d, "supplier"))
    return load_boundary(boxes.withColumn("geom", g.st_box("x0", "y0", "x1", "y1")), 1024.0)


@query("boundary_union", union_area(f"SELECT 1 AS one, * FROM ({BOUNDARY})", "one").replace(
    "SELECT one, sum((nx-x)*(ny-y)) AS area FROM f GROUP BY one",
    "SELECT cast(sum((nx-x)*(ny-y)) AS bigint) AS area FROM f"))
def boundary_union(spark, d):
    return boundary(spark, d).select(F.round(g.st_area("geom")).cast("bigint").alias("area"))


@query("parcels_in_boundary", ctes("parcels", b=BOUNDARY) + f"""
    SELECT p.code FROM parcels p WHERE EXISTS (SELECT 1 FROM b WHERE {TOUCHES})""")
def parcels_in_boundary(spark, d):
    return overlap.intersects_boundary(fx.parcels(spark, d), boundary(spark, d), "code", CELL).select("code")


@query("points_in_boundary", ctes("points", b=BOUNDARY) + """
    SELECT p.pid FROM points p WHERE EXISTS (SELECT 1 FROM b
      WHERE p.x BETWEEN b.x0 AND b.x1 AND p.y BETWEEN b.y0 AND b.y1)""")
def points_in_boundary(spark, d):
    return overlap.intersects_boundary(fx.points(spark, d), boundary(spark, d), "pid", CELL).select("pid")


@query("geometry_measures", ctes("parcels") + """
    SELECT code, cast((x1-x0)*(y1-y0) AS bigint) AS area, cast(2*((x1-x0)+(y1-y0)) AS bigint) AS perimeter,
      cast(x0 AS bigint) AS minx, cast(y1 AS bigint) AS maxy, 2 AS dimension, false AS is_empty,
      concat('POLYGON ((', x0, ' ', y0, ', ', x1, ' ', y0, ', ', x1, ' ', y1, ', ', x0, ' ', y1, ', ',
             x0, ' ', y0, '))') AS wkt,
      concat('POLYGON ((', y0, ' ', x0, ', ', y0, ' ', x1, ', ', y1, ' ', x1, ', ', y1, ' ', x0, ', ',
             y0, ' ', x0, '))') AS swapped
    FROM parcels""")
def geometry_measures(spark, d):
    return fx.parcels(spark, d).select(
        "code", g.st_area("geom").cast("bigint").alias("area"), g.st_perimeter("geom").cast("bigint").alias("perimeter"),
        g.st_bounds("geom")["minx"].cast("bigint").alias("minx"), g.st_bounds("geom")["maxy"].cast("bigint").alias("maxy"),
        g.st_dimension("geom").alias("dimension"), g.st_is_empty("geom").alias("is_empty"),
        g.st_as_text("geom").alias("wkt"), g.st_as_text(g.st_swap_xy("geom")).alias("swapped"))


@query("geometry_from_text", ctes("parcels") + """
    SELECT code, cast(4*((x1-x0)*(y1-y0)) - 4 AS bigint) AS area, cast(x0 AS bigint) AS minx FROM parcels""")
def geometry_from_text(spark, d):
    # a multipolygon with heights: a box with a hole of 4 and, far off, three more boxes
    t = fx.parcels(spark, d)
    ring = lambda dx: F.concat_ws(", ", *[F.concat_ws(" ", (F.col(a) + dx).cast("string"), F.col(b).cast("string"), F.lit("7"))
                                          for a, b in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))])
    hole = F.expr("concat_ws(', ', concat(x0+1,' ',y0+1), concat(x0+3,' ',y0+1), concat(x0+3,' ',y0+3), "
                  "concat(x0+1,' ',y0+3), concat(x0+1,' ',y0+1))")
    text = F.concat(F.lit("MULTIPOLYGON ((("), ring(0), F.lit("), ("), hole, F.lit(")), (("), ring(20000), F.lit(")), (("),
                    ring(40000), F.lit(")), (("), ring(60000), F.lit(")))"))
    made = t.select("code", g.st_from_text(text).alias("g"))
    return made.select("code", g.st_area("g").cast("bigint").alias("area"), F.col("g.minx").cast("bigint").alias("minx"))


@query("box_centres", ctes("parcels") + """
    SELECT code, (x0+x1)/2.0 AS x, (y0+y1)/2.0 AS y FROM parcels""")
def box_centres(spark, d):
    p = fx.parcels(spark, d).select("code", g.st_point_on_surface("geom").alias("p"))
    return p.select("code", "p.x", "p.y")


@query("surface_points_of_frames", "SELECT count(*) AS shapes, count(*) AS inside FROM orders")
def surface_points_of_frames(spark, d):
    p = frame(fx.parcels(spark, d), 1).withColumn("p", g.st_point_on_surface("geom"))
    return p.agg(F.count(F.lit(1)).alias("shapes"),
                 F.count_if(g.st_contains("geom", F.col("p")["x"], F.col("p")["y"])).alias("inside"))


@query("repaired_bow_ties", ctes("parcels") + """
    SELECT code, round((x1-x0)*(y1-y0)/2.0, 4) AS area, 2 AS parts FROM parcels""")
def repaired_bow_ties(spark, d):
    ring = F.array(g.vertex("x0", "y0"), g.vertex("x1", "y1"), g.vertex("x1", "y0"), g.vertex("x0", "y1"),
                   g.vertex("x0", "y0"))
    ties = fx.parcels(spark, d).withColumn("geom", g.st_rings(ring))
    return make_valid(ties).select("code", F.round(g.st_area("geom"), 4).alias("area"),
                                   F.size("geom.parts").alias("parts"))


@query("intersection_shapes", ctes("parcels", "territories") + f"""
    SELECT p.code, t.tid, cast({SHARED} AS bigint) AS area, cast(greatest(p.x0,t.x0) AS bigint) AS minx,
      cast(least(p.y1,t.y1) AS bigint) AS maxy FROM parcels p JOIN territories t ON {MEET}""")
def intersection_shapes(spark, d):
    # the numpy kernel on rectangles, whose result is known exactly
    pairs = overlap.overlap_join(fx.parcels(spark, d), fx.territories(spark, d), CELL, "code", "tid", rectangles=True)
    cut = with_intersection(pairs.select("l_code", "r_tid", "l_geom", "r_geom"), "cut", "l_geom", "r_geom")
    return cut.select(F.col("l_code").alias("code"), F.col("r_tid").alias("tid"),
                      F.round(g.st_area("cut")).cast("bigint").alias("area"), F.col("cut.minx").cast("bigint").alias("minx"),
                      F.col("cut.maxy").cast("bigint").alias("maxy"))


_Q = ("(1-0.0066943799901413165)*(sin(radians({0}))/(1-0.0066943799901413165*sin(radians({0}))*sin(radians({0})))"
      "-ln((1-0.08181919084262149*sin(radians({0})))/(1+0.08181919084262149*sin(radians({0}))))/(2*0.08181919084262149))")
_GEO = """SELECT o_orderkey AS code, -41 + (o_orderkey*7919)%10000*0.0006 AS lon0, -9 + (o_orderkey*104729)%10000*0.0002 AS lat0,
    -41 + (o_orderkey*7919)%10000*0.0006 + 0.01 + o_custkey%40*0.001 AS lon1,
    -9 + (o_orderkey*104729)%10000*0.0002 + 0.01 + o_orderkey%37*0.001 AS lat1 FROM orders"""
_GEO = _GEO.replace("-41 +", "cast(-41 AS double) +").replace("-9 +", "cast(-9 AS double) +")


@query("geodesic_hectares", ctes(b=_GEO) + f"""
    SELECT code, round(cast(6371007.1809 AS double)*6371007.1809*radians(lon1-lon0)*abs({_Q.format('lat1')}-{_Q.format('lat0')})
      /({_Q.format('90')})/10000.0, 1) AS hectares FROM b""")
def geodesic_hectares(spark, d):
    boxes = spark.sql(_GEO.replace("FROM orders", "FROM {orders}"), orders=fx.table(spark, d, "orders"))
    return boxes.select("code", F.round(g.st_geodesic_area(g.st_box("lon0", "lat0", "lon1", "lat1")) / 10000.0, 1)
                        .alias("hectares"))


@query("layer_bounds", ctes("parcels") + """
    SELECT cast(min(x0) AS double) AS minx, cast(min(y0) AS double) AS miny, cast(max(x1) AS double) AS maxx,
      cast(max(y1) AS double) AS maxy FROM parcels""")
def layer_bounds(spark, d):
    return cleaning.layer_bounds(fx.parcels(spark, d))


@query("dissolved_territories", union_area(
    f"SELECT concat(name, '|', source) AS k, x0, y0, x1, y1 FROM ({fx.SQL['territories']})", "k").replace(
    "SELECT k, sum((nx-x)*(ny-y)) AS area", "SELECT k, cast(sum((nx-x)*(ny-y)) AS bigint) AS area"))
def dissolved_territories(spark, d):
    t = fx.territories(spark, d).withColumn("k", F.concat_ws("|", "name", "source"))
    out = dissolve(t, ["k"], 512.0)
    return out.select("k", F.round(g.st_area("geom")).cast("bigint").alias("area"))


def _layers(spark, d):
    p = fx.parcels(spark, d).select(F.col("code").alias("key"), "source", "name", "geom")
    t = fx.territories(spark, d).select(F.col("tid").alias("key"), "source", "name", "geom")
    pick = lambda df, s: df.filter(F.col("source") == s).drop("source")
    return {"area_imovel_1": pick(p, "registry"), "sigef_privado_pe": pick(p, "certified"),
            "tis_poligonais": pick(t, "indigenous"), "areas_de_quilombolas_pe": pick(t, "quilombola")}


LAYERS = """SELECT 'area_imovel_1' AS layer, 25 AS prio, code AS key, name, x0, y0, x1, y1 FROM parcels WHERE source = 'registry'
    UNION ALL SELECT 'sigef_privado_pe', 21, code, name, x0, y0, x1, y1 FROM parcels WHERE source = 'certified'
    UNION ALL SELECT 'tis_poligonais', 17, tid, name, x0, y0, x1, y1 FROM territories WHERE source = 'indigenous'
    UNION ALL SELECT 'areas_de_quilombolas_pe', 18, tid, name, x0, y0, x1, y1 FROM territories WHERE source = 'quilombola'"""


@query("probe_points", ctes("points", "parcels", "territories", f=LAYERS, h="""
    SELECT p.pid, f.* FROM points p JOIN f ON p.x BETWEEN f.x0 AND f.x1 AND p.y BETWEEN f.y0 AND f.y1""") + """
    SELECT pid, arg_min(layer, cast(prio AS bigint)*1000000000 + key) AS layer, arg_min(key, cast(prio AS bigint)*1000000000 + key) AS feature, count(*) AS hits,
      coalesce(CASE WHEN arg_min(layer, cast(prio AS bigint)*1000000000 + key) = 'area_imovel_1'
           THEN min(CASE WHEN layer = 'sigef_privado_pe' THEN key END) END, -1) AS parcel
    FROM h GROUP BY pid""")
def probe_points(spark, d):
    out = crossings.probe_points(fx.points(spark, d), _layers(spark, d), CELL)
    return out.withColumn("parcel", F.coalesce("parcel", F.lit(-1).cast("bigint")))


_FIRST = ["area_imovel_1", "sigef_privado_pe", "tis_poligonais", "areas_de_quilombolas_pe"]
_REORDERED = LAYERS.replace("25 AS prio", "0 AS prio").replace("', 21,", "', 1,").replace("', 17,", "', 2,").replace("', 18,", "', 3,")


@query("points_top_layer_first", ctes("points", "parcels", "territories", f=_REORDERED, h="""
    SELECT p.pid, f.*, cast(prio AS bigint)*1000000000 + key AS place FROM points p JOIN f ON p.x BETWEEN f.x0 AND f.x1 AND p.y BETWEEN f.y0 AND f.y1""") + """
    SELECT pid, arg_min(layer, place) AS layer, arg_min(key, place) AS feature,
      coalesce(CASE WHEN arg_min(layer, place) = 'area_imovel_1' THEN min(CASE WHEN layer = 'sigef_privado_pe' THEN key END) END, -1) AS parcel
    FROM h GROUP BY pid""")
def points_top_layer_first(spark, d):
    out = crossings.probe_points(fx.points(spark, d), _layers(spark, d), CELL, priority=_FIRST)
    return out.select("pid", "layer", "feature", F.coalesce("parcel", F.lit(-1).cast("bigint")).alias("parcel"))


_PART = fx.sized("part", 2000)
_PROBES = f"""SELECT p_partkey AS key, (p_partkey*4099)%(m-1000) AS x0, (p_partkey*2711)%(m-1000) AS y0,
    (p_partkey*4099)%(m-1000)+60+p_size AS x1, (p_partkey*2711)%(m-1000)+50+p_size AS y1 FROM {_PART}"""


def probes(spark, d):
    t = spark.sql(_PROBES.replace("FROM part", "FROM {part}"), part=fx.table(spark, d, "part"))
    return t.withColumn("geom", g.st_box("x0", "y0", "x1", "y1"))


@query("crossed_layers", ctes("parcels", "territories", q=_PROBES, f=LAYERS) + f"""
    SELECT p.key, t.layer, count(*) AS features, cast(sum({SHARED}) AS bigint) AS area
    FROM q p JOIN f t ON {MEET} GROUP BY p.key, t.layer""")
def crossed_layers(spark, d):
    out = crossings.cross_layers(probes(spark, d).select("key", "geom"), _layers(spark, d), CELL, rectangles=True)
    return out.withColumn("area", F.col("area").cast("bigint"))


@query("points_on_probes", ctes("points", q=_PROBES) + """
    SELECT q.key, count(*) AS points FROM points p JOIN q ON p.x BETWEEN q.x0 AND q.x1 AND p.y BETWEEN q.y0 AND q.y1
    GROUP BY q.key""")
def points_on_probes(spark, d):
    return crossings.count_points_in(probes(spark, d).select("key", "geom"), fx.points(spark, d), CELL)


_CUT = ctes("parcels", "territories") + f"""SELECT t.tid AS k, greatest(p.x0,t.x0) AS x0, greatest(p.y0,t.y0) AS y0,
    least(p.x1,t.x1) AS x1, least(p.y1,t.y1) AS y1 FROM parcels p JOIN territories t ON {MEET}"""


@query("covered_share", f"""WITH u AS ({union_area(_CUT, 'k')}), t AS ({fx.SQL['territories']})
    SELECT t.tid AS key, cast((x1-x0)*(y1-y0) AS bigint) AS area, cast(coalesce(u.area, 0) AS bigint) AS covered,
      round(coalesce(u.area, 0) * 100.0 / ((x1-x0)*(y1-y0)), 4) AS share
    FROM t LEFT JOIN u ON u.k = t.tid""")
def covered_share(spark, d):
    t = fx.territories(spark, d).select(F.col("tid").alias("key"), "geom")
    p = fx.parcels(spark, d).select(F.col("code").alias("key"), "geom")
    out = crossings.overlap_share(t, p, CELL, rectangles=True)
    return out.select("key", F.col("area").cast("bigint"), F.col("covered").cast("bigint"), F.round("share", 4).alias("share"))


_ALERTS = f"""SELECT p_partkey AS key, (p_partkey*3613)%(m-100) AS x0, (p_partkey*5281)%(m-100) AS y0,
    (p_partkey*3613)%(m-100)+10+p_size AS x1, (p_partkey*5281)%(m-100)+12+p_size AS y1, p_size*7 AS alert_area,
    concat('Town ', cast(p_partkey % 25 AS varchar(5))) AS town, p_type AS kind FROM {_PART}"""


def alerts(spark, d):
    t = spark.sql(_ALERTS.replace("FROM part", "FROM {part}"), part=fx.table(spark, d, "part"))
    return t.withColumn("geom", g.st_box("x0", "y0", "x1", "y1"))


@query("alert_crossings", ctes("parcels", "territories", a=_ALERTS, f=LAYERS, o=f"""
    SELECT DISTINCT t.layer, t.name, p.key, p.alert_area FROM a p JOIN f t ON {MEET}""") + """
    SELECT layer, name, count(*) AS alerts, cast(sum(alert_area) AS bigint) AS area FROM o GROUP BY layer, name""")
def alert_crossings(spark, d):
    out = crossings.alert_crossings(alerts(spark, d).select("key", "alert_area", "geom"), _layers(spark, d), CELL,
                                    rectangles=True)
    return out.withColumn("area", F.col("area").cast("bigint"))


@query("alerts_and_cases", ctes("parcels", a=_ALERTS) + """
    SELECT coalesce(x.town, y.town) AS town, coalesce(alerts, 0) AS alerts, coalesce(cases, 0) AS cases
    FROM (SELECT town, count(*) AS alerts FROM a GROUP BY town) x
    FULL JOIN (SELECT town, count(*) AS cases FROM parcels WHERE town IS NOT NULL GROUP BY town) y ON x.town = y.town""")
def alerts_and_cases(spark, d):
    cases = fx.parcels(spark, d).filter(F.col("town").isNotNull())
    return crossings.alerts_and_cases(alerts(spark, d), cases, "town")
