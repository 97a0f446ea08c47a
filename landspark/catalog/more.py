"""Tables as sinks, general polygons, mixed geometry types and the socio-legal side of a crossing."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import constants as K
from .. import fixtures as fx
from ..functions import geometry as g
from ..functions.kml import to_kml
from ..operators import cleaning as cl, crossings
from ..operators.cluster import dbscan
from ..operators.dissolve import dissolve
from ..operators.overlap import overlap_join
from ..operators.polygons import make_valid
from ..plans import regularization as reg, zones
from ..session import materialize, scratch_path
from ..sinks import tables as sinks
from ..sources import files as src
from . import ctes, query
from .cases import SUBJECTS, documents
from .spatial import CELL, MEET, _PROBES, probes, union_area
from .zones import _ZONES, EPS, LABEL, NEAR, PAIRS, REACH, layers


# --- tables ----------------------------------------------------------------------------------

def _name(label: str) -> str:
    return f"{label}_{uuid.uuid4().hex}"


def _keys(spark, d, table: str, key: str):
    return fx.table(spark, d, table).select(F.col(key).alias("k"))


@query("replaced_table", "SELECT s_suppkey AS k FROM supplier")
def replaced_table(spark, d):
    name = _name("replaced")
    sinks.replace_table(_keys(spark, d, "customer", "c_custkey"), name)
    sinks.replace_table(_keys(spark, d, "supplier", "s_suppkey"), name)
    return spark.table(name)


@query("loaded_tables", "SELECT 'kept' AS way, s_suppkey AS k FROM supplier UNION ALL SELECT 'forced', p_partkey FROM part")
def loaded_tables(spark, d):
    out = None
    for way, force in (("kept", False), ("forced", True)):
        name = _name("loaded")
        sinks.load_if_empty(_keys(spark, d, "supplier", "s_suppkey"), name)
        sinks.load_if_empty(_keys(spark, d, "part", "p_partkey"), name, force)
        one = spark.table(name).select(F.lit(way).alias("way"), "k")
        out = one if out is None else out.unionAll(one)
    return out


@query("rebuilt_table", "SELECT p_partkey AS k FROM part")
def rebuilt_table(spark, d):
    name = _name("rebuilt")
    sinks.rebuild(name, _keys(spark, d, "customer", "c_custkey"))
    return sinks.rebuild(name, _keys(spark, d, "part", "p_partkey"))


@query("updated_twice", """
    SELECT p_partkey AS k, coalesce(v, 0) AS v FROM part LEFT JOIN (SELECT l_partkey, arg_max(l_linenumber + 10 * l_orderkey, 10 * l_orderkey + l_linenumber) AS v
      FROM lineitem WHERE l_partkey % 3 = 0 GROUP BY l_partkey) ON l_partkey = p_partkey""")
def updated_twice(spark, d):
    """Several updates of a key: the last in their order counts."""
    order = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    updates = fx.table(spark, d, "lineitem").filter("l_partkey % 3 = 0").select(F.col("l_partkey").alias("k"), order.alias("v"), order.alias("at"))
    return sinks.upsert(fx.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.lit(0).cast("bigint").alias("v")), updates, "k", order=["at"])


# --- selections ------------------------------------------------------------------------------

@query("selected_layers", ctes("territories") + "SELECT tid, source FROM territories WHERE source IN ('embargo', 'federal_unit')")
def selected_layers(spark, d):
    names = {"embargos_icmbio": "embargo", "limiteucsfederais_a": "federal_unit", "tis_poligonais": "indigenous"}
    chosen = [names[n] for n in cl.select_layers(list(names), "icmbio")]
    return fx.territories(spark, d).filter(F.col("source").isin(chosen)).select("tid", "source")


_TARGETS = ", ".join(map(str, K.TARGET_SUBJECTS))


@query("preset_cases", ctes("cases", subj=SUBJECTS) + f"""
    SELECT c.seq FROM cases c WHERE (seq % 3 <> 0 OR EXISTS (SELECT 1 FROM subj s WHERE s.k = c.seq AND s.codigo IN ({_TARGETS})))
      AND (court <> 'TRF5' OR raw_number LIKE '{K.FEDERAL_CASE_PATTERN}')""")
def preset_cases(spark, d):
    docs = documents(spark, d)
    other = F.when(F.col("seq") % 3 == 0, F.col("classe").withField("codigo", F.lit(1))).otherwise(F.col("classe"))
    return src.preset_cases(docs.withColumn("classe", other)).select("seq")


# --- files -----------------------------------------------------------------------------------

_AREA = "(x1-x0)*(y1-y0)"


@query("mixed_geometries", ctes("parcels") + f"""
    SELECT code, CASE code % 4 WHEN 0 THEN 'polygon' WHEN 1 THEN 'multipoint' WHEN 2 THEN 'multipolygon' ELSE 'none' END AS kind,
      CASE code % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END AS parts,
      cast(CASE code % 4 WHEN 0 THEN {_AREA} WHEN 2 THEN 3 * {_AREA} ELSE 0 END AS bigint) AS area FROM parcels""")
def mixed_geometries(spark, d):
    """Points, polygons and collections in one file; of a collection the polygons stay."""
    path = scratch_path(spark, "mixed")
    at = lambda x, y: F.concat(F.lit("["), x.cast("string"), F.lit(","), y.cast("string"), F.lit("]"))
    def ring(by):
        x0, y0, x1, y1 = (F.col(c) + by for c in ("x0", "y0", "x1", "y1"))
        return F.concat(F.lit("["), F.array_join(F.array(at(x0, y0), at(x1, y0), at(x1, y1), at(x0, y1), at(x0, y0)), ","), F.lit("]"))
    made = lambda kind, body: F.concat(F.lit(f'{{"type":"{kind}","coordinates":['), body, F.lit("]}"))
    point = F.concat(F.lit('{"type":"Point","coordinates":'), at(F.col("x0"), F.col("y0")), F.lit("}"))
    several = made("MultiPolygon", F.concat(F.lit("["), ring(100), F.lit("],["), ring(200), F.lit("]")))
    held = lambda *parts: F.concat(F.lit('{"type":"GeometryCollection","geometries":['), F.array_join(F.array(*parts), ","), F.lit("]}"))
    n = F.col("code") % 4
    shape = (F.when(n == 0, made("Polygon", ring(0))).when(n == 1, made("MultiPoint", F.concat(at(F.col("x0"), F.col("y0")), F.lit(","), at(F.col("x1"), F.col("y1")))))
             .when(n == 2, held(point, made("Polygon", ring(0)), several)).otherwise(held(point)))
    fx.parcels(spark, d).select(F.concat(F.lit('{"type":"Feature","properties":{"code":'), F.col("code").cast("string"), F.lit('},"geometry":'), shape, F.lit("}"))).write.text(path)
    got = src.read_geojson(spark, path, "code bigint", lines=True)
    return got.select("code", F.coalesce("geom.gtype", F.lit("none")).alias("kind"), F.greatest(F.coalesce(F.size("geom.parts"), F.lit(0)), F.lit(0)).alias("parts"),
                      F.when(F.col("geom.gtype").contains("polygon"), g.st_area("geom")).otherwise(0).cast("bigint").alias("area"))


@query("skipped_rings", ctes("parcels") + "SELECT cast(code AS varchar) AS name, code % 3 > 0 AS whole FROM parcels")
def skipped_rings(spark, d):
    """Rings of two vertices are skipped, and with an outer ring its polygon."""
    path = scratch_path(spark, "rings")
    p = fx.parcels(spark, d)
    bad = F.lit("<Polygon><outerBoundaryIs><LinearRing><coordinates>1,1 2,2</coordinates></LinearRing></outerBoundaryIs></Polygon>")
    shape = F.when(F.col("code") % 3 == 0, bad).otherwise(to_kml(g.st_box("x0", "y0", "x1", "y1")))
    sinks.write_placemarks(p.select(F.concat(F.lit("<Placemark><name>"), F.col("code").cast("string"), F.lit("</name>"), shape, F.lit("</Placemark>")).alias("value")), path, "Rings")
    return src.read_kml(spark, path).select("name", F.col("geom").isNotNull().alias("whole"))


_SPURIOUS = next(iter(K.SPURIOUS_PARTS))


@query("macro_areas", ctes("parcels") + f"""
    SELECT concat('Gleba ', code % 2) AS nome, count(*) AS areas, cast(sum(CASE WHEN code % 3 = 0 OR code % 2 = 0 THEN 1 ELSE 2 END) AS bigint) AS parts
    FROM parcels GROUP BY code % 2""")
def macro_areas(spark, d):
    """Two source files; in one of them parts far in the west do not belong to their areas."""
    root, marks = scratch_path(spark, "macro"), None
    p = fx.parcels(spark, d)
    east, west = g.st_box(F.lit(-36.0), F.lit(-8.0), F.lit(-35.9), F.lit(-7.9)), g.st_box(F.lit(-40.0), F.lit(-8.0), F.lit(-39.9), F.lit(-7.9))
    both = F.concat(F.lit("<MultiGeometry>"), to_kml(east), to_kml(west), F.lit("</MultiGeometry>"))
    shape = F.when(F.col("code") % 3 == 0, to_kml(east)).otherwise(both)
    rows = p.select("code", F.concat(F.lit("<Placemark><name>x</name>"), shape, F.lit("</Placemark>")).alias("value"))
    for i, file in enumerate((_SPURIOUS, "other.kml")):
        sinks.write_placemarks(rows.filter(F.col("code") % 2 == i).select("value"), f"{root}/{i}", "Glebas")
        one = src.read_kml(spark, f"{root}/{i}").withColumn("file", F.lit(file))
        marks = one if marks is None else marks.unionByName(one)
    files = p.select((F.col("code") % 2).alias("i")).distinct().select(
        F.when(F.col("i") == 0, _SPURIOUS).otherwise("other.kml").alias("file"), F.concat(F.lit("Gleba "), F.col("i").cast("string")).alias("nome"),
        F.lit("Recife").alias("municipio"), F.lit("gleba").alias("tipo"))
    out = reg.macro_areas(marks, files)
    return out.groupBy("nome").agg(F.count(F.lit(1)).alias("areas"), F.sum(F.size("geom.parts")).alias("parts"))


# --- general polygons ------------------------------------------------------------------------

def bent(geom: str = "geom"):
    """A box with a vertex in the middle of each side: the same area, but no rectangle to the library."""
    b = F.col(geom)
    x0, y0, x1, y1 = (b[c] for c in ("minx", "miny", "maxx", "maxy"))
    xm, ym = (x0 + x1) / 2, (y0 + y1) / 2
    ring = [(x0, y0), (xm, y0), (x1, y0), (x1, ym), (x1, y1), (xm, y1), (x0, y1), (x0, ym), (x0, y0)]
    return g.st_rings(F.array(*[g.vertex(x, y) for x, y in ring]))


def _general(df):
    return df.withColumn("geom", bent())


@query("general_zones", _ZONES + """
    SELECT property_name, property_code, property_source, traditional_name, traditional_source, "overlaps", cast(area AS bigint) AS area FROM z JOIN areas USING (zone)""")
def general_zones(spark, d):
    props, terr = layers(spark, d)
    out = zones.conflict_zones(_general(props), _general(terr), CELL, eps=EPS)
    return out.drop("id", "geom", "properties").withColumn("area", F.round("area").cast("bigint"))


@query("general_clusters", ctes("parcels", "territories", pairs=PAIRS, near=NEAR, reach=REACH) + LABEL)
def general_clusters(spark, d):
    p = overlap_join(_general(fx.parcels(spark, d)), _general(fx.territories(spark, d)), CELL, "code", "tid")
    p = p.select((F.col("l_code") * 1000000 + F.col("r_tid")).alias("id"), F.col("r_name").alias("tname"), "geom")
    p = materialize(p, "overlaps")  # clustering reads it several times
    return dbscan(p, ["tname"], EPS).select("id", "cluster")


# the lower left halves of parcels with the whole of territories: what is shared is the half of a smaller box, or more
_HALVES = f"""SELECT p.code, t.tid, greatest(p.x0, t.x0) - p.x0 AS a, least(p.x1, t.x1) - p.x0 AS b, greatest(p.y0, t.y0) - p.y0 AS c, least(p.y1, t.y1) - p.y0 AS e,
    (p.x1 - p.x0) * 1.0 AS w, (p.y1 - p.y0) * 1.0 AS h FROM parcels p JOIN territories t ON {MEET}"""


@query("convex_overlaps", ctes("parcels", "territories", v=_HALVES, r="""
    SELECT code, tid, b - a AS dx, c, e, h, greatest(a, least(b, w * (1 - e / h))) AS full_to, greatest(a, least(b, w * (1 - c / h))) AS cut_to, a, w FROM v""") + """
    SELECT code, tid, round(area + 0.00003, 3) AS area FROM (SELECT code, tid, (full_to - a) * (e - c)
      + (h - c) * (cut_to - full_to) - h / w * (cut_to * cut_to - full_to * full_to) / 2 AS area FROM r) WHERE round(area + 0.00003, 3) > 0.001""")
def convex_overlaps(spark, d):
    """Triangles and boxes, clipped in the JVM."""
    half = g.st_rings(F.array(g.vertex("x0", "y0"), g.vertex("x1", "y0"), g.vertex("x0", "y1"), g.vertex("x0", "y0")))
    p = fx.parcels(spark, d).withColumn("geom", half)
    out = overlap_join(p, _general(fx.territories(spark, d)), CELL, "code", "tid", convex=True)
    return out.select(F.col("l_code").alias("code"), F.col("r_tid").alias("tid"), F.round(F.col("area") + 0.00003, 3).alias("area")).filter("area > 0.001")


@query("dissolved_general", union_area(ctes("territories") + "SELECT name AS k, x0, y0, x1, y1 FROM territories", "k").replace(
    "sum((nx-x)*(ny-y)) AS area", "cast(sum((nx-x)*(ny-y)) AS bigint) AS area").replace("SELECT k, cast", "SELECT k AS name, cast"))
def dissolved_general(spark, d):
    out = dissolve(_general(fx.territories(spark, d).select("name", "geom")), ["name"], CELL)
    return out.select("name", F.round("area").cast("bigint").alias("area"))


@query("merged_strips", """SELECT event_id % 4 AS strip, 1 AS parts, cast((max(event_id // 4) - min(event_id // 4)) * 8 + 10 AS bigint) * 5 AS area
    FROM events GROUP BY event_id % 4""")
def merged_strips(spark, d):
    """Long rows of boxes that overlap their neighbours, over very many cells: one part each, without seams."""
    k = F.floor(F.col("event_id") / 4)
    boxes = fx.table(spark, d, "events").select((F.col("event_id") % 4).alias("strip"), g.st_box(k * 8, F.lit(0), k * 8 + 10, F.lit(5)).alias("geom"))
    out = dissolve(boxes, ["strip"], 4.0, rectangles=True)
    return out.select("strip", F.size("geom.parts").alias("parts"), F.round("area").cast("bigint").alias("area"))


@query("mended_polygons", ctes("parcels") + """
    SELECT code, cast(CASE WHEN code % 3 = 0 THEN 1 ELSE 2 END * (x1-x0)*(y1-y0) AS bigint) AS area, code % 3 = 0 AS mended FROM parcels""")
def mended_polygons(spark, d):
    """Bow ties among rectangles and convex polygons; only the bow ties are not valid."""
    x0, y0, x1, y1 = (F.col(c) * 2 for c in ("x0", "y0", "x1", "y1"))  # even sides: whole areas
    tie = g.st_rings(F.array(*[g.vertex(x, y) for x, y in ((x0, y0), (x1, y1), (x1, y0), (x0, y1), (x0, y0))]))
    p = fx.parcels(spark, d).withColumn("geom", g.st_box(x0, y0, x1, y1))
    p = p.withColumn("geom", F.when(F.col("code") % 3 == 0, tie).when(F.col("code") % 3 == 1, bent()).otherwise(F.col("geom")))
    return make_valid(p.select("code", "geom")).select("code", F.round(g.st_area("geom") / 2).cast("bigint").alias("area"), (F.size("geom.parts") > 1).alias("mended"))


# --- crossings -------------------------------------------------------------------------------

@query("socio_legal", ctes("points", "parcels", q=_PROBES, h=f"""
    SELECT q.key, count(*) FILTER (WHERE pid % 2 = 0) AS notices, count(*) FILTER (WHERE pid % 2 = 1) AS communities
    FROM points p JOIN q ON p.x BETWEEN q.x0 AND q.x1 AND p.y BETWEEN q.y0 AND q.y1 GROUP BY q.key""",
    c="SELECT town, count(*) AS cases FROM parcels WHERE town IS NOT NULL GROUP BY town") + """
    SELECT q.key, coalesce(notices, 0) AS notices, coalesce(communities, 0) AS communities, coalesce(cases, 0) AS cases
    FROM q LEFT JOIN h USING (key) LEFT JOIN c ON c.town = concat('Town ', q.key % 25)""")
def socio_legal(spark, d):
    q = probes(spark, d).select("key", "geom", F.concat(F.lit("Town "), (F.col("key") % 25).cast("string")).alias("town"))
    pts = fx.points(spark, d).select("pid", "geom")
    near = {"notices": pts.filter("pid % 2 = 0"), "communities": pts.filter("pid % 2 = 1")}
    cases = fx.parcels(spark, d).filter("town IS NOT NULL").select("town")
    return crossings.socio_legal(q, near, cases, CELL, seat="town").drop("town")
