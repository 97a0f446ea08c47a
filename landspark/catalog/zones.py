"""Clustering and conflict zones."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import geometry as g
from ..functions.text import compose_label
from ..operators.cluster import dbscan
from ..operators.overlap import overlap_join
from ..operators.components import connected_components
from ..plans import zones
from ..session import materialize
from . import ctes, query
from .spatial import CELL, MEET, SHARED

EPS = 10
PAIRS = f"""SELECT p.code*1000000+t.tid AS id, p.code, t.tid, t.name AS tname, greatest(p.x0,t.x0) AS x0,
    greatest(p.y0,t.y0) AS y0, least(p.x1,t.x1) AS x1, least(p.y1,t.y1) AS y1
    FROM parcels p JOIN territories t ON {MEET}"""
NEAR = """SELECT a.id AS a, b.id AS b FROM pairs a JOIN pairs b ON a.tname = b.tname
    AND pow(greatest(0, a.x0-b.x1, b.x0-a.x1), 2) + pow(greatest(0, a.y0-b.y1, b.y0-a.y1), 2) <= 100"""
# least id reachable, by repeated closure from every member
REACH = "SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a"
LABEL = "SELECT a AS id, min(b) AS cluster FROM reach GROUP BY a"


def pairs(spark, d):
    p = overlap_join(fx.parcels(spark, d), fx.territories(spark, d), CELL, "code", "tid", rectangles=True)
    p = p.select((F.col("l_code") * 1000000 + F.col("r_tid")).alias("id"), F.col("r_name").alias("tname"), "geom")
    return materialize(p, "overlaps")  # clustering reads it several times


@query("overlap_clusters", ctes("parcels", "territories", pairs=PAIRS, near=NEAR, reach=REACH) + LABEL)
def overlap_clusters(spark, d):
    return dbscan(pairs(spark, d), ["tname"], EPS, rectangles=True).select("id", "cluster")


@query("overlap_clusters_min_points", ctes(
    "parcels", "territories", pairs=PAIRS, near=NEAR,
    core="SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 3",
    cn="SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)",
    reach="SELECT a, b FROM cn UNION SELECT r.a, n.b FROM reach r JOIN cn n ON r.b = n.a",
    lab=LABEL) + """
    SELECT p.id, coalesce(l.cluster, (SELECT min(l2.cluster) FROM near n JOIN lab l2 ON l2.id = n.b WHERE n.a = p.id), -1)
      AS cluster FROM pairs p LEFT JOIN lab l ON l.id = p.id""")
def overlap_clusters_min_points(spark, d):
    out = dbscan(pairs(spark, d), ["tname"], EPS, min_points=3, rectangles=True)
    return out.select("id", F.coalesce("cluster", F.lit(-1).cast("bigint")).alias("cluster"))


@query("linked_orders", ctes(
    e="SELECT DISTINCT l_orderkey AS a, l_orderkey - l_orderkey % 8 + l_linenumber % 8 AS b FROM lineitem",
    near="SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT a, a FROM e UNION SELECT b, b FROM e",
    reach=REACH) + "SELECT a AS id, min(b) AS label FROM reach GROUP BY a HAVING min(b) < a")
def linked_orders(spark, d):
    e = fx.table(spark, d, "lineitem").selectExpr("l_orderkey AS src", "l_orderkey - l_orderkey % 8 + l_linenumber % 8 AS dst")
    return connected_components(e)


def layers(spark, d):
    """Property and territory layers under the names the zone rules know."""
    p = fx.parcels(spark, d)
    pick = lambda df, s: df.filter(F.col("source") == s)
    props = (zones.property_layer(pick(p, "certified"), "sigef_brasil_pe", "name", "code")
             .unionByName(zones.property_layer(pick(p, "legacy"), "imovel_certificado_snci_brasil_pe", "name", "code"))
             .unionByName(zones.registry_layer(pick(p, "registry"), town="town", code="code")))
    t = fx.territories(spark, d)
    names = {"indigenous": "tis_poligonais", "quilombola": "areas_de_quilombolas_pe", "federal_unit": "limiteucsfederais_a"}
    terr = zones.territory_layer(pick(t, "embargo"), "embargos_icmbio", compose_label(
        "Embargo {} ({})", F.coalesce((F.col("tid") % 20).cast("string"), F.lit("S/N")), "name", max_len=200), "tid")
    for kind, source in names.items():
        terr = terr.unionByName(zones.territory_layer(pick(t, kind), source, "name", "tid"))
    return props, terr


_ZPAIRS = f"""SELECT p.code*1000000+t.tid AS id, trim(CASE WHEN p.source = 'registry'
      THEN concat('Imóvel CAR (', coalesce(p.town, 'PE'), ')') ELSE p.name END) AS pname, cast(p.code AS varchar(20)) AS pcode,
    CASE p.source WHEN 'certified' THEN 'sigef_brasil_pe' WHEN 'legacy' THEN 'imovel_certificado_snci_brasil_pe'
      ELSE 'area_imovel_1' END AS psource,
    CASE WHEN t.source = 'embargo' THEN concat('Embargo ', cast(t.tid % 20 AS varchar(5)), ' (', t.name, ')') ELSE t.name END AS tname,
    CASE t.source WHEN 'indigenous' THEN 'tis_poligonais' WHEN 'quilombola' THEN 'areas_de_quilombolas_pe'
      WHEN 'federal_unit' THEN 'limiteucsfederais_a' ELSE 'embargos_icmbio' END AS tsource,
    greatest(p.x0,t.x0) AS x0, greatest(p.y0,t.y0) AS y0, least(p.x1,t.x1) AS x1, least(p.y1,t.y1) AS y1
    FROM parcels p JOIN territories t ON {MEET} WHERE NOT (p.source = 'registry' AND t.source = 'federal_unit')"""


@query("zone_overlaps", ctes("parcels", "territories", z=_ZPAIRS) + """
    SELECT pname AS property_name, pcode AS property_code, psource AS property_source, tname AS traditional_name,
      tsource AS traditional_source, cast((x1-x0)*(y1-y0) AS bigint) AS area FROM z""")
def zone_overlaps(spark, d):
    props, terr = layers(spark, d)
    return zones.zone_overlaps(props, terr, CELL, rectangles=True).drop("geom").withColumn("area", F.col("area").cast("bigint"))


@query("zone_overlaps_all_layers", ctes("parcels", "territories") + f"""
    SELECT count(*) AS overlaps, cast(sum({SHARED}) AS bigint) AS area FROM parcels p JOIN territories t ON {MEET}""")
def zone_overlaps_all_layers(spark, d):
    props, terr = layers(spark, d)
    out = zones.zone_overlaps(props, terr, CELL, include_missing=True, rectangles=True)
    return out.agg(F.count(F.lit(1)).alias("overlaps"), F.sum("area").cast("bigint").alias("area"))


_ZONES = ctes(
    "parcels", "territories", pairs=_ZPAIRS, near=NEAR, reach=REACH, lab=LABEL,
    m="SELECT p.*, l.cluster, concat(l.cluster, '|', tsource) AS zone FROM pairs p JOIN lab l USING (id)",
    xs="SELECT zone, x, lead(x) OVER (PARTITION BY zone ORDER BY x) AS nx FROM (SELECT zone, x0 AS x FROM m UNION SELECT zone, x1 FROM m)",
    ys="SELECT zone, y, lead(y) OVER (PARTITION BY zone ORDER BY y) AS ny FROM (SELECT zone, y0 AS y FROM m UNION SELECT zone, y1 FROM m)",
    fields="""SELECT DISTINCT zone, x, nx, y, ny FROM m JOIN xs USING (zone) JOIN ys USING (zone)
      WHERE x0 <= x AND nx <= x1 AND y0 <= y AND ny <= y1""",
    areas="SELECT zone, sum((nx-x)*(ny-y)) AS area FROM fields GROUP BY zone",
    z="""SELECT zone, min(tname) AS traditional_name, min(tsource) AS traditional_source,
      string_agg(DISTINCT pname, '; ' ORDER BY pname) AS property_name, string_agg(DISTINCT pcode, '; ' ORDER BY pcode) AS property_code,
      string_agg(DISTINCT psource, '; ' ORDER BY psource) AS property_source, count(*) AS "overlaps", min(x0) AS mx, min(y0) AS my
      FROM m GROUP BY zone""")


@query("conflict_zones", _ZONES + """
    SELECT row_number() OVER (ORDER BY traditional_name, traditional_source, property_code, property_name, mx, my) AS id,
      property_name, property_code, property_source, traditional_name, traditional_source, "overlaps", cast(area AS bigint) AS area
    FROM z JOIN areas USING (zone)""")
def conflict_zones(spark, d):
    props, terr = layers(spark, d)
    out = zones.conflict_zones(props, terr, CELL, eps=EPS, rectangles=True)
    return out.drop("geom", "properties").withColumn("area", F.round("area").cast("bigint"))


@query("conflict_points", _ZONES + """
    SELECT traditional_name, traditional_source, count(*) AS points, count(*) AS inside FROM z GROUP BY ALL""")
def conflict_points(spark, d):
    props, terr = layers(spark, d)
    z = zones.conflict_zones(props, terr, CELL, eps=EPS, rectangles=True)
    pts = zones.conflict_points(z).select("id", F.col("geom").alias("pt"))
    both = z.join(pts, "id")
    return both.groupBy("traditional_name", "traditional_source").agg(
        F.count(F.lit(1)).alias("points"),
        F.count_if(g.st_contains("geom", F.col("pt")["minx"], F.col("pt")["miny"])).alias("inside"))
