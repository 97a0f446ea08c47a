"""Sources and sinks, on files rendered from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import geometry as g
from ..functions.kml import to_kml
from ..plans import regularization as reg
from ..plans.evictions import evictions as clean, filter_state_cases
from ..session import scratch_path
from ..sinks import tables as sinks
from ..sources import files as src
from ..streaming.intake import stream_cases, streamed_cases as cases_of_store
from ..operators.summaries import family_totals
from . import ctes, query
from .cases import documents
from .spatial import CELL
from .text import _LIMBS, derive, sql_case

_BOXES = ctes("parcels") + """SELECT code, town, cast((x1-x0)*(y1-y0) AS bigint) AS area, cast(x0 AS bigint) AS minx FROM parcels"""


def _measured(df):
    return df.select("code", "town", g.st_area("geom").cast("bigint").alias("area"), F.col("geom.minx").cast("bigint").alias("minx"))


@query("geojson_lines", _BOXES)
def geojson_lines(spark, d):
    path = scratch_path(spark, "geojson")
    sinks.write_geojson(fx.parcels(spark, d).select("code", "town", "geom"), path)
    return _measured(src.read_geojson(spark, path, "code bigint, town string", lines=True))


@query("geojson_collections", _BOXES)
def geojson_collections(spark, d):
    """Classic collections of bounded size, each one document."""
    path = scratch_path(spark, "collections")
    sinks.write_geojson_collections(fx.parcels(spark, d).select("code", "town", "geom"), path, rows=2000)
    return _measured(src.read_geojson(spark, path, "code bigint, town string"))


@query("geojson_in_parts", _BOXES)
def geojson_in_parts(spark, d):
    """Large classic collections, read in parts of their files."""
    path = scratch_path(spark, "collections")
    sinks.write_geojson_collections(fx.parcels(spark, d).select("code", "town", "geom"), path)
    return _measured(src.read_geojson(spark, path, "code bigint, town string", split=True))


@query("kml_document", ctes("parcels") + """
    SELECT code, CASE source WHEN 'registry' THEN 'registry & more' ELSE source END AS layer, cast((x1-x0)*(y1-y0) AS bigint) AS area,
      concat('CAR ', code) AS title FROM parcels""")
def kml_document(spark, d):
    path = scratch_path(spark, "kml")
    p = fx.parcels(spark, d).select("code", F.col("code").alias("cod_imovel"), F.when(F.col("source") == "registry", "registry & more")
                                    .otherwise(F.col("source")).alias("kind"), "geom").withColumn("layer", F.col("kind"))
    sinks.write_kml(p, path, "Parcels", layer="layer", order=["code"])
    got = src.read_kml(spark, path)
    return got.select(F.col("data")["code"].cast("bigint").alias("code"), F.col("data")["kind"].alias("layer"),
                      g.st_area("geom").cast("bigint").alias("area"), F.col("name").alias("title"))


@query("kml_folders", ctes("parcels") + """
    SELECT concat(source, ' (', count(*), ')') AS folder, count(*) AS features FROM parcels GROUP BY source""")
def kml_folders(spark, d):
    lines = sinks.kml_lines(fx.parcels(spark, d).select("code", F.col("source").alias("layer"), "geom"), "Parcels")
    return lines.filter("section = 2").groupBy("layer").agg(
        F.max(F.regexp_extract(F.when(F.col("step") == 0, F.col("text")), "<name>(.*)</name>", 1)).alias("folder"),
        F.count_if(F.col("step") == 1).alias("features")).drop("layer")


@query("gazetteer_file", ctes("gazetteer") + "SELECT code, name, lon, lat FROM gazetteer")
def gazetteer_file(spark, d):
    path = scratch_path(spark, "gazetteer")
    entry = F.to_json(F.struct("lon", "lat", "name"))
    entries = fx.gazetteer(spark, d).select(F.concat(F.lit('"'), F.col("code").cast("string"), F.lit('": '), entry))
    sinks.write_documents(entries, path, "{", "}", ",", rows=2000)
    return src.read_gazetteer(spark, path).select("code", "name", "lon", "lat")


@query("landed_case_pages", ctes("cases") + "SELECT cast(id AS varchar) AS id, raw_number AS number, court, chamber FROM cases")
def landed_case_pages(spark, d):
    path = scratch_path(spark, "pages")
    docs = documents(spark, d)
    hit = F.struct(F.struct(*[c for c in docs.columns if c not in ("seq", "tribunal_source")]).alias("_source"))
    pages = docs.select("tribunal_source", F.floor(F.col("seq") / 100).alias("page"), hit.alias("hit")).groupBy("tribunal_source", "page").agg(
        F.struct(F.collect_list("hit").alias("hits")).alias("hits"))
    pages.select("tribunal_source", "hits").write.partitionBy("tribunal_source").json(path)
    got = src.read_cases(spark, {c: f"{path}/tribunal_source={c}" for c in ("TJPE", "TRF5")}, pages=True)
    return got.select("id", F.col("numeroProcesso").alias("number"), F.col("tribunal_source").alias("court"), F.col("orgaoJulgador.nome").alias("chamber"))


@query("csv_file", ctes("gazetteer") + "SELECT cast(code AS varchar) AS code, name FROM gazetteer")
def csv_file(spark, d):
    path = scratch_path(spark, "csv")
    sinks.write_csv(fx.gazetteer(spark, d).select("code", "name"), path)
    return spark.read.option("header", True).csv(path)


@query("clustered_layout", ctes("parcels") + "SELECT count(*) AS parcels, cast(sum(x0) AS bigint) AS x FROM parcels WHERE x0 >= 2048 AND x0 < 3000 AND y0 < 1024")
def clustered_layout(spark, d):
    path = scratch_path(spark, "clustered")
    sinks.write_clustered(fx.parcels(spark, d).select("code", "geom"), path, 512.0, 8)
    near = spark.read.parquet(path).filter("geom.minx >= 2048 AND geom.minx < 3000 AND geom.miny < 1024")
    return near.agg(F.count(F.lit(1)).alias("parcels"), F.sum("geom.minx").cast("bigint").alias("x"))


@query("discovered_layers", """SELECT DISTINCT CASE WHEN p_size % 10 = 3 THEN 'layer_3' ELSE concat('layer_', p_size % 10) END AS layer,
    CASE WHEN p_size % 10 IN (3, 5) THEN 'shp' ELSE 'geojson' END AS format FROM part""")
def discovered_layers(spark, d):
    """Layers as folders of features, written by value of a column; some exist in both formats."""
    root = scratch_path(spark, "layers")
    n = F.col("p_size") % 10
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col("p_partkey") * 1.0, n * 1.0).alias("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("p_name").alias("properties"), point.alias("geometry")))
    kinds = F.filter(F.array(F.when(~n.isin(3, 5), "geojson"), F.when(n % 2 == 1, "shp")), lambda k: k.isNotNull())
    rows = fx.table(spark, d, "part").select(feature.alias("value"), n.alias("n"), F.explode(kinds).alias("kind"))
    named = rows.select("value", F.concat(F.lit("Layer-"), F.col("n").cast("string"), F.lit("."), "kind").alias("name"))
    named.repartition("name").write.partitionBy("name").text(root)
    return src.discover_layers(spark, root).select("layer", "format")


# --- eviction reports ------------------------------------------------------------------------

_UFS = ["pe", " PE ", "pb", None]
_TOWNS = ["recife-pe", "olinda-pe", "natal-rn", "sao-jose"]
_REPORTS = f"""SELECT event_id AS seq, user_id, {sql_case('event_id % 4', _UFS)} AS uf, {sql_case('user_id % 4', _TOWNS)} AS town,
    cast(-35 AS double) - event_id % 40 * 0.125 AS lon, cast(-8 AS double) - user_id % 8 * 0.125 AS lat, event_id % 9 = 0 AS swapped,
    concat(cast(user_id % 400 AS varchar(4)), ' familias') AS threatened, cast(event_id % 30 AS varchar(4)) AS evicted,
    {sql_case('event_id % 3', ['ameaca', 'remocao-total', None])} AS status FROM events"""
_AREA = "SELECT -38.0 AS x0, -9.0 AS y0, -36.0 AS x1, -8.0 AS y1"
_KEPT = ctes(t=_REPORTS, k="""SELECT * FROM t WHERE coalesce(trim(lower(uf)), 'pe') = 'pe' AND town <> 'natal-rn'
    AND (trim(lower(uf)) = 'pe' OR town LIKE '%-pe' OR (CASE WHEN swapped THEN lat ELSE lon END > -38 AND CASE WHEN swapped THEN lat ELSE lon END < -36
      AND CASE WHEN swapped THEN lon ELSE lat END > -9 AND CASE WHEN swapped THEN lon ELSE lat END < -8))""",
             o="SELECT *, row_number() OVER (PARTITION BY lon, lat ORDER BY seq) - 1 AS occurrence FROM k",
             j="SELECT *, concat(seq, '_Title ', user_id, '_', occurrence) AS jk FROM o")


def reports(spark, d):
    t = derive(spark, d, _REPORTS, "events")
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    lon, lat = F.col("lon").cast("string"), F.col("lat").cast("string")
    meta = F.struct(
        F.when(F.col("swapped"), lon).otherwise(lat).alias("localizacao_lat"), F.when(F.col("swapped"), lat).otherwise(lon).alias("localizacao_lng"),
        F.col("threatened").alias("numero_de_familias_ameacadas"), F.col("evicted").alias("numero_de_familias_despejadas"),
        F.when(F.col("seq") % 5 > 0, F.array(F.lit("Defensoria"), F.lit("Popular"))).alias("acompanhamento_juridico_do_caso"), F.lit("Privado").alias("agentes_promotores_publicos_ou_privados"))
    return t.select("seq", F.struct(
        F.col("seq").alias("ID"), F.concat(F.lit(" Title "), F.col("user_id").cast("string")).alias("post_title"), meta.alias("meta"),
        F.struct(one("uf").alias("uf"), one("town").alias("municipio"), one("status").alias("status_conflito"),
                 F.array().cast("array<string>").alias("causa_do_conflito")).alias("tax")).alias("item"))


def landed_reports(spark, d):
    """One document per stretch of reports, read back in the order of the reports: files are taken by name. A task writes
    about a hundred documents, each into a file of its own; their names count on within a task (below a thousand) and by task."""
    path = scratch_path(spark, "reports")
    name = F.lpad(F.floor(F.col("seq") / 500).cast("string"), 9, "0")
    docs = reports(spark, d).groupBy(name.alias("doc")).agg(F.array_sort(F.collect_list(F.struct("seq", "item"))).alias("c"))
    docs = docs.select("doc", F.col("c.item").alias("conflito"))
    tasks = max(1, -(-fx.table(spark, d, "events").count() // 50_000))
    (docs.repartitionByRange(tasks, "doc").sortWithinPartitions("doc").drop("doc")
     .write.option("maxRecordsPerFile", 1).json(path))
    return src.read_evictions(spark, path)


def area(spark, d):
    # the area of interest
    return derive(spark, d, "SELECT DISTINCT -38.0 AS x0, -9.0 AS y0, -36.0 AS x1, -8.0 AS y1 FROM supplier", "supplier").select(
        g.st_box("x0", "y0", "x1", "y1").alias("geom"))


_ANG, _DST = _LIMBS.format("md5(jk)", 360), _LIMBS.format("lpad(substr(md5(jk), 1, 30), 32, '0')", 1000)


@query("eviction_reports", _KEPT + f"""
    SELECT seq AS conflito_id, concat('Title ', user_id) AS nome_comunidade, CASE town WHEN 'recife-pe' THEN 'Recife' WHEN 'olinda-pe' THEN 'Olinda' ELSE 'Sao Jose' END AS municipio,
      user_id % 400 AS familias_ameacadas, event AS familias_despejadas, user_id % 400 + event AS total_familias,
      CASE status WHEN 'ameaca' THEN 'Ameaça de Despejo' WHEN 'remocao-total' THEN 'Despejo/Remoção Total Executada' ELSE 'Não informado' END AS status_conflito,
      'Conflito Fundiário / Posse' AS causa_conflito, CASE WHEN seq % 5 = 0 THEN '' ELSE 'Defensoria; Popular' END AS acompanhamento_juridico, 'Privado' AS agente_promotor, occurrence,
      round(CASE WHEN occurrence = 0 THEN lon ELSE lon + ({_DST})/1000.0*0.45*cos(({_ANG})*pi()/180.0)/(111.0*cos(radians(lat))) END, 8) AS lon,
      round(CASE WHEN occurrence = 0 THEN lat ELSE lat + ({_DST})/1000.0*0.45*sin(({_ANG})*pi()/180.0)/111.0 END, 8) AS lat
    FROM (SELECT *, seq % 30 AS event FROM j)""")
def eviction_reports(spark, d):
    out = clean(landed_reports(spark, d), area(spark, d), 0.5)
    return out.select("conflito_id", "nome_comunidade", "municipio", "familias_ameacadas", "familias_despejadas", "total_familias", "status_conflito",
                      "causa_conflito", "acompanhamento_juridico", "agente_promotor", "occurrence", F.round("geom.minx", 8).alias("lon"),
                      F.round("geom.miny", 8).alias("lat"))


@query("eviction_totals", _KEPT + """SELECT count(*) AS conflitos, cast(sum(user_id % 400) AS bigint) AS familias_ameacadas,
    cast(sum(seq % 30) AS bigint) AS familias_despejadas FROM k""")
def eviction_totals(spark, d):
    return family_totals(clean(landed_reports(spark, d), area(spark, d), 0.5))


@query("reports_by_tags", ctes(t=_REPORTS) + """SELECT seq FROM t WHERE coalesce(trim(lower(uf)), 'pe') = 'pe' AND town <> 'natal-rn'
    AND (trim(lower(uf)) = 'pe' OR town LIKE '%-pe')""")
def reports_by_tags(spark, d):
    return filter_state_cases(landed_reports(spark, d)).select(F.col("ID").cast("bigint").alias("seq"))


# --- regularization files --------------------------------------------------------------------

def placemarks(spark, d):
    """Community areas and individual cases as one KML file set."""
    path = scratch_path(spark, "moradia")
    p = fx.parcels(spark, d).withColumn("lon", F.lit(-35.0) - F.col("code") % 100 * 0.01).withColumn("lat", F.lit(-8.0) - F.col("code") % 7 * 0.1)
    box = to_kml(g.st_box("lon", "lat", F.col("lon") + 0.01, F.col("lat") + 0.01))
    name = F.concat(F.lit("São Nação-"), (F.col("code") % 30).cast("string"), F.lit(" - Vila "), F.col("code").cast("string"))
    data = lambda k, v: F.concat(F.lit(f'<Data name="{k}"><value>'), v, F.lit("</value></Data>"))
    areas = p.filter("code % 2 = 0").select(F.concat(F.lit("<Placemark><name>"), name, F.lit("</name>"), box, F.lit("</Placemark>")).alias("value"))
    cases = p.filter("code % 2 = 1").select(F.concat(
        F.lit("<Placemark><name>"), F.lpad(F.col("code").cast("string"), 20, "0"), F.lit("</name><ExtendedData>"),
        data("idmoradia", F.col("code").cast("string")), data("cidade", F.when(F.col("code") % 3 == 0, F.concat(F.lit("SÃO NAÇÃO-"), (F.col("code") % 25).cast("string"))).otherwise("")),
        data("orgao_judiciario", F.when(F.col("code") % 3 == 1, F.concat(F.lit("Vara de Sao Nacao-"), (F.col("code") % 9).cast("string"))).otherwise("Vara")),
        F.lit("</ExtendedData></Placemark>")).alias("value"))
    sinks.write_placemarks(areas.unionByName(cases), path, "Moradia")
    return src.read_kml(spark, path)


@query("community_areas", ctes("parcels", "gazetteer") + """
    SELECT concat('São Nação-', p.code % 30, ' - Vila ', p.code) AS nome, CASE WHEN g.code IS NULL THEN 'Pernambuco' ELSE g.name END AS municipio,
      CASE WHEN g.code IS NULL THEN concat('São Nação-', p.code % 30, ' - Vila ', p.code) ELSE concat('Vila ', p.code) END AS comunidade, true AS has_area
    FROM parcels p LEFT JOIN gazetteer g ON g.name = concat('São Nação-', p.code % 30) WHERE p.code % 2 = 0""")
def community_areas(spark, d):
    out = reg.community_polygons(placemarks(spark, d), fx.gazetteer(spark, d))
    return out.select("nome", "municipio", "comunidade", (F.col("area_ha") > 100).alias("has_area"))


@query("regularization_cases", ctes("parcels") + """
    SELECT concat(substr(lpad(cast(code AS varchar), 20, '0'), 1, 7), '-', substr(lpad(cast(code AS varchar), 20, '0'), 8, 2), '.', substr(lpad(cast(code AS varchar), 20, '0'), 10, 4), '.',
        substr(lpad(cast(code AS varchar), 20, '0'), 14, 1), '.', substr(lpad(cast(code AS varchar), 20, '0'), 15, 2), '.', substr(lpad(cast(code AS varchar), 20, '0'), 17, 4)) AS numero_processo,
      cast(code AS varchar) AS idmoradia, CASE code % 3 WHEN 0 THEN concat('São Nação-', code % 25) WHEN 1 THEN concat('São Nação-', code % 9) ELSE 'Recife' END AS cidade
    FROM parcels WHERE code % 2 = 1""")
def regularization_cases(spark, d):
    out = reg.regularization_cases(placemarks(spark, d), fx.gazetteer(spark, d))
    return out.select("numero_processo", "idmoradia", "cidade")


_LOTS = ctes("parcels") + """SELECT cast(code AS varchar) AS num_lote, CASE WHEN code % 3 = 0 THEN 'Comarca X' ELSE concat('Town ', code % 2) END AS comarca,
    concat('Town ', code % 2) AS municipio, CASE WHEN code % 4 = 0 THEN -1 ELSE 2600000 END AS municipio_ibge FROM parcels"""


@query("state_parcels", _LOTS)
def state_parcels(spark, d):
    root = scratch_path(spark, "lots")
    p = fx.parcels(spark, d)
    box = to_kml(g.st_multi(g.st_box(F.lit(-36.0), F.lit(-8.0), F.lit(-35.99), F.lit(-7.99))))
    simple = lambda k, v: F.concat(F.lit(f'<SimpleData name="{k}">'), v, F.lit("</SimpleData>"))
    rows = p.select((F.col("code") % 2).alias("f"), F.concat(
        F.lit("<Placemark><ExtendedData><SchemaData>"), simple("NUM_LOTE", F.col("code").cast("string")),
        simple("COMARCA", F.when(F.col("code") % 3 == 0, "Comarca X").otherwise(" ")),
        simple("CD_MUN", F.when(F.col("code") % 4 == 0, "n/d").otherwise("2600000")), F.lit("</SchemaData></ExtendedData>"), box,
        F.lit("</Placemark>")).alias("value"))
    marks = None
    for i in (0, 1):  # two source files, as delivered
        sinks.write_placemarks(rows.filter(F.col("f") == i).select("value"), f"{root}/{i}", "Malha")
        one = src.read_kml(spark, f"{root}/{i}").withColumn("file", F.lit(f"malha_{i}.kml"))
        marks = one if marks is None else marks.unionByName(one)
    files = p.select(F.concat(F.lit("malha_"), (F.col("code") % 2).cast("string"), F.lit(".kml")).alias("file"),
                     F.concat(F.lit("Town "), (F.col("code") % 2).cast("string")).alias("municipio")).distinct()
    return reg.state_parcels(marks, files).select("num_lote", "comarca", "municipio", F.coalesce("municipio_ibge", F.lit(-1)).alias("municipio_ibge"))


# --- streaming -------------------------------------------------------------------------------

@query("streamed_cases", ctes("cases") + """
    SELECT cast(id AS varchar) AS id, court AS tribunal, CASE WHEN seq % 7 = 0 THEN 'Vara Nova' ELSE chamber END AS chamber FROM cases""")
def streamed_cases(spark, d):
    """Several files and batches of two courts; then some cases land once more with another chamber.

    The documents of both courts land in one pass, compressed, a folder per court. A file holds at most a twelfth of all
    cases and what one task has; a batch takes three files, and one more for every million cases."""
    docs, gaz, root = documents(spark, d), fx.gazetteer(spark, d), scratch_path(spark, "landed")
    n = fx.table(spark, d, "orders").count()
    again = docs.filter("seq % 7 = 0").withColumn("orgaoJulgador", F.col("orgaoJulgador").withField("nome", F.lit("Vara Nova")))
    for landing in (docs, again):
        (landing.sortWithinPartitions("tribunal_source", "seq").drop("seq").write.mode("append").partitionBy("tribunal_source")
         .option("compression", "gzip").option("maxRecordsPerFile", max(1, -(-n // 12))).json(f"{root}/in"))
        for court in ("TJPE", "TRF5"):
            stream_cases(spark, f"{root}/in/tribunal_source={court}", f"{root}/store", f"{root}/offsets/{court}", gaz, court,
                         max_files=3 + n // 1_000_000).awaitTermination()
    return cases_of_store(spark, f"{root}/store").select("id", "tribunal", F.col("orgao_julgador_nome").alias("chamber"))
