"""Text, number and label functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from .. import fixtures as fx
from ..functions import kml, text as tx
from ..operators import lookups
from ..operators.summaries import area_by, profile
from ..operators.rows import top_counts
from . import ctes, query

DIGITS = "regexp_replace(raw, '\\D', '', 'g')"
SPACES = "regexp_replace({}, '\\s+', ' ', 'g')"


def sql_case(column: str, values: list, default: str = "NULL") -> str:
    """CASE that picks ``values[i]`` where the column is ``i``; the same text in both engines."""
    lit = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"CASE {column} " + " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values)) + f" ELSE {default} END"


def derive(spark, d, sql: str, *tables: str):
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **{t: fx.table(spark, d, t) for t in tables})


# --- documents: whole texts ------------------------------------------------------------------

@query("normalized_documents", f"""
    SELECT doc_id, md5(trim({SPACES.format("replace(lower(strip_accents(text)), '-', ' ')")})) AS normal,
      md5(upper(trim({SPACES.format("regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')")}))) AS upper_form
    FROM documents""")
def normalized_documents(spark, d):
    return fx.table(spark, d, "documents").select(
        "doc_id", F.md5(tx.normalize_text("text")).alias("normal"), F.md5(tx.normalize_upper("text")).alias("upper_form"))


_SAFE = ("trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower(strip_accents(w)), "
         "'[^\\x00-\\x7F]', '', 'g')), '[\\s\\-]+', '_', 'g'), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '_')")


@query("sanitized_words", f"""
    SELECT {_SAFE} AS name, count(*) AS words FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY 1""")
def sanitized_words(spark, d):
    words = fx.table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("w"))
    return words.groupBy(tx.sanitize_name("w").alias("name")).agg(F.count(F.lit(1)).alias("words"))


@query("escaped_documents", r"""
    SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'),
        '''', '&apos;')) AS escaped,
      md5(lower(regexp_replace(regexp_replace(strip_accents(text), '[^a-zA-Z0-9_\-.]', '_', 'g'), '_+', '_', 'g'))) AS file_name
    FROM documents""")
def escaped_documents(spark, d):
    return fx.table(spark, d, "documents").select(
        "doc_id", F.md5(kml.xml_escape("text")).alias("escaped"), F.md5(tx.safe_filename("text")).alias("file_name"))


# --- numbers and codes -----------------------------------------------------------------------

_RAW = """SELECT o_orderkey AS k, CASE o_orderkey % 6
      WHEN 0 THEN concat(lpad(cast(o_orderkey AS varchar(20)), 7, '0'), '42', cast(year(o_orderdate) AS varchar(4)), '8178300')
      WHEN 1 THEN concat(lpad(cast(o_orderkey AS varchar(20)), 7, '0'), '-42.', cast(year(o_orderdate) AS varchar(4)), '.8.17.8301')
      WHEN 2 THEN concat('42', cast(year(o_orderdate) AS varchar(4)), '8178300', cast(o_custkey % 1000 AS varchar(5)), '77')
      WHEN 3 THEN concat('proc ', cast(o_orderkey AS varchar(20)))
      WHEN 4 THEN '' ELSE NULL END AS raw FROM orders"""
_MASK = "regexp_replace({}, '^(\\d{{7}})(\\d{{2}})(\\d{{4}})(\\d)(\\d{{2}})(\\d{{4}})$', '\\1-\\2.\\3.\\4.\\5.\\6')"


@query("case_numbers", ctes(t=_RAW) + f"""
    SELECT k, CASE WHEN raw IS NULL OR raw = '' THEN 'N/A' WHEN length({DIGITS}) = 20 THEN {_MASK.format(DIGITS)} ELSE raw END AS number,
      CASE WHEN raw IS NULL OR raw = '' THEN 'N/A' WHEN length({DIGITS}) = 20 THEN {_MASK.format(DIGITS)}
        WHEN length({DIGITS}) BETWEEN 15 AND 19 THEN {_MASK.format(f"lpad({DIGITS}, 20, '0')")} ELSE raw END AS padded FROM t""")
def case_numbers(spark, d):
    return derive(spark, d, _RAW, "orders").select(
        "k", tx.format_case_number("raw").alias("number"), tx.format_case_number("raw", pad=True).alias("padded"))


_DAY = "concat(cast(year(o_orderdate) AS varchar(4)), '{0}', lpad(cast(month(o_orderdate) AS varchar(2)), 2, '0'), '{0}', lpad(cast(day(o_orderdate) AS varchar(2)), 2, '0'))"
_DATES = f"""SELECT o_orderkey AS k, CASE o_orderkey % 6
      WHEN 0 THEN concat({_DAY.format('-')}, 'T04:13:', lpad(cast(o_custkey % 60 AS varchar(2)), 2, '0'), '.065000Z')
      WHEN 1 THEN concat({_DAY.format('')}, '1537', lpad(cast(o_custkey % 60 AS varchar(2)), 2, '0'))
      WHEN 2 THEN {_DAY.format('')} WHEN 3 THEN {_DAY.format('/')}
      WHEN 4 THEN '20241399' ELSE NULL END AS raw FROM orders"""


@query("court_dates", ctes(t=_DATES) + """
    SELECT k, coalesce(strftime(CASE WHEN contains(raw, 'T') THEN try_strptime(split_part(replace(raw, 'Z', ''), '.', 1), '%Y-%m-%dT%H:%M:%S')
      WHEN length(raw) = 14 THEN try_strptime(raw, '%Y%m%d%H%M%S') WHEN length(raw) = 8 THEN try_strptime(raw, '%Y%m%d') END,
      '%Y-%m-%d %H:%M:%S'), 'none') AS filed FROM t""")
def court_dates(spark, d):
    return derive(spark, d, _DATES, "orders").select("k", F.coalesce(F.date_format(
        tx.parse_court_date("raw"), "yyyy-MM-dd HH:mm:ss"), F.lit("none")).alias("filed"))


_DIRTY = """SELECT event_id AS k, CASE event_id % 7 WHEN 0 THEN concat(' ', cast(user_id AS varchar(20)), ' familias')
      WHEN 1 THEN '1.5' WHEN 2 THEN '-3' WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN cast(user_id AS varchar(20))
      ELSE concat(lpad(cast(event_id AS varchar(20)), 3, '0'), '.111.222-', lpad(cast(user_id % 100 AS varchar(3)), 2, '0')) END AS raw
    FROM events"""


@query("dirty_numbers", ctes(t=_DIRTY) + """
    SELECT k, coalesce(try_cast(nullif(regexp_replace(raw, '\\D', '', 'g'), '') AS bigint), 0) AS digits,
      coalesce(CASE WHEN try_cast(CASE WHEN regexp_full_match(trim(raw), '[+-]?\\d+') THEN trim(raw) END AS int) > 0
        THEN cast(trim(raw) AS int) END, -1) AS code,
      coalesce(CASE WHEN regexp_full_match(trim(raw), '\\d+') THEN cast(trim(raw) AS int) END, -1) AS plain,
      upper(regexp_replace(trim(raw), '[\\s.]', '', 'g')) AS clean,
      CASE WHEN length(regexp_replace(raw, '\\D', '', 'g')) = 11
        THEN concat('***.', substr(regexp_replace(raw, '\\D', '', 'g'), 4, 3), '.', substr(regexp_replace(raw, '\\D', '', 'g'), 7, 3), '-**')
        ELSE regexp_replace(raw, '\\d', '*', 'g') END AS masked FROM t""")
def dirty_numbers(spark, d):
    none = F.lit(-1)
    return derive(spark, d, _DIRTY, "events").select(
        "k", tx.int_or_zero("raw").alias("digits"), F.coalesce(tx.positive_code("raw"), none).alias("code"),
        F.coalesce(tx.digits_or_null("raw"), none).alias("plain"), tx.clean_code("raw").alias("clean"),
        tx.mask_id("raw").alias("masked"))


# 18 to 30 digits with marks between
_LONG = """SELECT o_orderkey AS k, concat(lpad(cast(o_orderkey AS varchar(20)), 9, '0'), ' ', lpad(cast(o_custkey AS varchar(20)), 9, '7'),
      CASE o_orderkey % 3 WHEN 0 THEN ' familias' WHEN 1 THEN '-123456.7' ELSE '/998877665544' END) AS raw FROM orders"""


@query("long_numbers", ctes(t=_LONG) + """
    SELECT k, cast(cast(regexp_replace(raw, '\\D', '', 'g') AS decimal(38,0)) AS varchar) AS digits FROM t""")
def long_numbers(spark, d):
    return derive(spark, d, _LONG, "orders").select("k", tx.int_or_zero("raw").cast("string").alias("digits"))


_LIMBS = ("((((cast(concat('0x', substr({0}, 1, 8)) AS bigint) % {1}) * 4294967296 + cast(concat('0x', substr({0}, 9, 8)) AS bigint)) % {1}"
          " * 4294967296 + cast(concat('0x', substr({0}, 17, 8)) AS bigint)) % {1} * 4294967296"
          " + cast(concat('0x', substr({0}, 25, 8)) AS bigint)) % {1}")
_H = "md5(cast(o_orderkey AS varchar(20)))"
_H8 = "lpad(substr(md5(cast(o_orderkey AS varchar(20))), 1, 30), 32, '0')"


@query("md5_remainders", f"""SELECT o_orderkey AS k, {_LIMBS.format(_H, 360)} AS angle, {_LIMBS.format(_H8, 1000)} AS distance FROM orders""")
def md5_remainders(spark, d):
    key = F.col("o_orderkey").cast("string")
    return fx.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("k"), tx.md5_mod(key, 360).alias("angle"), tx.md5_mod(key, 1000, 8).alias("distance"))


@query("jittered_points", f"""
    SELECT k, round(lon + dist*cos(angle)/(111.0*cos(radians(lat))), 9) AS lon, round(lat + dist*sin(angle)/111.0, 9) AS lat
    FROM (SELECT o_orderkey AS k, cast(-41 AS double) + o_custkey % 50 * 0.1 AS lon, cast(-9 AS double) + o_custkey % 20 * 0.1 AS lat,
      {_LIMBS.format(_H, 360)} * pi() / 180.0 AS angle, {_LIMBS.format(_H8, 1000)} / 1000.0 * 0.8 AS dist FROM orders)""")
def jittered_points(spark, d):
    t = fx.table(spark, d, "orders").selectExpr(
        "o_orderkey AS k", "cast(-41 AS double) + o_custkey % 50 * cast(0.1 AS double) AS lon",
        "cast(-9 AS double) + o_custkey % 20 * cast(0.1 AS double) AS lat")
    j = tx.jitter("lon", "lat", F.col("k").cast("string"), K.CASE_JITTER_KM)
    return t.select("k", j.alias("j")).select("k", F.round("j.lon", 9).alias("lon"), F.round("j.lat", 9).alias("lat"))


# --- slugs, lists, labels --------------------------------------------------------------------

_SLUGS = ["vitoria-de-santo-antao-pe", "recife-pe", "sao-jose-do-belmonte", "CABO-DE-SANTO-AGOSTINHO-PE", "", None]
_TAGS = ["ameaca", "area-de-risco", "remocao-total", "obra-nova-na-via", "", None]
_SLUG_SQL = f"SELECT event_id AS k, {sql_case('event_id % 6', _SLUGS)} AS slug, {sql_case('user_id % 6', _TAGS)} AS tag FROM events"
_TITLES = {"vitoria-de-santo-antao-pe": "Vitoria de Santo Antao", "recife-pe": "Recife", "sao-jose-do-belmonte": "Sao Jose do Belmonte",
           "CABO-DE-SANTO-AGOSTINHO-PE": "Cabo de Santo Agostinho"}
_LABELS = {t: K.TAXONOMY_LABELS[t] for t in _TAGS[:3]} | {"obra-nova-na-via": "Obra Nova Na Via"}
sql_map = lambda c, m, default: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items()) + f" ELSE {default} END"


@query("slug_titles", ctes(t=_SLUG_SQL) + f"""
    SELECT k, {sql_map('slug', _TITLES, "'Pernambuco'")} AS title, {sql_map('tag', _LABELS, "'Não informado'")} AS label FROM t""")
def slug_titles(spark, d):
    return derive(spark, d, _SLUG_SQL, "events").select("k", tx.slug_title("slug").alias("title"), tx.taxonomy_label("tag").alias("label"))


_ENUM = """SELECT o_orderkey AS k, concat('Town ', cast(o_orderkey % 9 AS varchar(3)), ', ', CASE WHEN o_orderkey % 3 = 0 THEN 'Abreu e Lima, ' ELSE '' END,
      ' Seat ', cast(o_custkey % 7 AS varchar(3)), ' e Port ', cast(o_custkey % 5 AS varchar(3)), '.') AS members FROM orders"""


@query("split_enumerations", ctes(t=_ENUM) + """
    SELECT k, concat_ws('|', concat('Town ', cast(k % 9 AS varchar(3))), CASE WHEN k % 3 = 0 THEN 'Abreu e Lima' END,
      trim(regexp_extract(members, '(Seat \\d)', 1)), regexp_extract(members, '(Port \\d)', 1)) AS names FROM t""")
def split_enumerations(spark, d):
    return derive(spark, d, _ENUM, "orders").select("k", F.array_join(tx.split_enumeration("members"), "|").alias("names"))


_LISTS = """SELECT o_orderkey AS k, concat('A', cast(o_orderkey % 5 AS varchar(2)), '; B') AS names,
    CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('c', cast(o_custkey % 3 AS varchar(2))) END AS codes FROM orders"""


@query("zipped_lists", ctes(t=_LISTS) + """
    SELECT k, concat('A', cast(k % 5 AS varchar(2)), '=', coalesce(codes, 'N/A')) AS first, 'B=N/A' AS second FROM t""")
def zipped_lists(spark, d):
    z = derive(spark, d, _LISTS, "orders").withColumn("z", tx.zip_lists("names", "codes"))
    show = lambda i: F.concat(F.col("z")[i]["v0"], F.lit("="), F.col("z")[i]["v1"])
    return z.select("k", show(0).alias("first"), show(1).alias("second"))


_ADDRESS = """SELECT c_custkey AS k, concat('Rua ', cast(c_custkey % 50 AS varchar(4))) AS street,
    CASE WHEN c_custkey % 3 = 0 THEN '' ELSE cast(c_custkey % 900 AS varchar(4)) END AS number,
    CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'Centro' END AS district, 'Recife' AS city,
    CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE '50000-000' END AS postcode, c_acctbal AS amount FROM customer"""


@query("labels_and_addresses", ctes(t=_ADDRESS) + """
    SELECT k, concat_ws(', ', street, nullif(trim(number), ''), district, city, 'CEP ' || nullif(trim(postcode), '')) AS address,
      substr(concat('Embargo ', coalesce(nullif(number, ''), 'S/N'), ' (', coalesce(district, 'N/D'), ')'), 1, 18) AS label,
      coalesce(nullif(trim(number), ''), district, 'none') AS present,
      CASE WHEN k % 2 = 0 THEN 'Sede da Comarca' ELSE 'Termo Judiciário (Município Abrangido)' END AS role, k % 7 > 1 AS daughters FROM t""")
def labels_and_addresses(spark, d):
    k = F.col("k")
    return derive(spark, d, _ADDRESS, "customer").select(
        "k", tx.compose_address("street", "number", "district", "city", "postcode").alias("address"),
        tx.compose_label("Embargo {} ({})", F.coalesce(F.nullif("number", F.lit("")), F.lit("S/N")),
                         F.coalesce("district", F.lit("N/D")), max_len=18).alias("label"),
        tx.first_present("number", "district", F.lit("none")).alias("present"), tx.role_label(k % 2 == 0).alias("role"),
        tx.has_daughters(k % 7).alias("daughters"))


_KINDS = ["agriculture", "urban_expansion", "ilegal_mining", "natural_cause", "others", "road"]
_SOURCES = ["sigef_privado_pe", "imovel_certificado_snci_brasil_pe", "area_imovel_1", "posses"]
_TERR = ["tis_poligonais", "embargos_icmbio", "x"]
_KIND_SQL = (f"SELECT event_id AS k, {sql_case('event_id % 6', _KINDS)} AS kind, {sql_case('event_id % 4', _SOURCES)} AS source, "
             f"{sql_case('event_id % 3', _TERR)} AS terr, {sql_case('user_id % 2', ['TJPE', 'TRF5'])} AS court FROM events")


@query("domain_labels", ctes(t=_KIND_SQL) + f"""
    SELECT k, {sql_map('kind', {**{n: K.PRESSURE_LABELS[n] for n in _KINDS if n in K.PRESSURE_LABELS}, 'ilegal_mining': 'Mineração'}, 'kind')} AS pressure,
      CASE source WHEN 'sigef_privado_pe' THEN 'SIGEF' WHEN 'imovel_certificado_snci_brasil_pe' THEN 'SNCI' WHEN 'area_imovel_1' THEN 'CAR' ELSE 'Imóvel' END AS property,
      {sql_map('terr', {n: K.TERRITORY_LABELS[n] for n in _TERR[:2]}, "'Território'")} AS territory,
      CASE court WHEN 'TJPE' THEN '{K.STATE_CASE_URL}' ELSE '{K.FEDERAL_CASE_URL}' END AS url FROM t""")
def domain_labels(spark, d):
    return derive(spark, d, _KIND_SQL, "events").select(
        "k", tx.pressure_label("kind").alias("pressure"), tx.property_source_label("source").alias("property"),
        tx.territory_label("terr").alias("territory"), tx.case_url("court").alias("url"))


@query("ptbr_display", """
    SELECT o_orderkey AS k, translate(format('{:,.2f}', o_totalprice), ',.', '.,') AS money,
      regexp_replace(regexp_replace(translate(format('{:,.4f}', o_totalprice), ',.', '.,'), '0{1,4}$', ''), ',$', '') AS area,
      strftime(o_orderdate, '%d/%m/%Y') AS day FROM orders""")
def ptbr_display(spark, d):
    return fx.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("k"), tx.format_ptbr("o_totalprice", 2, 2).alias("money"),
        tx.format_ptbr("o_totalprice", 4).alias("area"), tx.date_ptbr("o_orderdate").alias("day"))


# --- KML and GeoJSON text --------------------------------------------------------------------

_COLORS = ["#3b82f6", "#abc", "#11223344", "red", "", None]
_COLOR_SQL = f"SELECT c_custkey AS k, {sql_case('c_custkey % 6', _COLORS)} AS c FROM customer"


@query("kml_colors", ctes(t=_COLOR_SQL) + """
    SELECT k, CASE c WHEN '#3b82f6' THEN '66f6823b' WHEN '#abc' THEN '66ccbbaa' WHEN '#11223344' THEN '44332211'
      WHEN 'red' THEN '66ddeerr' ELSE 'ff000000' END AS color FROM t""")
def kml_colors(spark, d):
    return derive(spark, d, _COLOR_SQL, "customer").select("k", kml.kml_color("c", "66").alias("color"))


_RING = "concat(x0, ',', y0, ',0 ', x1, ',', y0, ',0 ', x1, ',', y1, ',0 ', x0, ',', y1, ',0 ', x0, ',', y0, ',0')"
_RING_J = "concat('[[[', x0, ',', y0, '],[', x1, ',', y0, '],[', x1, ',', y1, '],[', x0, ',', y1, '],[', x0, ',', y0, ']]]')"


@query("feature_text", ctes("parcels") + f"""
    SELECT code, concat('CAR ', code) AS title,
      concat('<Polygon><outerBoundaryIs><LinearRing><coordinates>', {_RING}, '</coordinates></LinearRing></outerBoundaryIs></Polygon>') AS kml,
      concat('<ExtendedData><Data name="cod_imovel"><value>', code, '</value></Data>', CASE WHEN town IS NULL THEN '' ELSE
        concat('<Data name="town"><value>', town, '</value></Data>') END, '</ExtendedData>') AS data,
      concat('{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":', {_RING_J}, '}},"properties":{{"cod_imovel":', code, ',"town":',
        coalesce('"' || town || '"', 'null'), '}}}}') AS feature FROM parcels""")
def feature_text(spark, d):
    p = fx.parcels(spark, d).select("code", F.col("code").alias("cod_imovel"), "town", "geom")
    cols = ["cod_imovel", "town"]
    return p.select("code", kml.feature_title(cols, F.lit("Imóvel")).alias("title"), kml.to_kml("geom").alias("kml"),
                    kml.extended_data(cols).alias("data"), kml.geojson_feature(cols).alias("feature"))


@query("html_tables", """
    SELECT o_orderkey AS k, concat('<table><tr><td>Num Area:</td><td>', regexp_replace(regexp_replace(translate(format('{:,.4f}', o_totalprice), ',.', '.,'),
      '0{1,4}$', ''), ',$', ''), ' ha</td></tr><tr><td>Data Cadastro:</td><td>', strftime(o_orderdate, '%d/%m/%Y'), '</td></tr>',
      '<tr><td>Status:</td><td>', o_orderstatus, '</td></tr></table>') AS html FROM orders""")
def html_tables(spark, d):
    t = fx.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("num_area"),
        F.to_date("o_orderdate").alias("data_cadastro"), F.col("o_orderstatus").alias("status"))
    return t.select("k", kml.html_table(["id", "num_area", "data_cadastro", "status"], dict(t.dtypes)).alias("html"))


# --- names -----------------------------------------------------------------------------------

_WRITTEN = """SELECT o_orderkey AS k, concat(CASE o_orderkey % 3 WHEN 0 THEN 'sao nação ' WHEN 1 THEN 'SÃO  NACAO-' ELSE 'São Naçao-' END,
    cast(o_custkey % 30 AS varchar(3))) AS written FROM orders"""
_NORM = "trim(regexp_replace(replace(lower(strip_accents({})), '-', ' '), '\\s+', ' ', 'g'))"


@query("places_by_name", ctes("gazetteer", t=_WRITTEN) + f"""
    SELECT t.k, coalesce(g.code, -1) AS code, coalesce(g.name, 'none') AS name
    FROM t LEFT JOIN gazetteer g ON {_NORM.format('t.written')} = {_NORM.format('g.name')}""")
def places_by_name(spark, d):
    out = lookups.join_by_name(derive(spark, d, _WRITTEN, "orders"), "written", fx.gazetteer(spark, d))
    return out.select("k", F.coalesce("place.code", F.lit(-1)).alias("code"), F.coalesce("place.name", F.lit("none")).alias("name"))


_COURTS = """SELECT o_orderkey AS k, concat(cast(o_custkey % 9 AS varchar(2)), ' Vara Cível da Comarca de ', CASE WHEN o_orderkey % 5 = 0
    THEN 'Longe' ELSE concat('Sao Nacao-', cast(o_custkey % 27 AS varchar(3))) END) AS court FROM orders"""
_UP = "upper(trim(regexp_replace(strip_accents({}), '\\s+', ' ', 'g')))"


@query("places_in_court_names", ctes("gazetteer", t=_COURTS) + f"""
    SELECT t.k, coalesce((SELECT min(g.code) FROM gazetteer g WHERE contains({_UP.format('t.court')}, {_UP.format('g.name')})), -1) AS first_code,
      coalesce((SELECT arg_min(g.code, -length(g.name)*10000000 + g.code) FROM gazetteer g
        WHERE contains({_UP.format('t.court')}, {_UP.format('g.name')})), -1) AS longest_code FROM t""")
def places_in_court_names(spark, d):
    gaz = fx.gazetteer(spark, d)
    out = lookups.join_by_contained_name(derive(spark, d, _COURTS, "orders"), "court", gaz, out="a")
    out = lookups.join_by_contained_name(out, "court", gaz, prefer="longest", out="b")
    return out.select("k", F.coalesce("a.code", F.lit(-1)).alias("first_code"), F.coalesce("b.code", F.lit(-1)).alias("longest_code"))


_PREFIX = """SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN concat('São Nação-', cast(o_custkey % 30 AS varchar(3)), ' - Vila ', cast(o_orderkey % 50 AS varchar(3)))
    WHEN 1 THEN concat('Ibirá - Sítio ', cast(o_orderkey % 50 AS varchar(3))) WHEN 2 THEN 'ZEIS Coque' ELSE concat('Outra - Vila ', cast(o_orderkey % 50 AS varchar(3))) END AS name FROM orders"""


@query("prefixed_communities", ctes("gazetteer", t=_PREFIX) + f"""
    SELECT t.k, CASE WHEN NOT contains(t.name, ' - ') THEN 'Recife' WHEN g.name IS NOT NULL THEN g.name
        WHEN {_UP.format("split_part(t.name, ' - ', 1)")} LIKE 'IBIRA%' THEN 'Ibirajuba' ELSE 'Pernambuco' END AS municipio,
      CASE WHEN contains(t.name, ' - ') AND (g.name IS NOT NULL OR {_UP.format("split_part(t.name, ' - ', 1)")} LIKE 'IBIRA%')
        THEN trim(split_part(t.name, ' - ', 2)) ELSE t.name END AS comunidade
    FROM t LEFT JOIN gazetteer g ON {_UP.format("split_part(t.name, ' - ', 1)")} = {_UP.format('g.name')}""")
def prefixed_communities(spark, d):
    out = lookups.split_prefix_municipality(derive(spark, d, _PREFIX, "orders"), "name", fx.gazetteer(spark, d))
    return out.select("k", "municipio", "comunidade")


# --- profiles --------------------------------------------------------------------------------

@query("attribute_profile", """
    SELECT attribute, value, count(*) AS total, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY attribute), 2) AS share
    FROM (SELECT 'o_orderstatus' AS attribute, o_orderstatus AS value FROM orders UNION ALL
          SELECT 'o_orderpriority', o_orderpriority FROM orders) GROUP BY attribute, value""")
def attribute_profile(spark, d):
    return profile(fx.table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("area_by_source", ctes("parcels") + """
    SELECT source, count(*) AS total, cast(sum((x1-x0)*(y1-y0)) AS bigint) AS area FROM parcels GROUP BY source""")
def area_by_source(spark, d):
    p = fx.parcels(spark, d).withColumn("a", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    return area_by(p, ["source"], "a")


@query("top_towns", ctes("parcels") + "SELECT town, count(*) AS total FROM parcels WHERE town IS NOT NULL GROUP BY town ORDER BY total DESC, town LIMIT 8")
def top_towns(spark, d):
    return top_counts(fx.parcels(spark, d).filter(F.col("town").isNotNull()), "town")


