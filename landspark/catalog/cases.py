"""Court cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from .. import fixtures as fx
from ..operators import summaries
from ..operators.rows import page_after
from ..plans import cases as plan
from ..sources.files import search_cases as search
from . import ctes, query
from .text import _H, _H8, _LIMBS, sql_case  # noqa: F401

_NAMES = ["Usucapião Rural", "Direito Agrário", "Comunidade Quilombola", "Imissão na posse", "Dívida ativa", "Outros", None, ""]
_CLASSES = {1707: "Reintegração / Manutenção de Posse", 49: "Usucapião", 91: "Desapropriação Imóvel Rural", 34: "Demarcação", 65: "Ação Civil Pública"}
_CODES = [11412, 10124, 12031, 10094, 10100, 10444, 10500, 7640, 5995, 9985, 99999, 0, 88888]

_DAY = ("concat(cast(year(l_shipdate) AS varchar(4)), lpad(cast(month(l_shipdate) AS varchar(2)), 2, '0'), "
        "lpad(cast(day(l_shipdate) AS varchar(2)), 2, '0'))")
# line numbers repeat within an order, so the position goes on with part, supplier and day
SUBJECTS = f"""SELECT l_orderkey AS k, concat(lpad(cast(l_linenumber AS varchar(4)), 4, '0'), lpad(cast(l_partkey AS varchar(12)), 12, '0'),
    lpad(cast(l_suppkey AS varchar(12)), 12, '0'), {_DAY}) AS pos, CASE WHEN l_partkey % 3 = 0 THEN {sql_case('l_suppkey % 13', _CODES)} ELSE 77777 END AS codigo,
    {sql_case('l_partkey % 8', _NAMES)} AS nome, {_DAY} AS day FROM lineitem"""


def documents(spark, d):
    """Nested court documents: flat cases with their subjects and movements in line order."""
    lines = spark.sql(SUBJECTS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=fx.table(spark, d, "lineitem"))
    rows = F.array_sort(F.collect_list(F.struct("pos", "codigo", "nome", "day")))
    lists = lines.groupBy("k").agg(rows.alias("r")).select(
        "k", F.transform("r", lambda r: F.struct(r["codigo"].cast("int").alias("codigo"), r["nome"].alias("nome"))).alias("assuntos"),
        F.transform("r", lambda r: F.struct(r["nome"].alias("nome"), r["day"].alias("dataHora"))).alias("movimentos"))
    names = F.create_map(*[F.lit(v) for kv in _CLASSES.items() for v in kv])
    c = fx.cases(spark, d).join(lists, F.col("seq") == F.col("k"), "left")
    filed = F.concat(F.substring("raw_number", 10, 4), F.lpad((F.col("seq") % 12 + 1).cast("string"), 2, "0"), F.lit("15"))
    return c.select(
        "seq", F.col("id").cast("string").alias("id"), F.col("raw_number").alias("numeroProcesso"),
        F.when(F.col("seq") % 4 == 0, F.lit(None)).otherwise(F.lit("G2")).alias("grau"), filed.alias("dataAjuizamento"),
        F.struct(F.col("class_code").cast("int").alias("codigo"), names[F.col("class_code").cast("int")].alias("nome")).alias("classe"),
        "assuntos", F.struct((F.col("seq") % 500).cast("int").alias("codigo"), F.col("chamber").alias("nome"),
                             F.col("muni_code").cast("string").alias("codigoMunicipioIBGE")).alias("orgaoJulgador"),
        "movimentos", F.col("court").alias("tribunal_source"))


def _rule_sql() -> str:
    out = []
    for category, subjects, classes, words in K.CASE_RULES:
        hit = [f"list_has_any(codes, [{', '.join(map(str, subjects))}])"] + [f"contains(txt, '{w}')" for w in words]
        if classes:
            hit.append(f"class_code IN ({', '.join(map(str, classes))})")
        out.append(f"WHEN {' OR '.join(hit)} THEN '{category}'")
    return f"CASE {' '.join(out)} ELSE '{K.OTHER_CATEGORY}' END"


_CLASS_SQL = "CASE class_code " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _CLASSES.items()) + " END"
_SECTIONS = ", ".join(f"('{k}', {c}, '{n}')" for k, (c, n) in K.SUBSECTIONS.items())
_SEATS = ", ".join(f"({c}, {x}, {y}, '{n}')" for c, x, y, n in K.FALLBACK_SEATS)
NORMAL = dict(
    subj=SUBJECTS,
    lists="""SELECT k, coalesce(list(codigo ORDER BY pos) FILTER (codigo IS NOT NULL AND codigo <> 0), []) AS codes,
      coalesce(list(nome ORDER BY pos) FILTER (nome IS NOT NULL AND nome <> ''), []) AS names,
      string_agg(concat(coalesce(cast(codigo AS varchar), 'None'), ': ', coalesce(nome, 'None')), '; ' ORDER BY pos) AS subjects,
      count(*) AS moves, arg_max(coalesce(nome, 'null'), pos) AS last_move, arg_max(day, pos) AS last_day FROM subj GROUP BY k""",
    firsts="SELECT * FROM cases WHERE seq IN (SELECT min(seq) FROM cases GROUP BY id)",
    seats=f"""SELECT code, lon, lat, name FROM gazetteer UNION ALL SELECT * FROM (VALUES {_SEATS}) v(code, lon, lat, name)
      WHERE code NOT IN (SELECT code FROM gazetteer)""",
    origin=f"""SELECT f.*, right(raw_number, 4) AS sec, (court = 'TRF5' OR muni_code IS NULL) AS by_number, s.code AS scode, s.name AS sname
      FROM firsts f LEFT JOIN (VALUES {_SECTIONS}) s(sec, code, name) ON s.sec = right(f.raw_number, 4)""",
    placed="""SELECT o.*, CASE WHEN by_number THEN coalesce(scode, 2611606) ELSE muni_code END AS mcode,
      CASE WHEN by_number THEN coalesce(sname, 'Recife (JFPE)') END AS mname FROM origin o""",
    located="""SELECT p.*, coalesce(p.mname, g.name, 'Pernambuco') AS municipio, coalesce(g.lon, -34.8770) AS blon, coalesce(g.lat, -8.0578) AS blat
      FROM placed p LEFT JOIN seats g ON g.code = p.mcode""",
    normal=f"""SELECT l.*, li.codes, li.names, li.subjects, li.moves, li.last_move, li.last_day, {_CLASS_SQL} AS class_name,
      lower(concat(coalesce(array_to_string(li.names, ' '), ''), ' ', coalesce({_CLASS_SQL}, ''))) AS txt
      FROM located l LEFT JOIN lists li ON li.k = l.seq""",
    done=f"""SELECT cast(id AS varchar) AS id, court AS tribunal, {_rule_sql()} AS categoria_conflito, chamber AS orgao_julgador_nome,
      mcode AS municipio_ibge, municipio AS municipio_nome, * EXCLUDE (id) FROM normal""")
_ANGLE = _LIMBS.format("md5(id)", 360)
_DIST = _LIMBS.format("lpad(substr(md5(id), 1, 30), 32, '0')", 1000)


def normal(spark, d):
    return plan.normalize_cases(documents(spark, d), fx.gazetteer(spark, d))


@query("normalized_cases", ctes("cases", "gazetteer", **NORMAL) + f"""
    SELECT id, concat(substr(raw_number,1,7),'-',substr(raw_number,8,2),'.',substr(raw_number,10,4),'.',substr(raw_number,14,1),'.',
        substr(raw_number,15,2),'.',substr(raw_number,17,4)) AS numero_processo, tribunal, CASE WHEN seq % 4 = 0 THEN 'G1' ELSE 'G2' END AS grau,
      concat(substr(raw_number, 10, 4), '-', lpad(cast(seq % 12 + 1 AS varchar), 2, '0'), '-15') AS filed, categoria_conflito,
      class_code AS classe_codigo, class_name AS classe_nome, coalesce(array_to_string(codes, ','), '') AS codes,
      coalesce(array_to_string(names, '|'), '') AS names, coalesce(subjects, '') AS assuntos_str, orgao_julgador_nome, municipio_ibge, municipio_nome,
      coalesce(last_move, 'null') AS ultimo, coalesce(last_day, 'none') AS last_day, coalesce(moves, 0) AS total_movimentos,
      round(blon + ({_DIST})/1000.0*0.8*cos(({_ANGLE})*pi()/180.0)/(111.0*cos(radians(blat))), 8) AS lon,
      round(blat + ({_DIST})/1000.0*0.8*sin(({_ANGLE})*pi()/180.0)/111.0, 8) AS lat FROM done""")
def normalized_cases(spark, d):
    n = normal(spark, d)
    return n.select(
        "id", "numero_processo", "tribunal", "grau", F.date_format("data_ajuizamento", "yyyy-MM-dd").alias("filed"), "categoria_conflito",
        "classe_codigo", "classe_nome", F.array_join(F.coalesce("assuntos_codigos", F.array().cast("array<int>")), ",").alias("codes"),
        F.coalesce(F.array_join("assuntos_nomes", "|"), F.lit("")).alias("names"), "assuntos_str", "orgao_julgador_nome", "municipio_ibge",
        "municipio_nome", F.coalesce("ultimo_movimento", F.lit("null")).alias("ultimo"),
        F.coalesce(F.date_format("data_ultimo_movimento", "yyyyMMdd"), F.lit("none")).alias("last_day"), "total_movimentos",
        F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"))


@query("found_cases", ctes("cases", subj=SUBJECTS) + f"""
    SELECT c.seq FROM cases c WHERE (class_code IN ({', '.join(map(str, [34, 65]))})
      OR EXISTS (SELECT 1 FROM subj s WHERE s.k = c.seq AND s.codigo IN (11412, 10124))) AND raw_number LIKE '%178301%'""")
def found_cases(spark, d):
    return search(documents(spark, d), [11412, 10124], [34, 65], "%178301%").select("seq")


@query("case_page", ctes("cases", f="SELECT seq, cast(substr(raw_number, 10, 4) AS int) AS filed FROM cases") + """
    SELECT seq, filed FROM f WHERE filed < 1996 OR (filed = 1996 AND seq > 1000) ORDER BY filed DESC, seq LIMIT 100""")
def case_page(spark, d):
    c = fx.cases(spark, d).select("seq", F.substring("raw_number", 10, 4).cast("int").alias("filed"))
    return page_after(c, "filed", "seq", 100, (1996, 1000))


_COUNTS = ", ".join(f"count(*) FILTER (categoria_conflito = '{v}') AS {k}" for k, v in K.CATEGORY_COLUMNS.items())


@query("municipality_rollup", ctes("cases", "gazetteer", **NORMAL) + f"""
    SELECT municipio_ibge, municipio_nome, count(*) AS total_processos, {_COUNTS},
      round(avg(blon + ({_DIST})/1000.0*0.8*cos(({_ANGLE})*pi()/180.0)/(111.0*cos(radians(blat)))), 6) AS lon,
      round(avg(blat + ({_DIST})/1000.0*0.8*sin(({_ANGLE})*pi()/180.0)/111.0), 6) AS lat FROM done GROUP BY municipio_ibge, municipio_nome""")
def municipality_rollup(spark, d):
    out = summaries.municipality_rollup(normal(spark, d))
    return out.withColumns({"lon": F.round("lon", 6), "lat": F.round("lat", 6)})


@query("court_categories", ctes("cases", "gazetteer", **NORMAL) + """
    SELECT tribunal, categoria_conflito, count(*) AS total FROM done GROUP BY ALL ORDER BY tribunal, total DESC""")
def court_categories(spark, d):
    return summaries.court_category_counts(normal(spark, d))


@query("category_counts", ctes("cases", "gazetteer", **NORMAL) + f"SELECT tribunal, count(*) AS total_processos, {_COUNTS} FROM done GROUP BY tribunal")
def category_counts(spark, d):
    return summaries.category_counts(normal(spark, d), ["tribunal"])
