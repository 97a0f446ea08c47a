"""Court jurisdictions and the link from cases to seats."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from .. import fixtures as fx
from ..functions.text import ordered_join
from ..operators import lookups, summaries
from ..plans import cases as plan
from ..plans import jurisdictions as jur
from ..session import materialize, room_for_repeats, shares
from . import ctes, query
from .cases import _COUNTS, NORMAL, normal

# a seat for every 20 municipalities, so that there are more seats and no longer lists on larger data; the second half of a
# seat's municipalities comes in a second row of it
SEAT = 20
_PLACES = f"SELECT s_suppkey AS nk, s_suppkey // {SEAT} AS rk FROM supplier"
# the summary has five seats, whose lists grow with the table
_FIVE = "SELECT s_suppkey AS nk, s_suppkey % 5 AS rk FROM supplier"


def _court_sql(places: str, unit: int) -> tuple[dict, dict]:
    """SQL of both jurisdictions; a seat ``rk`` has the name and code of the municipality ``rk * unit``."""
    members = f"""SELECT cast(rk AS bigint) AS rk, cast(nk AS bigint) AS nk, cast(nk AS bigint) % 2 AS odd, concat('São Nação-', cast(nk AS varchar(9))) AS nm,
    cast(2600000 + nk*100 AS int) AS code, cast(2600000 + rk*{unit}*100 AS int) AS seat_code, concat('São Nação-', cast(rk*{unit} AS varchar(9))) AS seat_nm FROM ({places})"""
    state = dict(
        mem=members,
        tot="SELECT rk, count(*) AS total, string_agg(nm, '; ' ORDER BY odd, nk) AS covered FROM mem GROUP BY rk",
        state="""SELECT m.seat_nm AS comarca_nome, m.seat_code AS comarca_ibge, m.nm AS municipio_nome, m.code AS municipio_ibge,
      m.code = m.seat_code AS eh_sede, CASE WHEN m.code = m.seat_code THEN 'Sede da Comarca' ELSE 'Termo Judiciário (Município Abrangido)' END AS tipo_vinculo,
      t.total AS total_municipios_comarca, t.covered AS municipios_abrangidos FROM mem m JOIN tot t USING (rk)""")
    # a subsection per seat, which also has some municipalities of the next one, so that some lie in two
    federal = dict(
        fsec=f"""SELECT DISTINCT cast(rk AS bigint) AS sec, concat('São Nação-', cast(rk*{unit} AS varchar(9)), CASE WHEN rk = 0 THEN ' (Sede)' ELSE '' END) AS sname,
      concat('São Nação-', cast(rk*{unit} AS varchar(9))) AS seat_nm, cast(2600000 + rk*{unit}*100 AS int) AS seat_code,
      concat(cast(rk + 1 AS varchar(9)), 'ª Vara') AS varas FROM ({places})""",
        fmem="SELECT s.*, m.nk, m.nm, m.code FROM fsec s JOIN mem m ON m.rk = s.sec OR (m.rk = s.sec + 1 AND m.nk % 3 = 0)",
        ftot="SELECT sec, count(*) AS total, string_agg(nm, '; ' ORDER BY nk) AS covered FROM fmem GROUP BY sec",
        federal="""SELECT f.sname AS subsecao_nome, f.seat_nm AS subsecao_sede_nome, f.seat_code AS subsecao_ibge, f.varas, f.nm AS municipio_nome,
      f.code AS municipio_ibge, f.code = f.seat_code AS eh_sede, t.total AS total_municipios_subsecao, t.covered AS municipios_abrangidos, f.sec
      FROM fmem f JOIN ftot t USING (sec)""")
    return state, federal


STATE, FEDERAL = _court_sql(_PLACES, SEAT)


def _places(spark, d, unit=SEAT):
    k = F.col("s_suppkey")
    return fx.table(spark, d, "supplier").select((k % 5 if unit == 1 else F.floor(k / unit)).alias("rk"), k.alias("nk"))


def state_rows(spark, d, unit=SEAT):
    """Court cells as found in documents: seat, members one per line, two rows per seat."""
    n = _places(spark, d, unit)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list("nk")), lambda k: F.concat(
        F.lit(" SAO  NAÇÃO "), k.cast("string"))), "\n")
    rows = n.groupBy("rk", (F.col("nk") % 2).alias("odd")).agg(lines.alias("members"))
    return rows.select((F.col("rk") + F.col("odd") * 10**9).alias("seq"), F.concat(F.lit("são nação "), (F.col("rk") * unit).cast("string")).alias("seat"),
                       F.concat(F.lit("Municípios Abrangidos\n"), "members", F.lit("\nSem Registro")).alias("members"))


def federal_rows(spark, d, unit=SEAT):
    n = _places(spark, d, unit)
    both = n.select(F.col("rk").alias("sec"), "nk").unionAll(
        n.filter("nk % 3 = 0 AND rk > 0").select((F.col("rk") - 1).alias("sec"), "nk"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("nk")), lambda k: F.concat(F.lit("São Nação-"), k.cast("string"))), ", ")
    rows = both.groupBy("sec").agg(text.alias("members"))
    # the last comma is an "e", as people write
    return rows.select(F.col("sec").alias("seq"), F.concat(F.lit("São Nação-"), (F.col("sec") * unit).cast("string"), F.when(
        F.col("sec") == 0, " (Sede)").otherwise("")).alias("seat"), F.concat((F.col("sec") + 1).cast("string"), F.lit("ª Vara")).alias("varas"),
        F.concat(F.regexp_replace("members", r", ([^,]*)$", " e $1"), F.lit(".")).alias("members"))


def state(spark, d, unit=SEAT):
    return jur.state_jurisdiction(state_rows(spark, d, unit), fx.gazetteer(spark, d))


def federal(spark, d, unit=SEAT):
    return jur.federal_jurisdiction(federal_rows(spark, d, unit), fx.gazetteer(spark, d))


def courts(spark, d):
    """Both jurisdictions, worked out once for all that read them."""
    return materialize(state(spark, d), "state"), materialize(federal(spark, d), "federal")


def master(spark, d, st=None, fe=None):
    return jur.unify_jurisdictions(fx.gazetteer(spark, d), state(spark, d) if st is None else st, federal(spark, d) if fe is None else fe)


@query("state_jurisdiction", ctes(**STATE) + "SELECT * FROM state")
def state_jurisdiction(spark, d):
    return state(spark, d).drop("tribunal", "lon", "lat", "seq")


@query("unmatched_members", f"SELECT DISTINCT concat('são nação ', rk*{SEAT}) AS seat, 'Sem Registro' AS member, CASE WHEN nk % 2 = 1 THEN 1000000000 ELSE 0 END + rk AS seq FROM ({_PLACES})")
def unmatched_members(spark, d):
    rows = state_rows(spark, d)
    out = jur.unmatched_members(rows, fx.gazetteer(spark, d), True)
    return out.join(rows.select("seat", F.col("seq").cast("bigint").alias("seq")), "seat").distinct()


@query("federal_jurisdiction", ctes(**STATE, **FEDERAL) + "SELECT * EXCLUDE (sec) FROM federal")
def federal_jurisdiction(spark, d):
    return federal(spark, d).drop("tribunal", "lon", "lat", "seq")


@query("distinct_coverage", ctes(**STATE, **FEDERAL) + """
    SELECT DISTINCT subsecao_nome, subsecao_sede_nome, subsecao_ibge, total_municipios_subsecao, municipios_abrangidos FROM federal""")
def distinct_coverage(spark, d):
    return lookups.distinct_coverage(federal(spark, d))


MASTER = dict(
    fagg="""SELECT municipio_ibge, string_agg(subsecao_nome, '; ' ORDER BY sec) AS subs, string_agg(concat(subsecao_nome, ': ', varas), ' | ' ORDER BY sec) AS vs,
      bool_or(eh_sede) AS fs FROM federal GROUP BY municipio_ibge""",
    master="""SELECT g.code AS municipio_ibge, g.name AS municipio_nome, s.comarca_nome AS tjpe_comarca_nome, s.comarca_ibge AS tjpe_comarca_ibge,
      s.eh_sede AS tjpe_eh_sede, s.tipo_vinculo AS tjpe_tipo_vinculo, s.total_municipios_comarca AS tjpe_total_municipios_comarca,
      s.municipios_abrangidos AS tjpe_comarca_abrangencia, coalesce(f.subs, '') AS jfpe_subsecoes, coalesce(f.vs, '') AS jfpe_varas,
      coalesce(f.fs, false) AS jfpe_eh_sede FROM gazetteer g LEFT JOIN state s ON s.municipio_ibge = g.code LEFT JOIN fagg f ON f.municipio_ibge = g.code""")


@query("unified_jurisdictions", ctes("gazetteer", **STATE, **FEDERAL, **MASTER) + "SELECT * FROM master ORDER BY municipio_nome")
def unified_jurisdictions(spark, d):
    return master(spark, d).drop("lon", "lat")


# rooms point to the subsections of the fixture
def _rooms(unit: int) -> dict[int, str]:
    return {i: f"São Nação-{i % 4 * unit}" + (" (Sede)" if i % 4 == 0 else "") for i in range(1, 30)}


def _enriched_sql(unit: int) -> dict:
    listed = ", ".join(f"({k}, '{v}')" for k, v in _rooms(unit).items())
    return dict(
        sw="SELECT DISTINCT subsecao_nome, lower(split_part(subsecao_nome, ' ', 1)) AS word FROM federal",
        fed=f"""SELECT d.*, coalesce(r.target, (SELECT min(subsecao_nome) FROM sw WHERE contains(lower(d.municipio_nome), word)), 'São Nação-0 (Sede)') AS target
      FROM done d LEFT JOIN (VALUES {listed}) r(room, target) ON r.room = try_cast(nullif(regexp_extract(d.orgao_julgador_nome, '(\\d+)ª\\s*Vara', 1), '') AS int)
      WHERE d.tribunal = 'TRF5'""",
        cov="SELECT DISTINCT subsecao_nome, subsecao_sede_nome, subsecao_ibge, total_municipios_subsecao, municipios_abrangidos FROM federal",
        enriched="""SELECT d.id, d.tribunal, d.categoria_conflito, s.comarca_nome AS comarca_sede_nome, s.comarca_ibge AS comarca_sede_ibge, s.municipios_abrangidos,
        s.total_municipios_comarca AS total_municipios_abrangidos, coalesce(s.total_municipios_comarca > 1, false) AS tem_municipios_filhos,
        CASE WHEN s.comarca_nome IS NOT NULL THEN 'Comarca Estadual (TJPE)' END AS tipo_jurisdicao
      FROM done d LEFT JOIN state s ON s.municipio_ibge = d.municipio_ibge WHERE d.tribunal = 'TJPE'
      UNION ALL SELECT f.id, f.tribunal, f.categoria_conflito, c.subsecao_sede_nome, c.subsecao_ibge, c.municipios_abrangidos, c.total_municipios_subsecao,
        c.subsecao_nome IS NOT NULL, CASE WHEN c.subsecao_nome IS NOT NULL THEN 'Subseção Federal (JFPE)' END FROM fed f LEFT JOIN cov c ON c.subsecao_nome = f.target""")


_ALL = ctes("cases", "gazetteer", **NORMAL, **STATE, **FEDERAL, **MASTER, **_enriched_sql(SEAT))


def _with_rooms(spark, d, st=None, fe=None, unit=SEAT):
    """Enriched cases with the rooms of the fixture in place of the fixed room list."""
    if st is None:
        st, fe = courts(spark, d)
    used = normal(spark, d).select("id", "tribunal", "categoria_conflito", "orgao_julgador_nome", "municipio_ibge", "municipio_nome")
    return plan.enrich_cases(used, st, fe, rooms=_rooms(unit), default="São Nação-0 (Sede)")


_NONE = "coalesce({0}, 'none') AS {0}"


@query("enriched_cases", _ALL + f"""SELECT id, tribunal, {_NONE.format('comarca_sede_nome')}, coalesce(comarca_sede_ibge, -1) AS comarca_sede_ibge,
    {_NONE.format('municipios_abrangidos')}, coalesce(total_municipios_abrangidos, -1) AS total_municipios_abrangidos, tem_municipios_filhos,
    {_NONE.format('tipo_jurisdicao')} FROM enriched""")
def enriched_cases(spark, d):
    none = lambda c: F.coalesce(c, F.lit("none")).alias(c)
    return _with_rooms(spark, d).select(
        "id", "tribunal", none("comarca_sede_nome"), F.coalesce("comarca_sede_ibge", F.lit(-1)).alias("comarca_sede_ibge"),
        none("municipios_abrangidos"), F.coalesce("total_municipios_abrangidos", F.lit(-1)).alias("total_municipios_abrangidos"),
        "tem_municipios_filhos", none("tipo_jurisdicao"))


_CC = ", ".join(f"coalesce(p.{k}, 0) AS {k}" for k in K.CATEGORY_COLUMNS)


_FIVE_STATE, _FIVE_FEDERAL = _court_sql(_FIVE, 1)
_FIVE_ALL = ctes("cases", "gazetteer", **NORMAL, **_FIVE_STATE, **_FIVE_FEDERAL, **MASTER, **_enriched_sql(1))


@query("municipality_summary", _FIVE_ALL + f""", p AS (SELECT comarca_sede_ibge, count(*) AS total, {_COUNTS} FROM enriched WHERE comarca_sede_ibge IS NOT NULL GROUP BY 1)
    SELECT m.*, coalesce(p.total, 0) AS total_processos_comarca, {_CC} FROM master m LEFT JOIN p ON p.comarca_sede_ibge = m.tjpe_comarca_ibge""")
def municipality_summary(spark, d):
    """Five seats, so the list of a seat is a fifth of all municipalities, and all of them have it: the output grows with
    their square. Each list is made once, stays out of what is written, sorted and shuffled on the way, and comes back to
    its municipalities at the end. These are dealt to the tasks in order of seats, so a file has few lists and keeps each once."""
    bare = lambda df, label: materialize(df.withColumn("municipios_abrangidos", F.lit("")), label)
    st, fe = bare(state(spark, d, 1), "state"), bare(federal(spark, d, 1), "federal")
    lists = materialize(st.groupBy(F.col("comarca_nome").alias("_seat")).agg(ordered_join("municipio_nome", "seq").alias("_list")), "lists")
    room_for_repeats(spark, lists.agg(F.sum(F.octet_length("_list"))).first()[0] or 0)
    out = plan.municipality_summary(master(spark, d, st, fe), _with_rooms(spark, d, st, fe, 1)).drop("lon", "lat")
    columns = [F.coalesce("_list", F.lit("")).alias(c) if c == "tjpe_comarca_abrangencia" else c for c in out.columns]
    dealt = out.repartitionByRange(shares(spark), "tjpe_comarca_nome", "municipio_ibge")
    # together the lists have each name once, far less than a single task's share of the output
    return dealt.join(F.broadcast(lists), dealt["tjpe_comarca_nome"] == lists["_seat"], "left").select(columns)


@query("enrichment_counts", _ALL + """SELECT count(*) AS total, count(comarca_sede_nome) AS resolved, count(*) FILTER (tem_municipios_filhos) AS with_daughters FROM enriched""")
def enrichment_counts(spark, d):
    return summaries.verification_counts(_with_rooms(spark, d), {
        "resolved": F.col("comarca_sede_nome").isNotNull(), "with_daughters": F.col("tem_municipios_filhos")})
