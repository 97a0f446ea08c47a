"""Court cases: normalise, locate, link to their seat, sum up per municipality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .. import constants as K
from ..functions.text import (case_url, classify_case, format_case_number, has_daughters, jitter, parse_court_date,
                              positive_code, present_codes, present_names, subjects_text)
from ..operators.lookups import assign_federal_seat, assign_state_seat, fallback_seats, join_by_code, with_fallback
from ..operators.rows import first_per_key, last_movement, movement_count
from ..operators.summaries import category_columns
from ..session import materialize


def _resolve_origin(df: DataFrame, federal: str) -> DataFrame:
    """Municipality code and name of a case before the gazetteer is looked at. Federal cases and
    those without a code go by the last four digits of the case number."""
    digits = F.regexp_replace("numero_processo", r"\D", "")
    section = F.when(F.length(digits) >= 4, F.right(digits, F.lit(4))).otherwise("8300")
    codes = F.create_map(*[F.lit(v) for k, (c, n) in K.SUBSECTIONS.items() for v in (k, c)])
    names = F.create_map(*[F.lit(v) for k, (c, n) in K.SUBSECTIONS.items() for v in (k, n)])
    own = positive_code("orgaoJulgador.codigoMunicipioIBGE")
    by_number = (F.col("tribunal") == federal) | own.isNull()
    code, name = K.DEFAULT_CITY
    return df.withColumns({
        "_by_number": by_number,
        "municipio_ibge": F.when(by_number, F.coalesce(F.try_element_at(codes, section), F.lit(code)))
                           .otherwise(own),
        "_name": F.when(by_number, F.coalesce(F.try_element_at(names, section), F.lit(name)))
                  .otherwise(K.STATE_NAME)})


def resolve_origin(df: DataFrame, gazetteer: DataFrame, federal: str = K.FEDERAL_COURT) -> DataFrame:
    """Add ``municipio_ibge``, ``municipio_nome`` and the seat coordinates ``base_lon, base_lat``."""
    placed = join_by_code(_resolve_origin(df, federal), "municipio_ibge", gazetteer)
    name = F.when(F.col("_by_number") & (F.col("_name") != K.STATE_NAME), F.col("_name")).otherwise(
        F.coalesce("place.name", "_name"))
    _, lon, lat, _ = K.FALLBACK_SEATS[0]
    return placed.withColumns({
        "municipio_nome": name, "base_lon": F.coalesce("place.lon", F.lit(lon)),
        "base_lat": F.coalesce("place.lat", F.lit(lat))}).drop("_by_number", "_name", "place")


def normalize_cases(raw: DataFrame, gazetteer: DataFrame, seq: str = "seq", fallback: bool = True,
                    federal: str = K.FEDERAL_COURT) -> DataFrame:
    """One row per case from raw court documents; of equal ids the first in ``seq`` order stays."""
    if fallback:
        gazetteer = with_fallback(gazetteer.select("code", "lon", "lat", "name"),
                                  fallback_seats(raw.sparkSession), "code")
    number = F.coalesce(F.nullif("numeroProcesso", F.lit("")), F.lit("N/A"))
    keyed = raw.withColumn("_id", F.coalesce(F.nullif("id", F.lit("")),
                                             F.concat_ws("_", "tribunal_source", number)))
    once = first_per_key(keyed, ["_id"], [seq])
    last = last_movement("movimentos")
    subjects = F.col("assuntos")
    base = once.withColumns({
        "numero_processo": format_case_number(number), "tribunal": F.col("tribunal_source")})
    placed = resolve_origin(base, gazetteer, federal)
    moved = jitter("base_lon", "base_lat", "_id", K.CASE_JITTER_KM)
    return placed.withColumn("_at", moved).select(
        F.col("_id").alias("id"), "numero_processo", "tribunal",
        F.coalesce(F.nullif("grau", F.lit("")), F.lit("G1")).alias("grau"),
        parse_court_date("dataAjuizamento").alias("data_ajuizamento"),
        classify_case(present_codes(subjects), F.col("classe.codigo"), present_names(subjects),
                      F.col("classe.nome")).alias("categoria_conflito"),
        F.col("classe.codigo").alias("classe_codigo"), F.col("classe.nome").alias("classe_nome"),
        present_codes(subjects).alias("assuntos_codigos"), present_names(subjects).alias("assuntos_nomes"),
        subjects_text(subjects).alias("assuntos_str"),
        F.col("orgaoJulgador.codigo").alias("orgao_julgador_codigo"),
        F.coalesce(F.nullif("orgaoJulgador.nome", F.lit("")), F.lit(K.MISSING_COURT)).alias("orgao_julgador_nome"),
        "municipio_ibge", "municipio_nome", last["nome"].alias("ultimo_movimento"),
        parse_court_date(last["dataHora"]).alias("data_ultimo_movimento"),
        movement_count("movimentos").alias("total_movimentos"), case_url("tribunal").alias("url_consulta_publica"),
        F.col("_at.lon").alias("lon"), F.col("_at.lat").alias("lat"))


def enrich_cases(cases: DataFrame, state: DataFrame, federal: DataFrame, state_court: str = K.STATE_COURT,
                 federal_court: str = K.FEDERAL_COURT, rooms: dict[int, str] = K.ROOM_SUBSECTIONS,
                 default: str = K.DEFAULT_SUBSECTION) -> DataFrame:
    """Add seat, covered municipalities and kind of jurisdiction to each case.

    Cases are worked out once. Seats are looked up once for each court, municipality and chamber, of which there are far
    fewer than cases, so the seats of a town with very many cases meet them in one join only.
    """
    cases = materialize(cases, "cases")
    of = ["tribunal", "municipio_ibge", "municipio_nome", "orgao_julgador_nome"]
    places = materialize(cases.groupBy(*of).agg(F.lit(1).alias("_n")), "places").drop("_n")
    s = assign_state_seat(places.filter(F.col("tribunal") == state_court), state).withColumn("_kind", F.lit(K.STATE_JURISDICTION))
    f = assign_federal_seat(places.filter(F.col("tribunal") == federal_court), federal, rooms, default).withColumn("_kind", F.lit(K.FEDERAL_JURISDICTION))
    seats = materialize(s.unionByName(f).filter(F.col("seat").isNotNull()), "seats").select(*[F.col(c).alias("_" + c) for c in of], "seat", "_kind")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col("_" + c)) for c in of])
    both = cases.join(seats, same, "left")
    found = F.col("seat").isNotNull()
    return both.select(
        *cases.columns, F.col("seat.sede_nome").alias("comarca_sede_nome"),
        F.col("seat.sede_ibge").alias("comarca_sede_ibge"), F.col("seat.municipios_abrangidos"),
        F.col("seat.total").cast("int").alias("total_municipios_abrangidos"),
        # a federal subsection always covers other municipalities
        F.when(found & (F.col("tribunal") == federal_court), True)
        .otherwise(F.coalesce(has_daughters("seat.total"), F.lit(False))).alias("tem_municipios_filhos"),
        F.when(found, F.col("_kind")).alias("tipo_jurisdicao"))


def municipality_summary(master: DataFrame, cases: DataFrame) -> DataFrame:
    """Every municipality with the case counts of its seat. The counts repeat for all municipalities
    of a seat and must not be added up."""
    counts = (cases.filter(F.col("comarca_sede_ibge").isNotNull()).groupBy("comarca_sede_ibge")
              .agg(F.count(F.lit(1)).alias("total_processos_comarca"), *category_columns())
              .withColumnRenamed("comarca_sede_ibge", "_seat"))
    numbers = [c for c in counts.columns if c != "_seat"]
    joined = master.join(counts, master["tjpe_comarca_ibge"] == counts["_seat"], "left").drop("_seat")
    return joined.na.fill(0, numbers)
