"""Court jurisdictions: which seat covers which municipality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions.text import ordered_join, role_label, split_enumeration
from ..operators.lookups import join_by_name
from ..operators.rows import last_per_key
from ..session import materialize


def parse_coverage(df: DataFrame, lines: bool) -> DataFrame:
    """``seq, seat, pos, member`` from rows holding a seat and the text of its members: one per line,
    or an enumeration with commas and a conjunction."""
    seat = F.trim(F.regexp_replace("seat", r"\s+", " "))
    items = (F.filter(F.transform(F.split("members", "\n"), lambda m: F.trim(m)), lambda m: m != "")
             if lines else split_enumeration("members"))
    others = [c for c in df.columns if c not in ("seat", "members")]
    return (df.filter((seat != "") & (F.upper(seat) != "COMARCA"))
            .select(*others, seat.alias("seat"), F.posexplode(items).alias("pos", "member"))
            .filter(F.upper("member") != "MUNICÍPIOS ABRANGIDOS"))


def merge_coverage(members: DataFrame, key: str) -> DataFrame:
    """Size and ordered list of the members of each seat, rows of the same seat taken together."""
    order = F.struct("seq", "pos")
    return members.groupBy(key).agg(
        F.count(F.lit(1)).cast("int").alias("total"), ordered_join("member_name", order).alias("covered"),
        F.min_by("seat_code", order).alias("seat_code"), F.min("seq").alias("first_seq"))


def _resolved(rows: DataFrame, seat: Column, gazetteer: DataFrame, lines: bool) -> DataFrame:
    parsed = parse_coverage(rows, lines).withColumn("_seat", seat)
    with_seat = join_by_name(parsed, "_seat", gazetteer, "_seat_place")
    # members without a gazetteer entry are left out; unmatched_members lists them
    both = join_by_name(with_seat, "member", gazetteer, "_place", how="inner")
    return both.select(
        *[c for c in rows.columns if c not in ("seat", "members")], "seat", "pos",
        F.coalesce("_seat_place.name", "_seat").alias("seat_name"), F.col("_seat_place.code").alias("seat_code"),
        F.col("_place.name").alias("member_name"), F.col("_place.code").alias("member_code"),
        F.col("_place.lon").alias("lon"), F.col("_place.lat").alias("lat"))


def unmatched_members(rows: DataFrame, gazetteer: DataFrame, lines: bool) -> DataFrame:
    """Member names the gazetteer does not know."""
    found = join_by_name(parse_coverage(rows, lines), "member", gazetteer, "_place")
    return found.filter(F.col("_place").isNull()).select("seat", "member")


def state_jurisdiction(rows: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Municipalities of the state court seats from ``seq, seat, members`` (one member per line)."""
    m = materialize(_resolved(rows, F.col("seat"), gazetteer, True), "members")  # names are matched once
    merged = merge_coverage(m, "seat_name").withColumnRenamed("seat_code", "_code")
    is_seat = F.coalesce(F.col("member_code") == F.col("_code"), F.lit(False))
    return m.join(merged, "seat_name").select(
        F.lit(K.STATE_COURT).alias("tribunal"), F.col("seat_name").alias("comarca_nome"),
        F.col("_code").alias("comarca_ibge"), F.col("member_name").alias("municipio_nome"),
        F.col("member_code").alias("municipio_ibge"), is_seat.alias("eh_sede"),
        role_label(is_seat).alias("tipo_vinculo"), F.col("total").alias("total_municipios_comarca"),
        F.col("covered").alias("municipios_abrangidos"), "lon", "lat",
        # reading order: seats as first met, their rows and lines after that
        F.struct("first_seq", "seq", "pos").alias("seq"))


def federal_jurisdiction(rows: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Municipalities of the federal subsections from ``seq, seat, varas, members`` (enumeration)."""
    seat = F.trim(F.replace(F.col("seat"), F.lit(" (Sede)"), F.lit("")))
    m = materialize(_resolved(rows, seat, gazetteer, False), "members")
    merged = merge_coverage(m, "seq").drop("seat_code", "first_seq")
    is_seat = F.coalesce(F.col("member_code") == F.col("seat_code"), F.lit(False))
    return m.join(merged, "seq").select(
        F.lit("TRF5/JFPE").alias("tribunal"), F.col("seat").alias("subsecao_nome"),
        F.col("seat_name").alias("subsecao_sede_nome"), F.col("seat_code").alias("subsecao_ibge"), "varas",
        F.col("member_name").alias("municipio_nome"), F.col("member_code").alias("municipio_ibge"),
        is_seat.alias("eh_sede"), F.col("total").alias("total_municipios_subsecao"),
        F.col("covered").alias("municipios_abrangidos"), "lon", "lat", F.struct("seq", "pos").alias("seq"))


def unify_jurisdictions(gazetteer: DataFrame, state: DataFrame, federal: DataFrame) -> DataFrame:
    """One row per municipality; of several state rows the last counts, federal rows are listed."""
    s = last_per_key(state, ["municipio_ibge"], ["seq"]).select(
        F.col("municipio_ibge").alias("_s"), "comarca_nome", "comarca_ibge", "eh_sede", "tipo_vinculo",
        "total_municipios_comarca", "municipios_abrangidos")
    f = federal.groupBy(F.col("municipio_ibge").alias("_f")).agg(
        ordered_join("subsecao_nome", "seq").alias("jfpe_subsecoes"),
        ordered_join(F.concat_ws(": ", "subsecao_nome", "varas"), "seq", " | ").alias("jfpe_varas"),
        F.bool_or("eh_sede").alias("jfpe_eh_sede"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return (gazetteer.join(s, gazetteer["code"] == s["_s"], "left").join(f, gazetteer["code"] == f["_f"], "left")
            .select(F.col("code").alias("municipio_ibge"), F.col("name").alias("municipio_nome"), "lon", "lat",
                    text("comarca_nome").alias("tjpe_comarca_nome"), F.col("comarca_ibge").alias("tjpe_comarca_ibge"),
                    F.coalesce("eh_sede", F.lit(False)).alias("tjpe_eh_sede"),
                    text("tipo_vinculo").alias("tjpe_tipo_vinculo"),
                    F.coalesce("total_municipios_comarca", F.lit(1)).alias("tjpe_total_municipios_comarca"),
                    text("municipios_abrangidos").alias("tjpe_comarca_abrangencia"),
                    text("jfpe_subsecoes").alias("jfpe_subsecoes"), text("jfpe_varas").alias("jfpe_varas"),
                    F.coalesce("jfpe_eh_sede", F.lit(False)).alias("jfpe_eh_sede"))
            .orderBy("municipio_nome"))
