"""Eviction reports of communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import constants as K
from ..functions.geometry import st_point
from ..functions.text import int_or_zero, jitter, join_or_default, slug_title, taxonomy_list
from ..operators.cleaning import fix_point_axes, state_case_flag, within_bounds
from ..operators.overlap import point_in_polygon_join
from ..operators.polygons import subdivide
from ..operators.rows import occurrence_index


def filter_state_cases(df: DataFrame, boundary: DataFrame | None = None, uf: str = "pe", cell: float = 0.25,
                       key: str = "seq", max_vertices: int = 64) -> DataFrame:
    """Reports of the state: by their tags, and by position where the tags do not tell. ``key`` is unique.
    The boundary is cut into pieces of few vertices before points are tested against it."""
    marked = df.withColumn("_own", state_case_flag(F.col("tax.uf"), F.col("tax.municipio"), uf))
    sure = marked.filter("_own").drop("_own")
    if boundary is None:
        return sure
    open_ = marked.filter(F.col("_own").isNull()).drop("_own")
    spots = open_.select(key, st_point(F.col("meta.localizacao_lng").try_cast("double"),
                                       F.col("meta.localizacao_lat").try_cast("double")).alias("geom"))
    pieces = subdivide(boundary.select("geom"), "geom", max_vertices)
    found = point_in_polygon_join(spots.filter(F.col("geom").isNotNull()), pieces, cell)
    found = found.select(F.col("l_" + key).alias(key)).distinct()
    return sure.unionByName(open_.join(found, key, "left_semi"))


def _listed(key: str):
    return join_or_default(F.col("meta")[key], present=F.map_contains_key("meta", key))


def clean_evictions(df: DataFrame) -> DataFrame:
    """Readable rows with repaired coordinates; coincident places are moved apart by a jitter."""
    at = df.withColumns({"lat": F.col("meta.localizacao_lat").try_cast("double"),
                         "lon": F.col("meta.localizacao_lng").try_cast("double")})
    at = within_bounds(fix_point_axes(at.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())), "lon", "lat")
    at = occurrence_index(at, {"lat": F.round("lat", 5), "lon": F.round("lon", 5)}, "seq")
    title = F.trim(F.coalesce("post_title", F.lit("")))
    key = F.concat_ws("_", "ID", title, F.col("occurrence").cast("string"))
    moved = F.when(F.col("occurrence") > 0, jitter("lon", "lat", key, K.EVICTION_JITTER_KM)).otherwise(
        F.struct("lon", "lat"))
    families = {n: int_or_zero(F.col(f"meta.numero_de_familias_{c}")) for n, c in (
        ("familias_ameacadas", "ameacadas"), ("familias_despejadas", "despejadas"),
        ("familias_suspensas", "suspensao_definitiva"))}
    total = sum(families.values(), F.lit(0))
    town = F.coalesce(F.get("tax.municipio", F.lit(0)), F.lit("pe"))
    return at.withColumn("_at", moved).select(
        F.col("ID").cast("bigint").alias("conflito_id"), title.alias("nome_comunidade"),
        F.trim(F.coalesce("post_name", F.lit(""))).alias("slug"), slug_title(town).alias("municipio"),
        F.lit("PE").alias("uf"), *[c.alias(n) for n, c in families.items()], total.alias("total_familias"),
        taxonomy_list("tax.status_conflito", K.NOT_INFORMED).alias("status_conflito"),
        taxonomy_list("tax.causa_do_conflito", K.DEFAULT_CAUSE).alias("causa_conflito"),
        _listed("acompanhamento_juridico_do_caso").alias("acompanhamento_juridico"),
        _listed("agentes_promotores_publicos_ou_privados").alias("agente_promotor"),
        F.coalesce("meta.descricao", F.lit("")).alias("descricao"), F.col("post_date").alias("data_registro"),
        F.col("post_modified").alias("data_atualizacao"), F.col("lat").alias("lat_original"),
        F.col("lon").alias("lon_original"), "occurrence", st_point("_at.lon", "_at.lat").alias("geom"))


def evictions(df: DataFrame, boundary: DataFrame | None = None, cell: float = 0.25) -> DataFrame:
    return clean_evictions(filter_state_cases(df, boundary, cell=cell))
