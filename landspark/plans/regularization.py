"""Urban regularization and state parcels from placemark files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import constants as K
from ..functions.geometry import area_hectares, number_text, st_point
from ..functions.text import digits_or_null, first_present, format_case_number, jitter, normalize_upper
from ..operators.cleaning import as_multipolygon, drop_parts
from ..operators.lookups import join_by_contained_name, split_prefix_municipality
from ..operators.polygons import make_valid


def _field(name: str):
    return F.trim(F.coalesce(F.try_element_at("data", F.lit(name)), F.lit("")))


def community_polygons(placemarks: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Community areas with municipality, community name and hectares."""
    polygons = placemarks.filter((F.col("shape") == "polygon") & F.col("geom").isNotNull()).withColumn(
        "name", F.coalesce("name", F.lit("Sem Nome")))
    named = split_prefix_municipality(as_multipolygon(make_valid(polygons)), "name", gazetteer)
    return named.select(F.col("name").alias("nome"), "municipio", "comunidade",
                        F.lit(K.REGULARIZATION_KIND).alias("tipo"), F.lit(K.REGULARIZATION_ORIGIN).alias("origem"),
                        area_hectares("geom").alias("area_ha"), "geom")


def regularization_cases(placemarks: DataFrame, gazetteer: DataFrame, default=K.RECIFE) -> DataFrame:
    """Individual cases placed at their city, at a city named by the court, or at the default."""
    rows = placemarks.filter(F.coalesce(F.col("shape") != "polygon", F.lit(True)))
    names = gazetteer.groupBy(normalize_upper("name").alias("_city")).agg(
        F.max_by(F.struct("code", "name", "lon", "lat"), "code").alias("_by_city"))
    rows = rows.withColumns({"_city": normalize_upper(_field("cidade")), "_court": _field("orgao_judiciario")})
    rows = join_by_contained_name(rows.join(names, "_city", "left"), "_court", gazetteer, out="_by_court")
    code, lon, lat, city = default
    place = F.coalesce("_by_city", "_by_court", F.struct(
        F.lit(code).alias("code"), F.lit(city).alias("name"), F.lit(lon).alias("lon"), F.lit(lat).alias("lat")))
    rows = rows.withColumns({"place": place, "numero_processo": format_case_number(F.coalesce("name", F.lit("Sem Nome")))})
    key = F.concat_ws("_", "numero_processo", _field("idmoradia"), number_text("place.lon"), number_text("place.lat"))
    fields = {"idmoradia": "idmoradia", "logradouro": "logradouro", "numero": "numero", "bairro": "bairro",
              "cep": "cep", "observacao": "obs", "data_cadastro": "dt_cadastro"}
    return rows.withColumn("_at", jitter("place.lon", "place.lat", key, K.REGULARIZATION_JITTER_KM)).select(
        "numero_processo", F.col("_court").alias("orgao_judiciario"), F.col("place.name").alias("cidade"),
        F.col("place.code").alias("municipio_ibge"), *[_field(f).alias(n) for n, f in fields.items()],
        st_point("_at.lon", "_at.lat").alias("geom"))


def macro_areas(placemarks: DataFrame, files: DataFrame) -> DataFrame:
    """Discriminated state land: ``files`` gives name, municipality and kind of each source file."""
    kept = drop_parts(placemarks.filter(F.col("geom").isNotNull()), "file")
    return as_multipolygon(make_valid(kept)).join(files, "file").select(
        "nome", "municipio", "tipo", F.col("file").alias("arquivo_fonte"), area_hectares("geom").alias("area_ha"), "geom")


def state_parcels(placemarks: DataFrame, files: DataFrame) -> DataFrame:
    """Smallholder parcels; ``files`` gives the municipality of each source file."""
    rows = as_multipolygon(make_valid(placemarks.filter(F.col("geom").isNotNull()))).join(files, "file")
    plain = {"num_lote": "NUM_LOTE", "decreto": "DECRETO", "matricula": "MATRICULA", "livro": "LIVRO",
             "folha": "FOLHA", "registro": "REGISTRO"}
    return rows.select(
        *[_field(f).alias(n) for n, f in plain.items()],
        first_present(_field("COMARCA"), "municipio").alias("comarca"), "municipio",
        digits_or_null(_field("CD_MUN")).alias("municipio_ibge"), F.lit(K.PARCEL_KIND).alias("tipo"),
        F.lit(K.PARCEL_ORIGIN).alias("origem"), area_hectares("geom").alias("area_ha"), "geom")
