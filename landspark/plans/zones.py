"""Conflict zones: where properties overlap protected or traditional territories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions.geometry import st_multi, st_point, st_point_on_surface
from ..operators.cluster import dbscan
from ..operators.dissolve import dissolve
from ..operators.overlap import overlap_join
from ..operators.rowid import with_row_id
from ..functions.text import compose_label, distinct_join
from ..session import materialize

REGISTRY = "area_imovel_1"
FEDERAL_UNITS = "limiteucsfederais_a"
SOURCE_LENGTH = 50  # of source names as published; grouping uses the whole name


def property_layer(df: DataFrame, source: str, name, code, key=None) -> DataFrame:
    """Bring a property layer to ``key, name, code, source, geom``."""
    code = F.col(code) if isinstance(code, str) else code
    name = F.col(name) if isinstance(name, str) else name
    key = code if key is None else (F.col(key) if isinstance(key, str) else key)
    return df.select(key.alias("key"), name.alias("name"), code.cast("string").alias("code"),
                     F.lit(source).alias("source"), "geom")


def registry_layer(df: DataFrame, source: str = REGISTRY, town: str = "municipio",
                   code: str = "cod_imovel", key=None) -> DataFrame:
    """The environmental registry has no property name; it is shown by its municipality."""
    label = compose_label("Imóvel CAR ({})", F.coalesce(town, F.lit("PE")), max_len=150)
    return property_layer(df, source, label, code, key)


def territory_layer(df: DataFrame, source: str, name, key) -> DataFrame:
    name = F.col(name) if isinstance(name, str) else name
    return df.select(F.col(key).alias("key"), name.alias("name"),
                     F.lit(source).alias("source"), "geom")


def embargo_label(number: str = "numero_emb", person: str = "autuado") -> Column:
    return compose_label("Embargo {} ({})", F.coalesce(number, F.lit("S/N")),
                         F.coalesce(person, F.lit("N/D")), max_len=200)


def zone_overlaps(properties: DataFrame, territories: DataFrame, cell: float,
                  include_missing: bool = False, rectangles: bool = False,
                  registry: str = REGISTRY, units: str = FEDERAL_UNITS,
                  max_vertices: int | None = None) -> DataFrame:
    """Property-territory pairs with a shared area.

    The combination of registry properties with federal units is left out unless
    ``include_missing`` is set, as the published zones do.
    """
    skip = None if include_missing else (
        (F.col("l_source") == registry) & (F.col("r_source") == units))
    pairs = overlap_join(properties, territories, cell, "key", "key", rectangles=rectangles,
                         max_vertices=max_vertices, skip=skip)
    return pairs.select(
        F.col("l_name").alias("property_name"), F.col("l_code").alias("property_code"),
        F.left("l_source", F.lit(SOURCE_LENGTH)).alias("property_source"), F.col("r_name").alias("traditional_name"),
        F.col("r_source").alias("traditional_source"), "geom", "area")


def conflict_zones(properties: DataFrame, territories: DataFrame, cell: float,
                   eps: float = K.CLUSTER_EPS, min_points: int = K.CLUSTER_MIN_POINTS,
                   include_missing: bool = False, rectangles: bool = False,
                   zone_cell: float | None = None, **names) -> DataFrame:
    """Overlaps clustered within each territory name and merged into zones.

    Clustering looks at the territory name only; a zone is one cluster of one source. Besides the
    three separately sorted lists, ``properties`` keeps name, code and source of each property
    together.
    """
    pairs = materialize(zone_overlaps(properties, territories, cell, include_missing, rectangles,
                                      **names)
                        .withColumn("member", F.monotonically_increasing_id()), "overlaps")
    marked = materialize(dbscan(pairs, ["traditional_name"], eps, min_points, "member",
                                cell=zone_cell, rectangles=rectangles), "clusters")
    # with min_points above 1 the members outside all clusters of a name form one zone
    marked = marked.withColumn("cluster", F.coalesce(
        F.col("cluster").cast("string"), F.concat(F.lit("none "), "traditional_name"), F.lit("none")))
    keys = ["cluster", "traditional_source"]
    lists = marked.groupBy(*keys).agg(
        F.first("traditional_name").alias("traditional_name"),
        distinct_join("property_name").alias("property_name"),
        distinct_join("property_code").alias("property_code"),
        distinct_join("property_source").alias("property_source"),
        F.array_sort(F.collect_set(F.struct("property_name", "property_code", "property_source")))
        .alias("properties"),
        F.count(F.lit(1)).alias("overlaps"))
    merged = dissolve(marked, keys, zone_cell or cell, rectangles=rectangles)
    zones = materialize(lists.join(merged, keys).withColumn("geom", st_multi("geom")), "zones")
    order = ["traditional_name", "traditional_source", "property_code", "property_name",
             F.col("geom")["minx"], F.col("geom")["miny"]]
    return with_row_id(zones, order).select(
        "id", "property_name", "property_code", "property_source", "traditional_name",
        F.left("traditional_source", F.lit(SOURCE_LENGTH)).alias("traditional_source"), "properties", "overlaps", "area", "geom")


def conflict_points(zones: DataFrame) -> DataFrame:
    """A point inside each zone."""
    p = st_point_on_surface("geom")
    return (zones.withColumn("_p", p)
            .withColumn("geom", st_point(F.col("_p")["x"], F.col("_p")["y"]))
            .drop("_p", "properties", "overlaps", "area"))
