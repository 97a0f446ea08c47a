"""Successive boundary versions of a parcel."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.lookups import attach_geometry, lookup_one
from ..operators.rows import history_delta


def parcel_history(versions: DataFrame, layer: DataFrame, code: str, current: dict, key: str = "codigo_imo",
                   order: str = "ordem_cronologica", area: str = "num_area") -> DataFrame:
    """Recorded versions of one parcel and the registered one as the last, with area changes.

    ``current`` gives the attributes of the registered version; its geometry comes from ``layer``,
    and a missing parcel is an error.
    """
    now = lookup_one(layer, key, code).select(key, "geom")
    for name, value in current.items():
        now = now.withColumn(name, F.lit(value))
    chain = versions.filter(F.col(key) == code).unionByName(now, allowMissingColumns=True)
    return history_delta(chain, [key], order, area).orderBy(order)


def analysed_properties(curated: DataFrame, layer: DataFrame, key: str = "cod_imovel") -> DataFrame:
    """Curated case list with the geometry of the registry."""
    return attach_geometry(curated, layer, key)
