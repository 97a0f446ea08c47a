"""Points and shapes against many layers at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import constants as K
from ..functions.geometry import st_area, st_covers, st_intersects
from .dissolve import dissolve_pieces
from .grid import grid_join
from .overlap import overlap_join, prefixed, union_layers
from .rows import top_by_priority


def _with_priority(layers: dict[str, DataFrame], priority: list[str]) -> DataFrame:
    rank = {name: i for i, name in enumerate(priority)}
    stacked = [df.withColumn("priority", F.lit(rank.get(name, K.UNLISTED_PRIORITY)))
               for name, df in layers.items()]
    return union_layers(dict(zip(layers, stacked)), "layer")


def probe_hits(points: DataFrame, layers: dict[str, DataFrame], cell: float, key: str = "pid",
               priority: list[str] = K.LAYER_PRIORITY) -> DataFrame:
    """All features under each point; columns prefixed ``l_`` (point) and ``r_`` (feature)."""
    features = prefixed(_with_priority(layers, priority), "r_")
    hits = grid_join(prefixed(points, "l_"), features, cell, "l_geom", "r_geom")
    return hits.filter(st_covers("r_geom", F.col("l_geom")["minx"], F.col("l_geom")["miny"]))


def probe_points(points: DataFrame, layers: dict[str, DataFrame], cell: float, key: str = "pid",
                 priority: list[str] = K.LAYER_PRIORITY, registry: tuple[str, ...] = ("area_imovel_1",),
                 parcels: tuple[str, ...] = ("sigef_privado_pe", "sigef_publico_pe")) -> DataFrame:
    """Top feature under each point. When it is a registry property, the topmost certified parcel
    under the same point is given with it. Layers share the columns ``key, geom`` and any others."""
    hits = probe_hits(points, layers, cell, key, priority).drop("l_geom", "r_geom")
    pid = "l_" + key
    feature = F.struct("r_layer", "r_key")
    order = F.struct("r_priority", "r_key")
    certified = F.when(F.col("r_layer").isin(*parcels), order)
    best = hits.groupBy(pid).agg(
        F.min_by(feature, order).alias("top"), F.count(F.lit(1)).alias("hits"),
        F.min_by(F.when(certified.isNotNull(), feature), certified).alias("parcel"))
    return best.select(F.col(pid).alias(key), F.col("top.r_layer").alias("layer"),
                       F.col("top.r_key").alias("feature"), "hits",
                       F.when(F.col("top.r_layer").isin(*registry), F.col("parcel.r_key")).alias("parcel"))


def cross_layers(probe: DataFrame, layers: dict[str, DataFrame], cell: float, key: str = "key",
                 rectangles: bool = False) -> DataFrame:
    """Per probe shape and layer: features met and area shared with them."""
    stacked = union_layers(layers, "layer")
    areal = overlap_join(probe, stacked, cell, key, "key", rectangles=rectangles)
    return (areal.groupBy(F.col("l_" + key).alias(key), F.col("r_layer").alias("layer"))
            .agg(F.count(F.lit(1)).alias("features"), F.sum("area").alias("area")))


def count_points_in(probe: DataFrame, points: DataFrame, cell: float, key: str = "key") -> DataFrame:
    """Points of a layer on each probe shape (cases, notices, communities)."""
    hits = grid_join(prefixed(points, "l_"), prefixed(probe, "r_"), cell, "l_geom", "r_geom")
    return (hits.filter(st_intersects("l_geom", "r_geom")).groupBy(F.col("r_" + key).alias(key))
            .agg(F.count(F.lit(1)).alias("points")))


def socio_legal(probe: DataFrame, layers: dict[str, DataFrame], cases: DataFrame, cell: float, key: str = "key",
                seat: str = "seat", point_key: str = "pid") -> DataFrame:
    """Per probe shape the points of each layer on it (notices, communities at risk), and the court cases
    of its seat. One join serves all layers."""
    stacked = union_layers({n: df.select(point_key, "geom") for n, df in layers.items()}, "layer")
    hits = grid_join(prefixed(stacked, "l_"), prefixed(probe.select(key, "geom"), "r_"), cell, "l_geom", "r_geom")
    hits = hits.filter(st_intersects("l_geom", "r_geom"))
    counts = hits.groupBy(F.col("r_" + key).alias(key)).agg(*[F.count_if(F.col("l_layer") == n).alias(n) for n in layers])
    at_seat = cases.groupBy(seat).agg(F.count(F.lit(1)).alias("cases"))
    return probe.select(key, seat).join(counts, key, "left").join(at_seat, seat, "left").na.fill(0, [*layers, "cases"])


def overlap_share(a: DataFrame, b: DataFrame, cell: float, key: str = "key", rectangles: bool = False) -> DataFrame:
    """Area of each ``a`` covered by the union of ``b``, and its share in per cent."""
    shared = overlap_join(a.select(key, "geom"), b.select(key, "geom"), cell, key, key, rectangles=rectangles)
    covered = (dissolve_pieces(shared.select(F.col("l_" + key).alias(key), "geom"), [key], cell,
                               rectangles=rectangles)
               .groupBy(key).agg(F.sum("area").alias("covered")))
    whole = a.select(key, st_area("geom").alias("area"))
    return (whole.join(covered, key, "left").withColumn("covered", F.coalesce("covered", F.lit(0.0)))
            .withColumn("share", F.col("covered") * 100.0 / F.col("area")))


def alert_crossings(alerts: DataFrame, layers: dict[str, DataFrame], cell: float, key: str = "key",
                    area: str = "alert_area", rectangles: bool = False) -> DataFrame:
    """Per layer and feature name: alerts meeting it and their full area, each alert once."""
    stacked = union_layers(layers, "layer")
    pairs = overlap_join(alerts, stacked, cell, key, "key", rectangles=rectangles)
    once = pairs.select(F.col("r_layer").alias("layer"), F.col("r_name").alias("name"),
                        F.col("l_" + key).alias(key), F.col("l_" + area).alias(area)).distinct()
    return once.groupBy("layer", "name").agg(F.count(F.lit(1)).alias("alerts"), F.sum(area).alias("area"))


def alerts_and_cases(alerts: DataFrame, cases: DataFrame, by: str) -> DataFrame:
    """Alerts beside court cases per municipality, either side may be missing."""
    a = alerts.groupBy(by).agg(F.count(F.lit(1)).alias("alerts"))
    c = cases.groupBy(by).agg(F.count(F.lit(1)).alias("cases"))
    return a.join(c, by, "full").na.fill(0, ["alerts", "cases"])
