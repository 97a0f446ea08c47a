"""Joins between polygon layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import (bbox_overlap_area, box_intersection, convex_intersection, st_area, st_contains,
                                  st_from_parts, st_intersects, st_is_box)
from .grid import HOT_ROWS, grid_join
from .polygons import subdivide, with_intersection, with_valid


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(c).alias(prefix + c) for c in df.columns])


def union_layers(layers: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """Stack layers of the same columns under a column naming the layer."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in layers.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def overlap_join(left: DataFrame, right: DataFrame, cell: float, left_key: str, right_key: str,
                 rectangles: bool = False, max_vertices: int | None = None,
                 skip: Column | None = None, hot_rows: int = HOT_ROWS, convex: bool = False) -> DataFrame:
    """Pairs of polygons that share an area, with that area (``geom``, ``area``).

    Columns come back prefixed ``l_`` and ``r_``; both inputs have a polygon column ``geom``.
    One join serves any number of layers stacked on either side; ``skip`` leaves out pairs of
    layers by a condition on the prefixed columns. ``rectangles`` promises that all polygons are
    axis-aligned boxes and keeps the whole plan in the JVM; otherwise only pairs with a general
    polygon reach the numpy kernel. ``convex`` promises that all are convex polygons of one ring, which are clipped
    in the JVM as well. ``max_vertices`` cuts larger polygons into pieces first.
    """
    l, r = prefixed(left, "l_"), prefixed(right, "r_")
    if max_vertices:
        l, r = (subdivide(d, g, max_vertices) for d, g in ((l, "l_geom"), (r, "r_geom")))
    if not (rectangles or convex):
        l = l.withColumn("_lbox", st_is_box("l_geom"))
        r = r.withColumn("_rbox", st_is_box("r_geom"))
    pairs = grid_join(l, r, cell, "l_geom", "r_geom", hot_rows=hot_rows)
    if skip is not None:
        pairs = pairs.filter(~F.coalesce(skip, F.lit(False)))
    pairs = pairs.filter(bbox_overlap_area("l_geom", "r_geom") > 0)
    if rectangles:
        found = (pairs.withColumn("geom", box_intersection("l_geom", "r_geom"))
                 .withColumn("area", bbox_overlap_area("l_geom", "r_geom")))
    elif convex:
        found = (pairs.withColumn("geom", convex_intersection("l_geom", "r_geom")).filter(F.col("geom").isNotNull())
                 .withColumn("area", st_area("geom")))
    else:
        boxes = F.col("_lbox") & F.col("_rbox")
        # the kernel costs far more than moving a pair, so pairs are dealt out evenly first, in as many shares as AQE sees fit
        pairs = pairs.repartition("l_" + left_key, "r_" + right_key)
        found = (with_intersection(pairs, "_cut", "l_geom", "r_geom", ~boxes)
                 .withColumn("geom", F.when(boxes, box_intersection("l_geom", "r_geom"))
                             .otherwise(F.col("_cut")))
                 .filter(F.col("geom").isNotNull())
                 .withColumn("area", F.when(boxes, bbox_overlap_area("l_geom", "r_geom"))
                             .otherwise(st_area("geom")))
                 .drop("_cut", "_lbox", "_rbox"))
    if max_vertices:
        found = _join_pieces(found, ["l_" + left_key, "r_" + right_key])
    return found


def _join_pieces(found: DataFrame, keys: list[str]) -> DataFrame:
    """Put the pieces of each pair back together and remove the seams between them."""
    rest = [c for c in found.columns if c not in (*keys, "geom", "area", "l_geom", "r_geom")]
    whole = found.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in rest], F.count(F.lit(1)).alias("_n"),
        F.flatten(F.collect_list(F.col("geom")["parts"])).alias("_parts"),
        F.sum("area").alias("area"))
    stacked = st_from_parts(F.lit("multipolygon"), F.col("_parts"))
    several = F.col("_n") > 1
    return (with_valid(whole.withColumn("_stack", stacked), "_merged", "_stack", several)
            .withColumn("geom", F.when(several, F.col("_merged")).otherwise(F.col("_stack")))
            .drop("_n", "_parts", "_stack", "_merged"))


def point_in_polygon_join(points: DataFrame, polygons: DataFrame, cell: float, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Points strictly inside polygons; columns prefixed ``l_`` (points) and ``r_``."""
    pairs = grid_join(prefixed(points, "l_"), prefixed(polygons, "r_"), cell, "l_geom", "r_geom", hot_rows=hot_rows)
    return pairs.filter(st_contains("r_geom", F.col("l_geom")["minx"], F.col("l_geom")["miny"]))


def intersecting_keys(df: DataFrame, boundary: DataFrame, key: str, cell: float,
                      max_vertices: int = 64) -> DataFrame:
    """Keys of the features that share a point with the boundary (touching counts)."""
    pieces = subdivide(boundary.select("geom"), "geom", max_vertices)
    pairs = grid_join(prefixed(df.select(key, "geom"), "l_"), prefixed(pieces, "r_"), cell, "l_geom", "r_geom")
    return (pairs.filter(st_intersects("l_geom", "r_geom"))
            .select(F.col("l_" + key).alias(key)).distinct())


def intersects_boundary(df: DataFrame, boundary: DataFrame, key: str, cell: float,
                        max_vertices: int = 64) -> DataFrame:
    """Features that share a point with the boundary."""
    return df.join(intersecting_keys(df, boundary, key, cell, max_vertices), key, "left_semi")
