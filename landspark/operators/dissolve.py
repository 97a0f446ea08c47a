"""Union of the polygons of a group.

Members are cut at the cell borders and merged cell by cell, so a group spread over a wide area is
merged by many tasks. Copies inside a cell fold together before the shuffle. A cell with very many
distinct members is merged in chunks, and chunk results in chunks again, until one is left. Seams at the
cell borders go where pieces are put together: a block of neighbouring cells at a time while a group has many.
Boxes that continue one another are joined in the JVM, and of the rest only parts whose boxes touch meet in one
overlay, so a group spread wide costs what its clusters cost.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import overlay as ov
from ..functions.geometry import let, st_area, st_box, st_from_parts, st_is_box, to_flat
from ..session import materialize, shares
from .grid import spread, suggest_cell
from .polygons import PARTS, _Flat, _parts_array, with_clip

CHUNK_ROWS = 256
SEAM_ROWS = 256      # pieces of a group that are put together at once
SEAM_SHIFT = 3       # blocks of 8 x 8 cells become one
_SPANS = "array<struct<a0:double,a1:double,b0:double,b1:double>>"


@F.arrow_udf(PARTS)
def _union_lists(groups: pa.Array) -> pa.Array:
    """Union of the polygons in each list; lists are null where nothing has to be merged."""
    valid = np.asarray(groups.is_valid())
    offsets = np.asarray(groups.offsets)
    flat = _Flat(groups.values)
    made = {}
    for i in np.flatnonzero(valid).tolist():
        made[i] = ov.union([ov.flat_to_parts(flat[j]) for j in range(offsets[i], offsets[i + 1])])
    return _parts_array(made, len(groups))


_union_lists = _union_lists.asNondeterministic()


def _span(p) -> Column:
    """A polygon that is one rectangle as its y and x ranges, else null."""
    one = (F.size(p) == 1) & (F.size(p[0]) == 1) & (F.size(p[0][0]) == 5)
    return F.when(one, let(st_from_parts(F.lit("polygon"), p), lambda g: F.when(st_is_box(g), F.struct(
        g["miny"].alias("a0"), g["maxy"].alias("a1"), g["minx"].alias("b0"), g["maxx"].alias("b1")))))


def _continued(spans) -> Column:
    """Boxes with the same range ``a`` that overlap or touch along ``b``, joined."""
    def step(acc, s):
        last = F.element_at(acc, -1)
        wider = F.struct(s["a0"].alias("a0"), s["a1"].alias("a1"), last["b0"].alias("b0"), F.greatest(last["b1"], s["b1"]).alias("b1"))
        goes_on = (F.size(acc) > 0) & (last["a0"] == s["a0"]) & (last["a1"] == s["a1"]) & (s["b0"] <= last["b1"])
        return F.when(goes_on, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(wider))).otherwise(F.concat(acc, F.array(s)))
    return F.aggregate(F.array_sort(spans), F.array().cast(_SPANS), step)


def _fewer(ps) -> Column:
    """The same area in fewer polygons where all of a list are boxes."""
    turned = lambda spans: F.transform(spans, lambda s: F.struct(
        s["b0"].alias("a0"), s["b1"].alias("a1"), s["a0"].alias("b0"), s["a1"].alias("b1")))
    boxes = lambda spans: F.transform(_continued(turned(_continued(spans))), lambda s: st_box(s["a0"], s["b0"], s["a1"], s["b1"])["parts"])
    spans = F.transform(ps, _span)
    return F.when(F.size(ps) > 1, let(spans, lambda v: F.when(F.forall(v, lambda s: s.isNotNull()), boxes(v)).otherwise(ps))).otherwise(ps)


def _merge(pieces: DataFrame, keys: list[str]) -> DataFrame:
    dealt = pieces.repartition(shares(pieces.sparkSession), *keys)
    lists = dealt.groupBy(*keys).agg(F.collect_list("parts").alias("ps"))  # at most one chunk
    lists = lists.withColumn("ps", _fewer(F.col("ps")))
    several = F.size("ps") > 1
    flat = F.transform("ps", lambda p: to_flat(F.struct(p.alias("parts"))))
    return (lists.withColumn("u", _union_lists(F.when(several, flat)))
            .select(*keys, F.when(several, F.col("u")).otherwise(F.col("ps")[0]).alias("parts")))


def _chunked(pieces: DataFrame, keys: list[str]) -> tuple[DataFrame, bool]:
    counts = pieces.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    top = counts.agg(F.max("_n")).first()[0] or 0
    if top <= CHUNK_ROWS:
        return pieces, False
    n = F.ceil(F.col("_n") / F.lit(CHUNK_ROWS))
    return (pieces.join(counts.filter(F.col("_n") > CHUNK_ROWS), keys, "left")
            .withColumn("_chunk", F.when(F.col("_n").isNull(), 0)
                        .otherwise(F.pmod(F.xxhash64("parts"), n)).cast("int")).drop("_n")), True


def dissolve_pieces(df: DataFrame, by: list[str], cell: float | None = None, geom: str = "geom",
                    rectangles: bool = False) -> DataFrame:
    """Disjoint pieces covering the union of each group: ``by``, cell, ``geom``, ``area``."""
    cell = cell or suggest_cell(df, geom)
    keys = [*by, "_cx", "_cy"]
    rows = spread(df.select(*by, F.col(geom).alias("geom")), "geom", cell)
    g, size = F.col("geom"), F.lit(float(cell))
    x0, y0 = F.col("_cx") * size, F.col("_cy") * size
    if rectangles:
        low_x, low_y = F.greatest(g["minx"], x0), F.greatest(g["miny"], y0)
        high_x, high_y = F.least(g["maxx"], x0 + size), F.least(g["maxy"], y0 + size)
        cut = (rows.select(*keys, low_x.alias("a"), low_y.alias("b"), high_x.alias("c"),
                           high_y.alias("d"))
               .filter((F.col("c") > F.col("a")) & (F.col("d") > F.col("b"))))
        return _measured(_boxes_of_cells(cut, keys), keys)
    else:
        inside = ((g["minx"] >= x0) & (g["maxx"] <= x0 + size)
                  & (g["miny"] >= y0) & (g["maxy"] <= y0 + size))
        rows = rows.repartition(shares(df.sparkSession))
        cut = (with_clip(rows, "_cut", "geom", x0, y0, x0 + size, y0 + size, ~inside)
               .withColumn("geom", F.when(inside, F.col("geom")).otherwise(F.col("_cut")))
               .filter(F.col("geom").isNotNull())
               .select(*keys, F.col("geom")["parts"].alias("parts")).distinct())
    return _measured(_merged_cells(materialize(cut, "cut"), keys), keys)  # counted and merged, clipped once


def _merged_cells(pieces: DataFrame, keys: list[str]) -> DataFrame:
    merged, again = pieces, True
    while again:
        chunked, again = _chunked(merged, keys)
        # a chunk number that is the same everywhere would take the place of the even deal by one that goes by bytes
        merged = _merge(chunked, keys + ["_chunk"]).drop("_chunk") if again else _merge(chunked, keys)
        if again:
            merged = materialize(merged, "chunks")
    return merged


def _boxes_of_cells(cut: DataFrame, keys: list[str]) -> DataFrame:
    """``parts`` of each cell from its boxes ``a, b, c, d``. Where one of them holds all others it is the answer,
    and no list is made."""
    box = F.struct("a", "b", "c", "d")
    area = (F.col("c") - F.col("a")) * (F.col("d") - F.col("b"))
    ends = materialize(cut.groupBy(*keys).agg(
        F.min("a").alias("a0"), F.min("b").alias("b0"), F.max("c").alias("c1"), F.max("d").alias("d1"), F.max_by(box, area).alias("w")), "cells")
    filled = (F.col("w.a") == F.col("a0")) & (F.col("w.b") == F.col("b0")) & (F.col("w.c") == F.col("c1")) & (F.col("w.d") == F.col("d1"))
    one = ends.filter(filled).select(*keys, st_box("a0", "b0", "c1", "d1")["parts"].alias("parts"))
    open_ = ends.filter(~filled).select(*[F.col(k).alias("_k_" + k) for k in keys])
    if open_.isEmpty():
        return one
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col("_k_" + k)) for k in keys])
    rest = cut.join(open_, same, "left_semi").distinct().select(*keys, st_box("a", "b", "c", "d")["parts"].alias("parts"))
    return one.unionByName(_merged_cells(rest, keys))


def _measured(merged: DataFrame, keys: list[str]) -> DataFrame:
    out = merged.select(*keys, st_from_parts(F.lit("multipolygon"), F.col("parts")).alias("geom")).filter(F.col("geom").isNotNull())
    return out.withColumn("area", st_area("geom"))


def assemble(pieces: DataFrame, by: list[str]) -> DataFrame:
    """One multipolygon and its area per group, from disjoint pieces of grid cells.

    While a group has more than ``SEAM_ROWS`` pieces, those of a block of neighbouring cells become one; the
    size of a group changes the number of steps, not the result.
    """
    parts = materialize(pieces.select(*by, "_cx", "_cy", F.col("geom")["parts"].alias("parts")), "pieces")  # counted and merged
    while (parts.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) > SEAM_ROWS:
        wider = parts.withColumns({c: F.shiftright(c, SEAM_SHIFT) for c in ("_cx", "_cy")})
        parts = materialize(_merge(wider, [*by, "_cx", "_cy"]), "seams")
    whole = _merge(parts, by).select(*by, st_from_parts(F.lit("multipolygon"), F.col("parts")).alias("geom"))
    return whole.withColumn("area", st_area("geom"))


def dissolve(df: DataFrame, by: list[str], cell: float | None = None, geom: str = "geom",
             rectangles: bool = False) -> DataFrame:
    """Union of the polygons of each group as one row with ``geom`` and ``area``."""
    return assemble(dissolve_pieces(df, by, cell, geom, rectangles), by)
