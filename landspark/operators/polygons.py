"""Polygon operators that need the numpy helpers, wrapped as Arrow functions."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import overlay as ov
from ..functions.geometry import as_col, st_from_parts, st_is_box, to_flat

_VERTEX = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
PARTS = T.ArrayType(T.ArrayType(T.ArrayType(_VERTEX)))
NAMES = ("xs", "ys", "ring_sizes", "part_sizes")


class _Flat:
    """Flat polygons of a batch, cut from the Arrow buffers without per-row objects."""

    def __init__(self, batch: pa.StructArray):
        lists = {n: batch.field(n) for n in NAMES}
        self.filled = np.asarray(lists["xs"].is_valid()) & np.asarray(batch.is_valid())
        self.offsets = {n: np.asarray(v.offsets) for n, v in lists.items()}
        self.values = {n: v.values.to_numpy(zero_copy_only=False) for n, v in lists.items()}

    def __getitem__(self, i: int) -> dict:
        return {n: self.values[n][self.offsets[n][i]:self.offsets[n][i + 1]] for n in NAMES}


def _offsets(lengths) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))


def _parts_array(made: dict[int, list], size: int) -> pa.ListArray:
    """Column of nested parts with ``made[i]`` in row ``i`` and null elsewhere."""
    rows = sorted(made)
    parts = [p for i in rows for p in made[i]]
    rings = [r for p in parts for r in p]
    pts = np.vstack(rings) if rings else np.empty((0, 2))
    vertices = pa.StructArray.from_arrays([pa.array(pts[:, 0], pa.float64()),
                                           pa.array(pts[:, 1], pa.float64())], ["x", "y"])
    nested = pa.ListArray.from_arrays(_offsets([len(r) for r in rings]), vertices)
    nested = pa.ListArray.from_arrays(_offsets([len(p) for p in parts]), nested)
    lengths = np.zeros(size, dtype=np.int64)
    lengths[rows] = [len(made[i]) for i in rows]
    missing = np.ones(size + 1, dtype=bool)
    missing[rows] = False
    missing[size] = False
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, mask=missing), nested)


def _rectangles(f: _Flat) -> tuple[np.ndarray, np.ndarray]:
    """Which polygons of a batch are rectangles, also with more vertices than four, and their bounds.

    The one ring of a rectangle runs along the border of its box, so its area is a multiple of the box's: once around.
    """
    found, bounds = np.zeros(len(f.filled), dtype=bool), np.zeros((len(f.filled), 4))
    begin, end = f.offsets["xs"][:-1], f.offsets["xs"][1:]
    rows = np.flatnonzero(f.filled & (np.diff(f.offsets["part_sizes"]) == 1) & (np.diff(f.offsets["ring_sizes"]) == 1) & (end - begin >= 5))
    if not len(rows):
        return found, bounds
    sizes = end[rows] - begin[rows]
    starts = np.cumsum(sizes) - sizes
    own = np.repeat(np.arange(len(rows)), sizes)
    at = np.arange(sizes.sum()) + (begin[rows] - starts)[own]
    x, y = f.values["xs"][at], f.values["ys"][at]
    b = np.column_stack([fold.reduceat(v, starts) for fold in (np.minimum, np.maximum) for v in (x, y)])
    i = np.flatnonzero(own[:-1] == own[1:])
    j, k = i + 1, own[i]
    along = (((x[i] == x[j]) & ((x[i] == b[k, 0]) | (x[i] == b[k, 2]))) | ((y[i] == y[j]) & ((y[i] == b[k, 1]) | (y[i] == b[k, 3]))))
    ox, oy = b[k, 0], b[k, 1]
    area = np.abs(np.bincount(k, (x[i] - ox) * (y[j] - oy) - (x[j] - ox) * (y[i] - oy), len(rows))) / 2
    box, last = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1]), starts + sizes - 1
    closed = (x[starts] == x[last]) & (y[starts] == y[last])
    found[rows] = closed & (np.bincount(k, ~along, len(rows)) == 0) & (box > 0) & (np.abs(area - box) <= 1e-6 * box)
    bounds[rows] = b
    return found, bounds


def _ranks(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each value in its row, equal ones alike, and the rows' distinct values by rank."""
    order = np.argsort(v, axis=1, kind="stable")
    ordered = np.take_along_axis(v, order, axis=1)
    steps = np.zeros(v.shape, dtype=np.int64)
    steps[:, 1:] = np.cumsum(ordered[:, 1:] != ordered[:, :-1], axis=1)
    rank, values = np.empty_like(steps), np.empty_like(v)
    np.put_along_axis(rank, order, steps, axis=1)
    np.put_along_axis(values, steps, ordered, axis=1)
    return rank, values


@lru_cache(maxsize=ov.OUTLINES)
def _outline(ranks: bytes, rings_a: tuple, rings_b: tuple) -> list:
    """Shared parts of two polygons that are given by the ranks of their coordinates."""
    r = np.frombuffer(ranks, dtype=np.int16).reshape(2, -1).astype(float)
    n = sum(rings_a)
    return [[ring.astype(np.int64) for ring in part] for part in ov.overlay(
        [ov.to_rings(*r[:, :n], rings_a), ov.to_rings(*r[:, n:], rings_b)], 2)]


def _along_axes(fa: _Flat, fb: _Flat, rows: np.ndarray) -> dict[int, list]:
    """Shared parts of those rows of which all edges run along the axes, for a whole batch at once.

    The outline of what they share depends on the order of their coordinates alone. It is traced once for each order,
    on ranks, and takes the coordinates of every pair of that order.
    """
    kinds: dict = {}
    for i in rows.tolist():
        size = [tuple(f.values["ring_sizes"][f.offsets["ring_sizes"][i]:f.offsets["ring_sizes"][i + 1]].tolist()) for f in (fa, fb)]
        if all(size) and sum(size[0]) + sum(size[1]) <= ov.FEW_VERTICES and min(size[0] + size[1]) > 1:
            kinds.setdefault(tuple(size), []).append(i)
    made = {}
    for (rings_a, rings_b), same in kinds.items():
        same = np.array(same)
        at = [f.offsets["xs"][same][:, None] + np.arange(sum(r)) for f, r in ((fa, rings_a), (fb, rings_b))]
        x, y = (np.round(np.hstack([fa.values[n][at[0]], fb.values[n][at[1]]]), ov.DECIMALS) for n in ("xs", "ys"))
        inner = np.ones(x.shape[1], dtype=bool)
        inner[np.cumsum(rings_a + rings_b) - 1] = False  # from the end of a ring there is no edge to the next
        inner = inner[:-1]
        plain = (((x[:, :-1] == x[:, 1:]) | (y[:, :-1] == y[:, 1:])) | ~inner).all(axis=1) & np.isfinite(x).all(axis=1) & np.isfinite(y).all(axis=1)
        same, x, y = same[plain], x[plain], y[plain]
        if not len(same):
            continue
        (rx, xs), (ry, ys) = _ranks(x), _ranks(y)
        orders, group = np.unique(np.hstack([rx, ry]).astype(np.int16), axis=0, return_inverse=True)
        by_group = np.argsort(group.ravel(), kind="stable")
        ends = np.cumsum(np.bincount(group.ravel(), minlength=len(orders)))
        for order, members in zip(orders, np.split(by_group, ends[:-1])):
            rows_of = same[members].tolist()
            parts = [[np.stack([xs[members][:, ring[:, 0]], ys[members][:, ring[:, 1]]], axis=2) for ring in part]
                     for part in _outline(order.tobytes(), rings_a, rings_b)]
            small = [[np.abs(_areas(ring)) <= ov.SLIVER for ring in part] for part in parts]
            tiny = np.any([s for part in small for s in part], axis=0) if parts else np.zeros(len(members), dtype=bool)
            for k, i in enumerate(rows_of):
                if not tiny[k]:
                    made[i] = [[ring[k] for ring in part] for part in parts]
    return made


def _areas(rings: np.ndarray) -> np.ndarray:
    p = rings - rings[:, :1]
    return (p[:, :-1, 0] * p[:, 1:, 1] - p[:, 1:, 0] * p[:, :-1, 1]).sum(axis=1) / 2


def _shared_parts(fa: _Flat, fb: _Flat) -> dict[int, list]:
    """Parts of the area shared by each two polygons; of rectangles, and of polygons along the axes, for a whole batch at once."""
    (plain_a, a), (plain_b, b) = _rectangles(fa), _rectangles(fb)
    low = np.round(np.maximum(a[:, :2], b[:, :2]), ov.DECIMALS)
    high = np.round(np.minimum(a[:, 2:], b[:, 2:]), ov.DECIMALS)
    side = high - low
    some = (side > 0).all(axis=1) & (side[:, 0] * side[:, 1] > ov.SLIVER)
    x0, y0, x1, y1 = low[:, 0], low[:, 1], high[:, 0], high[:, 1]
    rings = np.stack([np.column_stack(p) for p in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))], axis=1)
    plain = plain_a & plain_b
    made = {i: [[rings[i]]] if some[i] else [] for i in np.flatnonzero(plain).tolist()}
    other = np.flatnonzero(fa.filled & fb.filled & ~plain)
    made |= _along_axes(fa, fb, other)
    for i in other.tolist():
        if i not in made:
            made[i] = ov.overlay([ov.flat_to_rings(fa[i]), ov.flat_to_rings(fb[i])], 2)
    return made


@F.arrow_udf(PARTS)
def _intersect(a: pa.Array, b: pa.Array) -> pa.Array:
    return _parts_array(_shared_parts(_Flat(a), _Flat(b)), len(a))


@F.arrow_udf(PARTS)
def _repair(a: pa.Array) -> pa.Array:
    f = _Flat(a)
    return _parts_array({i: ov.overlay([ov.flat_to_rings(f[i])], 1)
                         for i in np.flatnonzero(f.filled).tolist()}, len(a))


PAIRWISE = 16  # parts of a polygon that are compared with one another at once


def _mended(f: _Flat) -> tuple[np.ndarray, dict[int, list]]:
    """Which polygons of a batch are valid as they are, and the parts of the others.

    Convex rings that lie apart are valid, and bow ties become two triangles, for a whole batch at once. What is left is
    overlaid one by one.
    """
    valid, made = ~f.filled, {}
    polygons = np.diff(f.offsets["part_sizes"])
    rings = np.diff(f.offsets["ring_sizes"])
    plain = f.filled & (polygons == rings) & (rings > 0)  # each part is one ring
    first, sizes = f.offsets["ring_sizes"], f.values["ring_sizes"]
    if plain.any():
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        own = np.repeat(np.arange(len(rings)), rings)  # the row of each ring
        ring_of = np.arange(first[0], first[-1])
        starts = starts + (f.offsets["xs"][0] - (starts[first[0]] if len(ring_of) else 0))
        keep = plain[own]
        own, ring_of = own[keep], ring_of[keep]
        convex, boxes, bound = np.zeros(len(own), dtype=bool), np.zeros(len(own), dtype=bool), np.empty((len(own), 4))
        for n in np.unique(sizes[ring_of]).tolist():
            k = np.flatnonzero(sizes[ring_of] == n)
            at = starts[ring_of[k]][:, None] + np.arange(n)
            r = np.stack([f.values["xs"][at], f.values["ys"][at]], axis=2)
            if not n:
                continue
            bound[k] = np.hstack([r.min(axis=1), r.max(axis=1)])
            convex[k], boxes[k] = ov.convex_rings(r), ov.box_rings(r)
            single = rings[own[k]] == 1
            valid[own[k[single & boxes[k]]]] = True
            if n == 5:
                ties = np.flatnonzero(single & ~convex[k] & ~boxes[k])
                i, pairs = ov.bow_ties(r[ties])
                for row, pair in zip(own[k[ties[i]]].tolist(), pairs):
                    made[row] = [[pair[0]], [pair[1]]]
        sound = plain & (np.bincount(own, weights=~convex, minlength=len(rings)) == 0)
        valid |= sound & (rings == 1)
        begin = np.searchsorted(own, np.arange(len(rings)))
        for m in np.unique(rings[sound & (rings > 1) & (rings <= PAIRWISE)]).tolist():
            rows = np.flatnonzero(sound & (rings == m))
            b = bound[begin[rows][:, None] + np.arange(m)]
            x, y = b[:, :, None], b[:, None]
            apart = (x[..., 0] > y[..., 2]) | (y[..., 0] > x[..., 2]) | (x[..., 1] > y[..., 3]) | (y[..., 1] > x[..., 3])
            valid[rows[(apart | np.eye(m, dtype=bool)).all(axis=(1, 2))]] = True
    for i in np.flatnonzero(~valid).tolist():
        if i not in made:
            made[i] = ov.overlay([ov.flat_to_rings(f[i])], 1)
    return valid, made


@F.arrow_udf(T.StructType([T.StructField("valid", T.BooleanType()), T.StructField("parts", PARTS)]))
def _mend(a: pa.Array) -> pa.Array:
    valid, made = _mended(_Flat(a))
    return pa.StructArray.from_arrays([pa.array(valid), _parts_array(made, len(a))], ["valid", "parts"])


@F.arrow_udf(PARTS)
def _clip(a: pa.Array, x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array) -> pa.Array:
    f = _Flat(a)
    box = np.column_stack([c.to_numpy(zero_copy_only=False) for c in (x0, y0, x1, y1)])
    return _parts_array({i: ov.clip_box(ov.flat_to_parts(f[i]), *box[i])
                         for i in np.flatnonzero(f.filled).tolist()}, len(a))


@F.arrow_udf(T.ArrayType(PARTS))
def _pieces(a: pa.Array, limit: pa.Array) -> pa.Array:
    f = _Flat(a)
    cut = {i: list(ov.halve(ov.flat_to_parts(f[i]), limit[i].as_py()))
           for i in np.flatnonzero(f.filled).tolist()}
    rows = sorted(cut)
    every = [q for i in rows for q in cut[i]]
    lengths = np.zeros(len(a), dtype=np.int32)
    lengths[rows] = [len(cut[i]) for i in rows]
    return pa.ListArray.from_arrays(_offsets(lengths), _parts_array(dict(enumerate(every)), len(every)))


@F.arrow_udf(T.BooleanType())
def _near(a: pa.Array, b: pa.Array, eps: pa.Array) -> pa.Array:
    fa, fb = _Flat(a), _Flat(b)
    out = np.zeros(len(a), dtype=bool)
    for i in np.flatnonzero(fa.filled & fb.filled).tolist():
        out[i] = ov.within_distance(ov.flat_to_rings(fa[i]), ov.flat_to_rings(fb[i]), eps[i].as_py())
    return pa.array(out)


# a kernel runs once per row and stays where it is: the optimizer neither repeats it nor moves a
# filter on its result below it
_intersect, _repair, _mend, _clip, _pieces, _near = (
    f.asNondeterministic() for f in (_intersect, _repair, _mend, _clip, _pieces, _near))


def _null_unless(cond: Column | None, flat: Column) -> Column:
    if cond is None:
        return flat
    # a struct of nulls keeps rows that need no work cheap to move
    return F.struct(*[F.when(cond, flat[n]).alias(n) for n in
                      ("xs", "ys", "ring_sizes", "part_sizes")])


def _through(df: DataFrame, out: str, parts: Column) -> DataFrame:
    # the kernel result is a column of its own before its box is worked out
    return (df.withColumn("_made", parts)
            .withColumn(out, st_from_parts(F.lit("multipolygon"), F.col("_made"))).drop("_made"))


def with_intersection(df: DataFrame, out: str, a: str, b: str, needed: Column | None = None):
    """Add the shared area of two polygon columns, null when they share none."""
    return _through(df, out, _intersect(_null_unless(needed, to_flat(a)),
                                        _null_unless(needed, to_flat(b))))


def with_valid(df: DataFrame, out: str, geom: str, needed: Column | None = None) -> DataFrame:
    """Even-odd repair: self-crossing rings are cut at their crossings, seams between parts
    disappear. Null when no area is left."""
    return _through(df, out, _repair(_null_unless(needed, to_flat(geom))))


def with_clip(df: DataFrame, out: str, geom: str, x0, y0, x1, y1, needed: Column | None = None):
    """Part of a polygon inside the box."""
    box = [as_col(c).cast("double") for c in (x0, y0, x1, y1)]
    return _through(df, out, _clip(_null_unless(needed, to_flat(geom)), *box))


def within_distance(a: str, b: str, eps: float, needed: Column | None = None) -> Column:
    return _near(_null_unless(needed, to_flat(a)), _null_unless(needed, to_flat(b)),
                 F.lit(float(eps)))


def vertex_count(g) -> Column:
    return F.size(F.flatten(F.flatten(as_col(g)["parts"])))


def subdivide(df: DataFrame, geom: str = "geom", max_vertices: int = 256) -> DataFrame:
    """Replace polygons with many vertices by several rows with few each, so that a join against
    small features touches only the piece near them and no single row is costly."""
    big = vertex_count(geom) > max_vertices
    pieces = _pieces(_null_unless(big, to_flat(geom)), F.lit(max_vertices))
    return (df.withColumn("_pieces", pieces)
            .withColumn("_piece", F.explode(F.when(big, F.transform("_pieces", lambda p: st_from_parts(F.lit("multipolygon"), p)))
                                            .otherwise(F.array(F.col(geom)))))
            .withColumn(geom, F.col("_piece")).drop("_pieces", "_piece"))


def _signs(values: Column) -> Column:
    """Signs of the values that are not 0."""
    return F.transform(F.filter(values, lambda v: v != 0), lambda v: F.signum(v))


def st_is_convex(g) -> Column:
    """True for one ring that turns to one side only and goes around once; such a polygon is valid."""
    g = as_col(g)
    ring = g["parts"][0][0]
    n = F.size(ring) - 1
    at = lambda c, i: F.get(ring, F.pmod(i, n))[c]
    side = lambda c: F.transform(F.sequence(F.lit(0), n - 1), lambda i: at(c, i + 1) - at(c, i))
    turn = lambda i: ((at("x", i + 1) - at("x", i)) * (at("y", i + 2) - at("y", i + 1))
                      - (at("y", i + 1) - at("y", i)) * (at("x", i + 2) - at("x", i + 1)))
    turns = F.transform(F.sequence(F.lit(0), n - 1), turn)
    one_way = F.size(F.array_distinct(_signs(turns))) == 1
    # going around once, x grows in one stretch and falls in another
    changes = lambda s: F.size(F.filter(F.zip_with(s, F.concat(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 1, 1)),
                                                   lambda a, b: a != b), lambda d: d))
    single = (F.size(g["parts"]) == 1) & (F.size(g["parts"][0]) == 1) & (n >= 3)
    return F.coalesce(single & one_way & (changes(_signs(side("x"))) <= 2), F.lit(False))


def make_valid(df: DataFrame, geom: str = "geom") -> DataFrame:
    """Repair polygons. Points, rectangles, convex polygons and those of convex parts that lie apart are valid as they
    are and stay unchanged; rows left without area are dropped."""
    mended = df.withColumn("_mended", _mend(_null_unless(F.col(geom)["gtype"].contains("polygon"), to_flat(geom))))
    return (mended.withColumn(geom, F.when(F.col("_mended.valid"), F.col(geom))
                              .otherwise(st_from_parts(F.lit("multipolygon"), F.col("_mended.parts"))))
            .drop("_mended").filter(F.col(geom).isNotNull()))
