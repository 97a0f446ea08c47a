"""Density clustering (DBSCAN) of polygons within a partition key.

Copies of one polygon are folded into a single weighted member first. Connected members (``min_points`` of one) are
found by a partition of space that follows the data. Regions begin as grid cells, and a member is listed in each
region within ``eps`` of its box, so each pair of neighbours meets in a region that holds a point of one of them.

* A region of at most ``LEAF`` members is one list, which gives back a spanning forest of its members.
* In any other region, the rectangle that takes most of it gets a link from each of its neighbours there, polygons
  after a test. That connects all pairs that meet inside it. What lies outside is cut at its edges and at a quantile of
  the edges that fall into the region, in both directions, and the parts are looked at again. Members on one spot lie
  mostly inside the largest, so few go on, and a member is copied about as often as its outline is cut.

Members that cuts do not part (more than ``LEAF`` of them after ``ROUNDS``, or general polygons none of whose boxes has
an edge in the region) are dealt out in chunks, and every pair of chunks meets in one list. Polygons are fetched when lists are made; until then
only boxes move. With ``min_points`` above one, neighbours are counted in cells cut and dealt the same way.
Nothing is left out, so the result is exact.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import overlay as ov
from ..functions.geometry import PARTS_TYPE, st_box, st_is_box, to_flat
from ..session import materialize
from .components import connected_components
from .grid import cut_hot_cells, spread, suggest_cell
from .polygons import _Flat, within_distance

CHUNK_ROWS = 512     # members of one chunk; a list holds at most about two chunks
TARGET_ROWS = 64     # members a cell should have after cutting
LEAF = 512           # members of a region that is one list
ROUNDS = 12          # times that regions are cut
CUTS = (0.25, 0.5, 0.75)
REGION = ["rx0", "ry0", "rx1", "ry1"]
BOX = ["minx", "miny", "maxx", "maxy"]
LINKS = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


def _members(df: DataFrame, by: list[str], id_col: str, geom: str, rectangles: bool) -> DataFrame:
    g = F.col(geom)
    # two polygons are copies when box and vertices agree; for rectangles the box decides
    shape = (F.lit("") if rectangles else F.when(st_is_box(geom), F.lit(""))
             .otherwise(F.sha2(F.to_json(g["parts"]), 256)))
    parts = F.lit(None).cast(PARTS_TYPE) if rectangles else F.when(shape != "", g["parts"])
    return df.select(F.col(id_col).alias("rid"), F.to_json(F.struct(*by)).alias("_by"),
                     *[g[c].alias(c) for c in BOX], shape.alias("_shape"), parts.alias("parts"))


def _fold_copies(members: DataFrame, rectangles: bool) -> DataFrame:
    parts = [] if rectangles else [F.any_value("parts").alias("parts")]
    return members.groupBy("_by", *BOX, "_shape").agg(
        F.min("rid").alias("rid"), F.count(F.lit(1)).alias("w"), *parts)


class _Members:
    """Members of a batch of lists as plain arrays."""

    def __init__(self, lists: pa.ListArray):
        self.offsets = np.asarray(lists.offsets)
        rows = lists.values
        get = lambda n: rows.field(n).to_numpy(zero_copy_only=False)
        self.rid, self.w, self.own, self.label = get("rid"), get("w"), get("own"), get("label")
        self.box = [get(c) for c in BOX]
        names = [rows.type.field(i).name for i in range(rows.type.num_fields)]
        self.flat = _Flat(rows.field("flat")) if "flat" in names else None

    def near(self, lo: int, hi: int, eps: float) -> np.ndarray:
        """Matrix of the neighbours among the members ``lo:hi``."""
        x0, y0, x1, y1 = (c[lo:hi] for c in self.box)
        dx = np.maximum(np.maximum(x0[None] - x1[:, None], x0[:, None] - x1[None]), 0)
        dy = np.maximum(np.maximum(y0[None] - y1[:, None], y0[:, None] - y1[None]), 0)
        hit = dx * dx + dy * dy <= eps * eps
        np.fill_diagonal(hit, False)
        if self.flat is not None and self.flat.filled[lo:hi].any():
            for i, j in np.argwhere(np.triu(hit)).tolist():
                if self.flat.filled[lo + i] or self.flat.filled[lo + j]:
                    hit[i, j] = hit[j, i] = ov.within_distance(
                        self._rings(lo + i), self._rings(lo + j), eps)
        return hit

    def _rings(self, i: int):
        if self.flat.filled[i]:
            return ov.flat_to_rings(self.flat[i])
        x0, y0, x1, y1 = (c[i] for c in self.box)
        return [np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]])]


def _links(per_list: list[tuple[np.ndarray, np.ndarray]]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a, _ in per_list])]).astype(np.int32)
    col = lambda k: pa.array(np.concatenate([p[k] for p in per_list]) if per_list else [], pa.int64())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([col(0), col(1)], ["a", "b"]))


def _groups(hit: np.ndarray) -> np.ndarray:
    """Component number of each member, by flooding."""
    n = len(hit)
    group = np.full(n, -1)
    for start in range(n):
        if group[start] >= 0:
            continue
        front = np.zeros(n, dtype=bool)
        front[start] = True
        seen = front.copy()
        while front.any():
            front = hit[front].any(axis=0) & ~seen
            seen |= front
        group[seen] = start
    return group


@F.arrow_udf(LINKS)
def _forest(lists: pa.Array, eps: pa.Array) -> pa.Array:
    """Each member with the least id of its local component, roots left out."""
    m, e, out = _Members(lists), eps[0].as_py() if len(eps) else 0.0, []
    for lo, hi in zip(m.offsets[:-1].tolist(), m.offsets[1:].tolist()):
        rid, group = m.rid[lo:hi], _groups(m.near(lo, hi, e))
        low = np.full(hi - lo, np.iinfo(np.int64).max)
        np.minimum.at(low, group, rid)
        root = low[group]
        out.append((rid[rid != root], root[rid != root]))
    return _links(out)


def _counted_here(m: _Members, lo: int, hi: int, cell: list) -> np.ndarray:
    """Pairs whose shared grown box starts in this cell; chunks meeting each other leave out pairs
    within a chunk, those are seen where the chunk meets itself."""
    size, grow, cx, cy, k, sx, sy, a, b = cell
    x = np.maximum(m.box[0][lo:hi, None], m.box[0][None, lo:hi]) - grow
    y = np.maximum(m.box[1][lo:hi, None], m.box[1][None, lo:hi]) - grow
    sub = lambda v, base: np.clip(np.floor((v - base * size) * k / size), 0, k - 1)
    here = ((np.floor(x / size) == cx) & (np.floor(y / size) == cy)
            & (sub(x, cx) == sx) & (sub(y, cy) == sy))
    own = m.own[lo:hi]
    return here & ((own[:, None] != own[None]) if a != b else True)


@F.arrow_udf(LINKS)
def _weights(lists: pa.Array, eps: pa.Array, cell: pa.Array) -> pa.Array:
    """Each member with the weight of the neighbours counted in this list."""
    m, e, out = _Members(lists), eps[0].as_py() if len(eps) else 0.0, []
    where = [list(c.values()) for c in cell.to_pylist()]
    for i, (lo, hi) in enumerate(zip(m.offsets[:-1].tolist(), m.offsets[1:].tolist())):
        hit = m.near(lo, hi, e) & _counted_here(m, lo, hi, where[i])
        total = (hit * m.w[None, lo:hi]).sum(axis=1)
        out.append((m.rid[lo:hi][total > 0], total[total > 0]))
    return _links(out)


@F.arrow_udf(LINKS)
def _adopted(lists: pa.Array, eps: pa.Array) -> pa.Array:
    """Members without a label with the least label of a neighbour that has one."""
    m, e, out = _Members(lists), eps[0].as_py() if len(eps) else 0.0, []
    none = np.iinfo(np.int64).max
    for lo, hi in zip(m.offsets[:-1].tolist(), m.offsets[1:].tolist()):
        label = m.label[lo:hi]
        best = np.where(m.near(lo, hi, e) & (label >= 0)[None], label[None], none).min(axis=1)
        take = (label < 0) & (best < none)
        out.append((m.rid[lo:hi][take], best[take]))
    return _links(out)


def _dealt(rows: DataFrame, keys: list[str], counts: DataFrame) -> DataFrame:
    """Rows of crowded keys in chunks, every two of which meet under ``_lo, _hi``."""
    chunks = F.ceil(F.col("_n") / F.lit(CHUNK_ROWS)).cast("int")
    return (rows.join(counts, keys).withColumn("_chunks", chunks)
            .withColumn("own", F.pmod(F.xxhash64("rid"), F.col("_chunks")).cast("int"))
            .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
            .withColumn("_lo", F.least("own", "_other"))
            .withColumn("_hi", F.greatest("own", "_other")))


def _lists(rows: DataFrame, keys: list[str], reps: DataFrame) -> DataFrame:
    """Members per key as one bounded list; their polygons come from ``reps``."""
    fields = ["rid", *BOX, "w", "own", "label"]
    if "parts" in reps.columns:
        rows = rows.join(reps.select("rid", "parts"), "rid")
        flat = F.struct(*[F.when(F.col("parts").isNotNull(), to_flat(F.struct("parts"))[n]).alias(n)
                          for n in ("xs", "ys", "ring_sizes", "part_sizes")])
        rows = rows.withColumn("flat", flat)
        fields.append("flat")
    return (rows.groupBy(*keys).agg(F.collect_list(F.struct(*fields)).alias("_list"))
            .filter(F.size("_list") > 1))


def _links_of(lists: DataFrame, work, *args) -> DataFrame:
    return (lists.select(work(F.col("_list"), *args).alias("_out")).select(F.explode("_out").alias("_out"))
            .select("_out.a", "_out.b"))


class _Space:
    """Members laid out over the grid as bounded lists."""

    def __init__(self, reps: DataFrame, eps: float, cell: float):
        self.eps, self.cell, self.reps = F.lit(float(eps)), float(cell), reps
        # slightly above half, so that rounding loses no pair at exactly eps
        self.grow = eps * 0.5000001 + 1e-12
        keys = ["_by", "_cx", "_cy"]
        rows = spread(reps.select("_by", "rid", *BOX, "w").withColumn("g", F.struct(*BOX)), "g", cell, self.grow)
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        self.chunked = (counts.agg(F.max("_n")).first()[0] or 0) > CHUNK_ROWS
        if self.chunked:
            split = (counts.filter(F.col("_n") > CHUNK_ROWS)
                     .select(*keys, F.ceil(F.col("_n") / TARGET_ROWS).cast("int").alias("_split")))
            rows = cut_hot_cells(rows, "g", cell, split, keys, self.grow)
            keys = keys + ["_k", "_sx", "_sy"]
            counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
            rows = materialize(_dealt(rows, keys, counts), "cells")
            keys = keys + ["_lo", "_hi"]
        else:
            rows = rows.withColumn("own", F.lit(0))
        self.rows, self.keys = rows, keys

    def run(self, work, labels: DataFrame | None = None, located: bool = False) -> DataFrame:
        """Pairs ``a``, ``b`` that ``work`` gives for the lists."""
        rows = self.rows
        rows = (rows.withColumn("label", F.lit(-1).cast("bigint")) if labels is None else
                rows.join(labels, "rid", "left").withColumn("label", F.coalesce("label", F.lit(-1))))
        return _links_of(_lists(rows, self.keys, self.reps), work, self.eps, *([self._place()] if located else []))

    def _place(self) -> Column:
        extra = ["_k", "_sx", "_sy", "_lo", "_hi"]
        if not self.chunked:
            named = [F.lit(v).alias(n) for n, v in zip(extra, (1, 0, 0, 0, 0))]
        else:
            named = [F.col(n) for n in extra]
        return F.struct(F.lit(self.cell).alias("size"), F.lit(self.grow).alias("grow"),
                        "_cx", "_cy", *named)


def _beside(eps: float) -> Column:
    """Whether the box is within ``eps`` of the rectangle over its region."""
    gap = lambda low, high: F.greatest(F.col(low) - F.col(f"_over.{high}"), F.col(f"_over.{low}") - F.col(high), F.lit(0.0))
    dx, dy = gap("minx", "maxx"), gap("miny", "maxy")
    return dx * dx + dy * dy <= eps * eps


def _cut(open_: DataFrame, keys: list[str], grow: float) -> tuple[DataFrame, DataFrame]:
    """Rows of regions under the parts of their region that lie outside its largest rectangle, and those of
    regions that nothing cuts."""
    corner = F.explode(F.array(F.struct(F.col("minx").alias("x"), F.col("miny").alias("y")), F.struct(F.col("maxx").alias("x"), F.col("maxy").alias("y"))))
    inside = lambda v, a, b: F.when((F.col(v) > F.col(a)) & (F.col(v) < F.col(b)), F.col(v))
    quantiles = lambda v, a, b: F.percentile_approx(inside(v, a, b), list(CUTS), 1000)
    cuts = open_.select(*keys, corner.alias("c")).groupBy(*keys).agg(quantiles("c.x", "rx0", "rx1").alias("_xs"), quantiles("c.y", "ry0", "ry1").alias("_ys"))
    rows = open_.join(cuts, keys)
    over = F.col("_over").isNotNull()

    def ends(values, a, b, low, high):
        own = F.filter(F.array(F.col(f"_over.{low}"), F.col(f"_over.{high}")), lambda v: (v > F.col(a)) & (v < F.col(b)))
        some = F.when(over, F.concat(own, F.slice(values, 2, 1))).otherwise(F.col(values))
        return F.array_sort(F.array_distinct(F.concat(F.array(F.col(a), F.col(b)), F.coalesce(some, F.when(over, own), F.array().cast("array<double>")))))

    def parts(values, low, high):
        pairs = F.transform(F.slice(values, 1, F.size(values) - 1), lambda v, i: F.struct(v.alias("a"), F.element_at(values, i + 2).alias("b")))
        return F.explode(F.filter(pairs, lambda p: (p["a"] <= F.col(high) + grow) & (p["b"] >= F.col(low) - grow)))

    rows = rows.withColumns({"_xs": ends("_xs", "rx0", "rx1", "minx", "maxx"), "_ys": ends("_ys", "ry0", "ry1", "miny", "maxy")})
    whole = (F.size("_xs") == 2) & (F.size("_ys") == 2)
    some = rows.filter(~whole | over).withColumn("_px", parts("_xs", "minx", "maxx")).withColumn("_py", parts("_ys", "miny", "maxy"))
    linked = ((F.col("_px.a") >= F.col("_over.minx")) & (F.col("_px.b") <= F.col("_over.maxx"))
              & (F.col("_py.a") >= F.col("_over.miny")) & (F.col("_py.b") <= F.col("_over.maxy")))
    some = some.filter(~F.coalesce(linked, F.lit(False)))
    columns = [c for c in open_.columns if c != "_over"]
    made = some.withColumns({"rx0": F.col("_px.a"), "rx1": F.col("_px.b"), "ry0": F.col("_py.a"), "ry1": F.col("_py.b")})
    return made.select(columns), rows.filter(whole & ~over).select(columns)


def neighbour_links(reps: DataFrame, eps: float, cell: float) -> DataFrame:
    """Links ``a, b`` that connect all members within ``eps`` of each other."""
    grow, keys, columns = eps * 1.0000001 + 1e-12, ["_by", *REGION], ["_by", *REGION, "rid", *BOX, "w", "plain"]
    rows = spread(reps.select("_by", "rid", *BOX, "w", (F.col("_shape") == "").alias("plain")).withColumn("g", F.struct(*BOX)), "g", cell, grow)
    size = F.lit(float(cell))
    work = rows.withColumns({"rx0": F.col("_cx") * size, "ry0": F.col("_cy") * size, "rx1": (F.col("_cx") + 1) * size, "ry1": (F.col("_cy") + 1) * size}).select(columns)
    forest = lambda df, by: _links_of(_lists(df.withColumn("label", F.lit(-1).cast("bigint")), by, reps), _forest, F.lit(float(eps)))
    shared = ((F.least("maxx", "rx1") - F.greatest("minx", "rx0")) * (F.least("maxy", "ry1") - F.greatest("miny", "ry0")))
    crosses = F.col("plain") & (F.col("maxx") > F.col("rx0")) & (F.col("minx") < F.col("rx1")) & (F.col("maxy") > F.col("ry0")) & (F.col("miny") < F.col("ry1")) & (shared > 0)
    leaves, links = [], []
    for k in range(ROUNDS + 1):
        counts = work.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        if k == 0 and (counts.agg(F.max("_n")).first()[0] or 0) <= LEAF:
            leaves.append(work)
            break
        largest = F.max_by(F.when(crosses, F.struct("rid", *BOX)), F.when(crosses, F.struct(shared, -F.col("rid"))))
        known = work.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), largest.alias("_over")).filter("_n > 1")
        marked = materialize(work.join(known, keys), "regions")
        leaves.append(marked.filter(F.col("_n") <= LEAF).select(columns))
        open_ = marked.filter(F.col("_n") > LEAF).drop("_n")
        if open_.isEmpty():
            break
        beside = open_.filter((F.col("rid") != F.col("_over.rid")) & _beside(eps))
        links.append(beside.filter("plain").select(F.col("rid").alias("a"), F.col("_over.rid").alias("b")))
        if "parts" in reps.columns:
            shapes = beside.filter("NOT plain").select("rid", "_over").distinct().join(reps.select("rid", "parts"), "rid")
            shapes = shapes.withColumns({"_p": F.struct("parts"), "_c": st_box("_over.minx", "_over.miny", "_over.maxx", "_over.maxy")})
            links.append(shapes.filter(within_distance("_p", "_c", eps)).select(F.col("rid").alias("a"), F.col("_over.rid").alias("b")))
        work, stuck = _cut(open_, keys, grow)
        work, stuck = materialize(work, "cut"), materialize(stuck, "stuck")
        if k == ROUNDS:
            work, stuck = None, work.unionAll(stuck)
        if not stuck.isEmpty():
            links.append(forest(_dealt(stuck, keys, stuck.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))), [*keys, "_lo", "_hi"]))
        if work is None or work.isEmpty():
            break
    links += [forest(w.withColumn("own", F.lit(0)), keys) for w in leaves]
    return reduce(DataFrame.unionAll, links)


def _label(reps: DataFrame, eps: float, cell: float) -> DataFrame:
    found = connected_components(neighbour_links(reps, eps, cell), "a", "b").withColumnRenamed("id", "rid")
    return reps.select("rid").join(found, "rid", "left").select(
        "rid", F.coalesce("label", "rid").alias("label"))


def _with_noise(reps: DataFrame, eps: float, cell: float, min_points: int) -> DataFrame:
    space = _Space(reps, eps, cell)
    degree = (space.run(_weights, located=True).groupBy(F.col("a").alias("rid"))
              .agg(F.sum("b").alias("v")))
    core = (reps.join(degree, "rid", "left")
            .filter(F.col("w") + F.coalesce("v", F.lit(0)) >= min_points).drop("v"))
    core = materialize(core, "cores")
    labels = materialize(_label(core, eps, cell), "labels")
    border = (space.run(_adopted, labels).groupBy(F.col("a").alias("rid"))
              .agg(F.min("b").alias("label")))
    return labels.unionByName(border)


def dbscan(df: DataFrame, by: list[str], eps: float, min_points: int = 1, id_col: str = "id",
           geom: str = "geom", cell: float | None = None, rectangles: bool = False) -> DataFrame:
    """Add ``cluster`` to polygons: the least id of the cluster, null for noise.

    Clusters never cross the values of ``by``. Two polygons are neighbours when they are at most
    ``eps`` apart. ``id_col`` must be a unique, non-negative bigint. A border member near several
    clusters goes to the one with the least label.
    """
    members = _members(df.filter(F.col(geom).isNotNull()), by, id_col, geom, rectangles)
    reps = materialize(_fold_copies(members, rectangles), "members")
    # wide cells put most members into one list only
    cell = cell or 4 * (suggest_cell(reps.withColumn("g", F.struct(*BOX)), "g") + eps)
    labels = (_label(reps, eps, cell) if min_points <= 1 else
              _with_noise(reps, eps, cell, min_points))
    keyed = reps.select("_by", *BOX, "_shape", "rid").join(labels, "rid", "left").drop("rid")
    of_member = (members.drop("parts").withColumnRenamed("rid", id_col)
                 .join(keyed, ["_by", *BOX, "_shape"])
                 .select(id_col, F.col("label").alias("cluster")))
    return df.join(of_member, id_col, "left")  # a null geometry is in no cluster
