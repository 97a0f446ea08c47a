"""Grid join: the equi-join form of "boxes that meet".

Each input is written once, its rows numbered. From there on only numbers and boxes move: they are spread over the
grid cells that the boxes touch and joined on the cell. A pair is kept only in the cell holding the lower-left corner of
the shared box, so no ``distinct`` is needed. The columns and geometries of a pair are fetched by number at the end, so
no geometry crosses the shuffle of cells, however many cells it touches.

Cells are counted first, from the boxes alone. A cell is hot if its rows of the two sides make more than ``HOT_PAIRS``
comparisons, a fixed number at every size of the data. Hot cells are cut into finer cells, and where
that does not help (copies on one spot) both sides are salted, so no task receives a whole hot cell.
The list of hot cells grows with the data. It is written and joined like any table: Spark broadcasts it
below its size limit, and shuffles it and splits skewed keys beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import as_col
from ..session import materialize

HOT_PAIRS = 400_000_000  # comparisons in one cell
HOT_ROWS = 20_000        # rows of one side in one share of a cell that cutting did not thin out
MAX_SPLIT = 64


def cell_of(v: Column, cell: float) -> Column:
    return F.floor(v / F.lit(float(cell)))


def spread(df: DataFrame, geom, cell: float, grow: float = 0.0) -> DataFrame:
    """One row per grid cell touched by the box of ``geom``, in columns ``_cx`` and ``_cy``."""
    g = as_col(geom)
    return (df
            .withColumn("_cx", F.explode(F.sequence(cell_of(g["minx"] - grow, cell),
                                                    cell_of(g["maxx"] + grow, cell))))
            .withColumn("_cy", F.explode(F.sequence(cell_of(g["miny"] - grow, cell),
                                                    cell_of(g["maxy"] + grow, cell)))))


def _materialized(found: DataFrame) -> DataFrame | None:
    found = materialize(found, "hot")
    return None if found.isEmpty() else found


def hot_groups(rows: DataFrame, keys: list[str], floor: int = HOT_ROWS) -> DataFrame | None:
    """Groups above ``floor`` rows with ``_split``, the number of shares they need. None when there is
    none, which is the usual case."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return _materialized(counts.filter(F.col("_n") > floor).select(*keys, F.ceil(F.col("_n") / F.lit(floor)).cast("int").alias("_split")))


def sub_cell(v: Column, base: Column, cell: float, split: Column) -> Column:
    i = F.floor((v - base * F.lit(float(cell))) * split / F.lit(float(cell)))
    return F.least(F.greatest(i, F.lit(0)), split - 1).cast("int")


def cut_hot_cells(df: DataFrame, geom, cell: float, hot: DataFrame, keys: list[str],
                  grow: float = 0.0) -> DataFrame:
    """Spread rows of hot cells further over ``_k`` x ``_k`` finer cells ``_sx``, ``_sy``."""
    g = as_col(geom)
    k = F.least(F.ceil(F.sqrt(F.coalesce(F.col("_split"), F.lit(1)))), F.lit(MAX_SPLIT)).cast("int")
    out = df.join(hot, keys, "left").withColumn("_k", k).drop("_split")

    def steps(low, high, base):
        return F.explode(F.sequence(sub_cell(low - grow, base, cell, F.col("_k")),
                                    sub_cell(high + grow, base, cell, F.col("_k"))))

    return (out.withColumn("_sx", steps(g["minx"], g["maxx"], F.col("_cx")))
            .withColumn("_sy", steps(g["miny"], g["maxy"], F.col("_cy"))))


def _shares(rows: DataFrame, keys: list[str], floor: int, name: str) -> DataFrame | None:
    hot = hot_groups(rows, keys, floor)
    return None if hot is None else hot.withColumnRenamed("_split", name)


def _salt(df: DataFrame, own: str, other: str, own_key: list[str]) -> DataFrame:
    """Own rows take one share each and are repeated for every share of the other side."""
    return (df.withColumn(f"{own}_salt", F.pmod(F.xxhash64(*own_key), F.col(own)).cast("int"))
            .withColumn(f"{other}_salt", F.explode(F.sequence(F.lit(0), F.col(other) - 1))))


def _with_shares(df: DataFrame, tables: list, keys: list[str]) -> DataFrame:
    for table, name in tables:
        df = (df.withColumn(name, F.lit(1)) if table is None else
              df.join(table, keys, "left").withColumn(name, F.coalesce(name, F.lit(1))))
    return df


def numbered(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once, with a number of their own."""
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), "side")


def grid_pairs(left: DataFrame, right: DataFrame, cell: float, grow: float = 0.0, hot_rows: int = HOT_ROWS,
               hot_pairs: int | None = None) -> DataFrame:
    """``_l, _r`` of all pairs whose boxes meet (the right one grown by ``grow``), each exactly once.

    The sides hold a number (``_l``, ``_r``) and a box (``_lb``, ``_rb``, with ``minx`` to ``maxy``) only.
    """
    lg, rg = F.col("_lb"), F.col("_rb")
    l, r = spread(left, lg, cell), spread(right, rg, cell, grow)
    keys = ["_cx", "_cy"]
    x = F.greatest(lg["minx"], rg["minx"] - grow)
    y = F.greatest(lg["miny"], rg["miny"] - grow)
    here = (cell_of(x, cell) == F.col("_cx")) & (cell_of(y, cell) == F.col("_cy"))

    # one count of the cells of both sides tells which are hot
    sides = l.select(*keys, F.lit(0).alias("_right")).unionAll(r.select(*keys, F.lit(1).alias("_right")))
    counts = sides.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum("_right").alias("_right"))
    pairs, limit = (F.col("_n") - F.col("_right")) * F.col("_right"), hot_pairs or min(HOT_PAIRS, hot_rows * hot_rows)
    hot = _materialized(counts.filter(pairs > limit).select(*keys, F.least(F.ceil(pairs / F.lit(limit)), F.lit(MAX_SPLIT**2)).cast("int").alias("_split")))
    if hot is not None:
        l = cut_hot_cells(l, lg, cell, hot, keys)
        r = cut_hot_cells(r, rg, cell, hot, keys, grow)
        here &= ((sub_cell(x, F.col("_cx"), cell, F.col("_k")) == F.col("_sx"))
                 & (sub_cell(y, F.col("_cy"), cell, F.col("_k")) == F.col("_sy")))
        keys = keys + ["_k", "_sx", "_sy"]
        shares = [(_shares(l.select(*keys), keys, hot_rows, "_ls"), "_ls"),
                  (_shares(r.select(*keys), keys, hot_rows, "_rs"), "_rs")]
        if any(t is not None for t, _ in shares):
            l = _salt(_with_shares(l, shares, keys), "_ls", "_rs", ["_l"]).drop("_ls", "_rs")
            r = _salt(_with_shares(r, shares, keys), "_rs", "_ls", ["_r"]).drop("_ls", "_rs")
            keys = keys + ["_ls_salt", "_rs_salt"]

    meet = ((lg["minx"] <= rg["maxx"] + grow) & (rg["minx"] - grow <= lg["maxx"])
            & (lg["miny"] <= rg["maxy"] + grow) & (rg["miny"] - grow <= lg["maxy"]))
    # the planner does not see how far the cells multiply rows, so neither side may be broadcast
    return l.join(r.hint("merge"), keys).filter(meet & here).select("_l", "_r")


def grid_join(left: DataFrame, right: DataFrame, cell: float, left_geom: str, right_geom: str, grow: float = 0.0,
              hot_rows: int = HOT_ROWS, hot_pairs: int | None = None) -> DataFrame:
    """All pairs of rows whose boxes meet (the right one grown by ``grow``), each exactly once.

    Column names of the two sides must differ.
    """
    l, r = numbered(left, "_l"), numbered(right, "_r")
    box = lambda g: F.struct(*[F.col(g)[c].alias(c) for c in ("minx", "miny", "maxx", "maxy")])
    pairs = grid_pairs(l.select("_l", box(left_geom).alias("_lb")), r.select("_r", box(right_geom).alias("_rb")), cell, grow, hot_rows, hot_pairs)
    return pairs.join(r, "_r").join(l, "_l").select(*[c for c in left.columns], *[c for c in right.columns])


def suggest_cell(df: DataFrame, geom: str, share: float = 0.9) -> float:
    """Cell size from the box sizes: most boxes then touch at most four cells. Of points and the like, from their
    mean distance; any size will do for a single one."""
    g = F.col(geom)
    size = F.greatest(g["maxx"] - g["minx"], g["maxy"] - g["miny"])
    extent = F.greatest(F.max(g["maxx"]) - F.min(g["minx"]), F.max(g["maxy"]) - F.min(g["miny"]))
    got = df.agg(F.percentile_approx(size, share, 1000), F.max(size), extent / F.sqrt(F.count(size))).first()
    return float(next((v for v in got if v), 1.0))
