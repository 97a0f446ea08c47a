"""Row-order operators: first per key, occurrence numbers, history, paging, top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geometry import as_col
from ..session import materialize


def _one_per_key(df: DataFrame, keys: list[str], by: Column) -> DataFrame:
    rows = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(by)))
    return rows.filter("_rank = 1").drop("_rank")


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row of each key. Spark keeps one row per key and task before the shuffle (``WindowGroupLimit``), so a key with
    very many rows sends one row per task; columns that nothing uses later are not shuffled."""
    return _one_per_key(df, keys, F.struct(*[as_col(c) for c in order]).asc())


def last_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return _one_per_key(df, keys, F.struct(*[as_col(c) for c in order]).desc())


def top_by_priority(df: DataFrame, key: list[str], priority: list) -> DataFrame:
    return first_per_key(df, key, priority)


def _laid_out(df: DataFrame, keys: dict[str, Column], order: str) -> tuple[DataFrame, list[str]]:
    """The rows in order of key and ``order``, written once, with their partition ``_part`` and place ``_m``."""
    ks = [f"_k_{n}" for n in keys]
    placed = df.withColumns({f"_k_{n}": c for n, c in keys.items()}).sort(*ks, order)
    placed = materialize(placed.withColumn("_m", F.monotonically_increasing_id()), "sorted")
    return placed.withColumn("_part", F.shiftright("_m", 33)), ks


def _at_borders(placed: DataFrame, ks: list[str], *aggs: Column) -> DataFrame:
    """Aggregates of the first and the last key of each partition: at most two rows per partition.

    Only such a key can go on in another partition, whatever the number of its rows.
    """
    key = F.struct(*ks)
    ends = placed.groupBy("_part").agg(F.min_by(key, "_m").alias("_low"), F.max_by(key, "_m").alias("_high"))
    near = placed.join(F.broadcast(ends), "_part").filter(key.eqNullSafe(F.col("_low")) | key.eqNullSafe(F.col("_high")))
    return near.groupBy("_part", *ks).agg(*aggs)


def _carried(placed: DataFrame, borders: DataFrame, ks: list[str], names: list[str]) -> DataFrame:
    """What the earlier partitions hand on to the rows of the same key; null where nothing does."""
    here = borders.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"{k}_") for k in ks], *names)
    same = F.col("_part") == F.col("_p")
    for k in ks:
        same &= F.col(k).eqNullSafe(F.col(f"{k}_"))
    return placed.join(F.broadcast(here), same, "left").drop("_p", *[f"{k}_" for k in ks])


def occurrence_index(df: DataFrame, keys: dict[str, Column], seq: str, name: str = "occurrence") -> DataFrame:
    """0 for the first row of a key in ``seq`` order, 1 for the next and so on.

    ``seq`` is unique within the key. The rows are sorted over all partitions by key and ``seq`` and numbered
    within each; a key that goes on from earlier partitions starts at the number of its rows there. So a key
    with most of the rows is numbered by as many tasks as it fills, however its ``seq`` is spread.
    """
    placed, ks = _laid_out(df, keys, seq)
    earlier = Window.partitionBy(*ks).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    borders = _at_borders(placed, ks, F.count(F.lit(1)).alias("_n")).withColumn("_start", F.sum("_n").over(earlier))
    inside = F.row_number().over(Window.partitionBy("_part", *ks).orderBy("_m")) - 1
    return (_carried(placed.withColumn("_i", inside), borders, ks, ["_start"])
            .withColumn(name, (F.coalesce("_start", F.lit(0)) + F.col("_i")).cast("bigint"))
            .drop("_i", "_start", "_m", "_part", *ks))


def history_delta(df: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Change of a value against the version before and against the first version.

    ``order`` is unique within the key. As for occurrence numbers, versions are compared within
    sorted partitions; a key that goes on takes its last and its first value from the partitions before.
    """
    placed, ks = _laid_out(df, {k: F.col(k) for k in key}, order)
    ends = _at_borders(placed, ks, F.min_by(F.struct(value), "_m").alias("_low"), F.max_by(F.struct(value), "_m").alias("_high"))
    w = Window.partitionBy(*ks).orderBy("_part")
    borders = ends.select("_part", *ks, F.lag("_high").over(w).alias("_carried"), F.first("_low").over(w).alias("_earliest"))
    here = Window.partitionBy("_part", *ks).orderBy("_m")
    marked = placed.withColumns({"_near": F.lag(F.struct(value)).over(here), "_first": F.first(F.struct(value)).over(here)})
    marked = _carried(marked, borders, ks, ["_carried", "_earliest"])
    before = F.coalesce("_near", "_carried")[value]
    return (marked.withColumns({"delta_previous": F.coalesce(F.col(value) - before, F.lit(0)),
                                "delta_first": F.col(value) - F.coalesce("_earliest", "_first")[value]})
            .drop("_m", "_part", "_near", "_first", "_carried", "_earliest", *ks))


def last_movement(movements) -> Column:
    """Last element of the movement list, by position."""
    m = as_col(movements)
    return F.when(F.size(m) > 0, F.element_at(m, -1))


def movement_count(movements) -> Column:
    return F.greatest(F.coalesce(F.size(as_col(movements)), F.lit(0)), F.lit(0))


def page_after(df: DataFrame, filed: str, key: str, n: int, after: tuple | None = None) -> DataFrame:
    """Page of ``n`` rows, newest first and by key within a moment, after the given sort values."""
    if after is not None:
        when, last = F.lit(after[0]), F.lit(after[1])
        df = df.filter((F.col(filed) < when) | ((F.col(filed) == when) & (F.col(key) > last)))
    return df.orderBy(F.col(filed).desc(), F.col(key)).limit(n)


def top_counts(df: DataFrame, column: str, n: int = 8) -> DataFrame:
    return (df.groupBy(column).agg(F.count(F.lit(1)).alias("total"))
            .orderBy(F.desc("total"), column).limit(n))
