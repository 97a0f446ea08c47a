"""Surrogate row numbers without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize

_ROW_BITS = 33  # monotonically_increasing_id: partition above, row in partition below


def with_row_id(df: DataFrame, order_by: list, name: str = "id") -> DataFrame:
    """Number the rows 1, 2, ... in the given order.

    Rows are range-sorted and written once; the number is the position inside the written
    partition plus the sizes of the partitions before it. Only that list of sizes, one row per
    partition, passes through a single task. The order should be unique.
    """
    placed = materialize(df.sort(*order_by).withColumn("_m", F.monotonically_increasing_id()), "rows")
    part = F.shiftright("_m", _ROW_BITS)
    rank = F.col("_m") - F.shiftleft(part, _ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (placed.withColumn("_part", part).withColumn("_rank", rank)
            .join(F.broadcast(starts), "_part")  # as many rows as partitions
            .select((F.col("_start") + F.col("_rank") + 1).alias(name),
                    *[F.col(c) for c in df.columns]))
