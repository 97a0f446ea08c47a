"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import materialize

SPACE = " \t\n\x0b\x0c\r"  # the six characters that part words
_SPACE_RUN = r"[\x20\x09-\x0D]+"
_ROW_BITS = 33  # monotonically_increasing_id: partition above, row in partition below


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Words of a text as an array; empty for a null text or one without words."""
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(bare.isNull() | (bare == ""), F.array().cast("array<string>")).otherwise(F.split(bare, _SPACE_RUN))


def word_count(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(bare.isNull() | (bare == ""), F.lit(0)).otherwise(F.size(F.split(bare, _SPACE_RUN))).cast("long")


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text; empty for null."""
    return F.coalesce(F.unhex(F.md5(text)), F.lit(bytearray()))


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """The row as one struct ``_row``, so that columns made beside it cannot clash with its own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[c.alias(n) for n, c in more.items()])


def unpacked(df: DataFrame, columns: list[str], *more: Column) -> DataFrame:
    """The columns of ``_row`` again, with ``more`` beside them."""
    return df.select(*[F.col(f"_row.`{c}`").alias(c) for c in columns], *more)


def running_total(df: DataFrame, order_by: list, amount: str, name: str) -> DataFrame:
    """``df`` with the sum of ``amount`` over all rows up to and including its own, in the given order.

    The rows are range-sorted and written once. Each written partition is summed by itself; only
    the list of those sums, one row per partition, passes through a single task.
    """
    placed = materialize(df.sort(*order_by).withColumn("_m", F.monotonically_increasing_id()), "total")
    placed = placed.withColumn("_part", F.shiftright("_m", _ROW_BITS))
    sums = placed.groupBy("_part").agg(F.sum(amount).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)
    return (placed.join(F.broadcast(starts), "_part")  # as many rows as partitions
            .select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_start") + F.sum(amount).over(inside)).alias(name)))
