"""Grouped counts, profiles and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K


def category_columns(category: str = "categoria_conflito",
                     mapping: dict[str, str] = K.CATEGORY_COLUMNS) -> list[Column]:
    return [F.count_if(F.col(category) == value).alias(name) for name, value in mapping.items()]


def category_counts(df: DataFrame, by: list[str], category: str = "categoria_conflito",
                    mapping: dict[str, str] = K.CATEGORY_COLUMNS) -> DataFrame:
    """Row count and one conditional count per listed category."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total_processos"),
                               *category_columns(category, mapping))


def municipality_rollup(cases: DataFrame) -> DataFrame:
    """Counts per municipality with the centroid of its case points."""
    return (cases.filter(F.col("municipio_ibge").isNotNull())
            .groupBy("municipio_ibge", "municipio_nome")
            .agg(F.count(F.lit(1)).alias("total_processos"), *category_columns(),
                 F.avg("lon").alias("lon"), F.avg("lat").alias("lat")))


def court_category_counts(cases: DataFrame) -> DataFrame:
    return (cases.groupBy("tribunal", "categoria_conflito").agg(F.count(F.lit(1)).alias("total"))
            .orderBy("tribunal", F.desc("total"), "categoria_conflito"))


def family_totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("conflitos"),
                  F.sum("familias_ameacadas").alias("familias_ameacadas"),
                  F.sum("familias_despejadas").alias("familias_despejadas"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Frequency and share of every value of the given columns. The total is counted with the
    values, so the input is read once."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value"))
                                for c in columns])).alias("p")
    counts = df.select(pairs).groupBy("p.attribute", "p.value").agg(F.count(F.lit(1)).alias("total"))
    totals = counts.groupBy("attribute").agg(F.sum("total").alias("_all"))
    return (counts.join(totals, "attribute")
            .withColumn("share", F.round(F.col("total") * 100.0 / F.col("_all"), 2)).drop("_all"))


def area_by(df: DataFrame, by: list[str], area: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.sum(area).alias("area"))


def verification_counts(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """Total and one count per predicate, in a single pass."""
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, c in predicates.items()])


def audit_counts(tables: dict[str, DataFrame], expected: DataFrame) -> DataFrame:
    """Row count of each table against ``expected(table_name, expected)``."""
    counted = reduce(DataFrame.unionAll, [df.agg(F.count(F.lit(1)).alias("actual")).select(
        F.lit(name).alias("table_name"), "actual") for name, df in tables.items()])
    status = (F.when(F.col("expected").isNull(), "unexpected").when(F.col("actual").isNull(), "missing")
              .when(F.col("actual") == F.col("expected"), "ok").otherwise("different"))
    return counted.join(expected, "table_name", "full").withColumn("status", status)
