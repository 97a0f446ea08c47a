"""Session defaults and the shared scratch area used to cut long lineages."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def get_spark(app: str = "landspark", cores: str | int = "*", partitions: int = 8,
              memory: str = "12g") -> SparkSession:
    """A local session with the settings the library expects (UTC, AQE, skew handling).

    On a cluster build the session as usual; nothing below is required for right results
    except the UTC time zone.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        here = os.path.dirname(os.path.abspath(__file__))
        base = os.path.join(tempfile.mkdtemp(prefix="spark-"), "landspark")  # the driver serves it from here
        spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(here), "landspark"))
        _SHIPPED.add(app)


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    It has to be visible to every executor, so a machine-local folder is only made up when the
    session itself is local and names none.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/landspark-{label}-{uuid.uuid4().hex}"


def shares(spark: SparkSession) -> int:
    """Tasks for work that costs far more than its bytes tell, by which small inputs would be put in one task."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def room_for_repeats(spark: SparkSession, size: int) -> None:
    """Let the Parquet files that this session writes keep repeated values of ``size`` bytes together once each.

    Beyond the size of its dictionary, 1 MB unless set, a file has a value again in every row. What is read is the same; a
    larger size that is set already stays.
    """
    name = "parquet.dictionary.page.size"
    held = spark.conf.get(name, None) or spark.conf.get(f"spark.hadoop.{name}", None) or 2**20
    if 2 * size > int(held):
        spark.conf.set(name, str(min(2 * size, 2**31 - 1)))


def once(df: DataFrame, column: str) -> DataFrame:
    """The rows, with a costly column worked out once. A filter on a projected column is pushed below its expression,
    which is then worked out again for every use the filter makes of it; a generated column stays where it is."""
    return df.select(*[F.explode(F.array(c)).alias(c) if c == column else c for c in df.columns])


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Later stages then restart from files when an executor is lost, and read only the columns
    they need.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
