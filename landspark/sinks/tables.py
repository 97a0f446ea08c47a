"""Writers of tables and feature files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .. import constants as K
from ..functions.geometry import as_col
from ..functions.kml import geojson_feature, kml_color, placemark, xml_escape
from ..functions.text import safe_filename
from ..operators.rows import last_per_key

DOCUMENT_ROWS = 50_000  # items of one written document, about


def replace_table(df: DataFrame, name: str) -> None:
    df.write.mode("overwrite").saveAsTable(name)


def rebuild(name: str, df: DataFrame) -> DataFrame:
    """Drop and rebuild a derived table, then read it."""
    replace_table(df, name)
    return df.sparkSession.table(name)


def load_if_empty(df: DataFrame, name: str, force: bool = False) -> bool:
    """Write unless the table already has rows; tells whether it wrote."""
    spark = df.sparkSession
    if not force and spark.catalog.tableExists(name) and spark.table(name).take(1):
        return False
    replace_table(df, name)
    return True


def upsert(target: DataFrame, updates: DataFrame, key: str, kept: list[str] = (), order: list = ()) -> DataFrame:
    """Target with the rows of ``updates`` put in by key. Columns in ``kept``, and any that updates
    lack, stay as they are in rows that existed before. Of several updates of a key the last in
    ``order`` counts; without an order any one of them. Updates may not have columns of their own."""
    if extra := [c for c in updates.columns if c not in target.columns and c not in order]:
        raise ValueError(f"the target lacks {', '.join(extra)}")
    updates = last_per_key(updates, [key], list(order) or [F.lit(0)]).select([c for c in updates.columns if c in target.columns])
    kept = [c for c in target.columns if c in kept or c not in updates.columns]
    held = target.select(key, *[F.col(c).alias("_old_" + c) for c in kept])
    fresh = updates.drop(*kept).join(held, key, "left")
    fresh = fresh.select(*[F.col("_old_" + c).alias(c) if c in kept else F.col(c) for c in target.columns])
    return target.join(updates.select(key), key, "left_anti").select(*target.columns).unionByName(fresh)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_geojson(df: DataFrame, path: str, geom: str = "geom") -> None:
    """One feature per line."""
    columns = [c for c in df.columns if c != geom]
    df.select(geojson_feature(columns, geom)).write.mode("overwrite").text(path)


def _documents(head: str, between: str, tail: str, rows: int):
    """Texts of a task framed as documents of ``rows`` items; the last may have fewer. A text is one record."""
    def work(batches):
        n, held = 0, None  # the last text waits, as it may have to end a document
        for batch in batches:
            out = [] if held is None else [held]
            for v in batch.column(0).to_pylist():
                if v is not None:
                    out.append((between if n % rows else head) + v + ("" if (n + 1) % rows else tail))
                    n += 1
            held = out.pop() if out else None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held + tail if n % rows else held], pa.string())], names=["value"])
    return work


def write_documents(items: DataFrame, path: str, head: str, tail: str, between: str = "", rows: int = DOCUMENT_ROWS) -> None:
    """Write a column of texts as complete documents of at most ``rows`` items, one per part file.

    Each task frames its own share, so nothing passes through one task, and Spark's commit makes a document visible
    only when it is whole. Small documents are several to a task, which begins a file after every ``rows`` items. The
    items of a document come in no particular order.
    """
    values = items.toDF("value").select(F.col("value").cast("string"))
    documents = max(1, -(-values.count() // rows))
    values = values.repartition(-(-documents // max(1, DOCUMENT_ROWS // rows)))
    (values.mapInArrow(_documents(head, between, tail, rows), "value string").write.mode("overwrite")
     .option("maxRecordsPerFile", rows).text(path))


def write_geojson_collections(df: DataFrame, path: str, geom: str = "geom", rows: int = DOCUMENT_ROWS) -> None:
    """Classic feature collections, complete ones of bounded size."""
    columns = [c for c in df.columns if c != geom]
    write_documents(df.select(geojson_feature(columns, geom)), path, '{"type":"FeatureCollection","features":[', "]}", ",", rows)


def write_placemarks(placemarks: DataFrame, path: str, document: str, rows: int = DOCUMENT_ROWS) -> None:
    """Ready-made placemark elements as complete KML documents of bounded size."""
    name = document.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    write_documents(placemarks, path, f'<?xml version="1.0" encoding="UTF-8"?><kml xmlns="{K.KML_NAMESPACE}"><Document><name>{name}</name>',
                    "</Document></kml>", rows=rows)


def kml_lines(df: DataFrame, document: str, layer: str = "layer", layer_id: str | None = None,
              fill: str | None = None, stroke: str | None = None, geom: str = "geom",
              order: list[str] = ()) -> DataFrame:
    """Lines of one KML document, to be put in order of ``section, layer, step`` and the given
    columns: head, one style per layer and colours, a folder with its count per layer, the features,
    the end. No layer has to fit into one row."""
    col = lambda c, default: F.lit(default) if c is None else F.coalesce(as_col(c), F.lit(default))
    lid, fills, strokes = col(layer_id, "layer"), col(fill, K.DEFAULT_FILL), col(stroke, K.DEFAULT_STROKE)
    skip = {geom, layer, layer_id, fill, stroke}
    columns = [c for c in df.columns if c not in skip]
    style = F.concat_ws("_", F.lit("style"), safe_filename(lid), F.regexp_replace(fills, "#", ""),
                        F.regexp_replace(strokes, "#", ""))
    styled = df.withColumns({"_style": style, "_fill": kml_color(fills, "66"), "_stroke": kml_color(strokes)})
    key = F.array(*[F.col(c).cast("string") for c in order]) if order else F.array().cast("array<string>")
    none = F.array().cast("array<string>")

    def line(section: int, name, step: int, text, k=none):
        return [F.lit(section).alias("section"), as_col(name).alias("layer"), F.lit(step).alias("step"),
                k.alias("key"), text.alias("text")]

    spark = df.sparkSession
    one = spark.range(1)
    head = one.select(*line(0, F.lit(""), 0, F.concat(F.lit(
        f'<?xml version="1.0" encoding="UTF-8"?><kml xmlns="{K.KML_NAMESPACE}"><Document><name>'),
        xml_escape(F.lit(document)), F.lit("</name>"))))
    styles = styled.select("_style", "_fill", "_stroke").distinct().select(*line(
        1, F.lit(""), 0, F.concat(
            F.lit('<Style id="'), F.col("_style"), F.lit('"><LineStyle><color>'), F.col("_stroke"),
            F.lit("</color><width>2.2</width></LineStyle><PolyStyle><color>"), F.col("_fill"),
            F.lit("</color><fill>1</fill><outline>1</outline></PolyStyle><IconStyle><color>"),
            F.col("_stroke"), F.lit("</color><scale>1.1</scale></IconStyle></Style>")),
        F.array("_style")))
    opened = df.groupBy(layer).agg(F.count(F.lit(1)).alias("_n"))
    folders = opened.select(*line(2, layer, 0, F.concat(
        F.lit("<Folder><name>"), xml_escape(layer), F.lit(" ("), F.col("_n").cast("string"), F.lit(")</name>"))))
    closed = opened.select(*line(2, layer, 2, F.lit("</Folder>")))
    body = styled.select(*line(2, layer, 1, placemark(columns, F.col(layer), geom, F.col("_style"),
                                                      dict(df.dtypes)), key))
    tail = one.select(*line(3, F.lit(""), 0, F.lit("</Document></kml>")))
    out = head
    for part in (styles, folders, body, closed, tail):
        out = out.unionByName(part)
    return out


def write_kml(df: DataFrame, path: str, document: str, single_file: bool = False, **options) -> None:
    """Write a KML document; its part files, taken in name order, form the document."""
    lines = kml_lines(df, document, **options).sort("section", "layer", "step", "key").select("text")
    (lines.coalesce(1) if single_file else lines).write.mode("overwrite").text(path)


def write_clustered(df: DataFrame, path: str, cell: float, partitions: int | None = None,
                    geom: str = "geom") -> None:
    """Features of one area in one file, so that box statistics let a scan skip the others."""
    g = F.col(geom)
    cx, cy = (F.floor(g[c] / cell).cast("int") for c in ("minx", "miny"))
    # interleaved bits keep neighbouring cells together
    # of 31 bits each: cells up to a billion from the origin
    spread = lambda v: F.conv(F.regexp_replace(F.lpad(F.bin(v.cast("bigint") + F.lit(2 ** 30)), 31, "0"),
                                               "([01])", "0$1"), 2, 10).cast("bigint")
    z = spread(cx) + F.lit(2) * spread(cy)
    ranged = df.withColumn("_z", z)
    ranged = ranged.repartitionByRange(partitions, "_z") if partitions else ranged.repartitionByRange("_z")
    ranged.sortWithinPartitions("_z").drop("_z").write.mode("overwrite").parquet(path)
