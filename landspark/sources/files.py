"""Readers of feature files, gazetteers and landed documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import constants as K
from ..functions.geometry import let, st_from_parts, st_is_empty, vertex
from ..functions.text import parse_coordinates, sanitize_name, valid_ring
from ..session import once

CASE_SCHEMA = """id string, numeroProcesso string, grau string, dataAjuizamento string,
    classe struct<codigo:int,nome:string>, assuntos array<struct<codigo:int,nome:string>>,
    orgaoJulgador struct<codigo:int,nome:string,codigoMunicipioIBGE:string>,
    movimentos array<struct<nome:string,dataHora:string>>"""
EVICTION_ITEM = """struct<ID:string,post_title:string,post_name:string,post_date:string,post_modified:string,
    meta:map<string,string>,
    tax:struct<uf:array<string>,municipio:array<string>,status_conflito:array<string>,
      causa_do_conflito:array<string>>>"""
_RING = "struct<LinearRing:struct<coordinates:string>>"
_POLYGON = f"struct<outerBoundaryIs:{_RING},innerBoundaryIs:array<{_RING}>>"
_DATA = "array<struct<_name:string,value:string>>"
PLACEMARK_SCHEMA = f"""name string, Point struct<coordinates:string>, LineString struct<coordinates:string>,
    Polygon {_POLYGON}, MultiGeometry struct<Polygon:array<{_POLYGON}>,Point:array<struct<coordinates:string>>,
      LineString:array<struct<coordinates:string>>>,
    ExtendedData struct<Data:{_DATA},
      SchemaData:struct<SimpleData:array<struct<_name:string,_VALUE:string>>>>"""


def discover_layers(spark: SparkSession, root: str) -> DataFrame:
    """Spatial files below a folder: one per layer name, GeoJSON before shapefile. A layer is a file, or a folder
    of part files under the layer's name, as Spark writes it. Only the file listing is read."""
    layer = F.regexp_extract("path", r"(?i)^(.*\.(?:shp|geojson))(?:/part-[^/]*)?$", 1)
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
             .select(layer.alias("path")).filter("path <> ''").distinct())
    stem = F.regexp_extract("path", r"([^/=]+)\.[^.]+$", 1)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    named = files.select(sanitize_name(F.url_decode(stem)).alias("layer"), kind.alias("format"), "path")
    first = Window.partitionBy("layer").orderBy(F.col("format") != "geojson", "path")
    return named.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def _geojson_geometry(kind: Column, text: Column) -> Column:
    ring = lambda r: F.transform(r, lambda p: vertex(p[0], p[1]))
    part = lambda p: F.transform(p, ring)
    depth = lambda n: F.from_json(text, "array<" * n + "double" + ">" * n)
    point = depth(1)
    parts = (F.when(kind == "Point", F.array(F.array(F.array(vertex(point[0], point[1])))))
             .when(kind == "LineString", F.array(F.array(ring(depth(2)))))
             .when(kind == "MultiPoint", F.transform(depth(2), lambda p: F.array(F.array(vertex(p[0], p[1])))))
             .when(kind == "MultiLineString", F.transform(depth(3), lambda r: F.array(ring(r))))
             .when(kind == "Polygon", F.array(part(depth(3))))
             .when(kind == "MultiPolygon", F.transform(depth(4), part)))
    return st_from_parts(F.lower(kind), parts)


def _collected_polygons(members: Column) -> Column:
    """The polygons of a geometry collection as one multipolygon; null when it has none."""
    areas = F.filter(members, lambda m: m["type"].isin("Polygon", "MultiPolygon"))
    part = lambda p: F.transform(p, lambda r: F.transform(r, lambda q: vertex(q[0], q[1])))
    one = lambda m: F.from_json(m["coordinates"], "array<array<array<double>>>")
    many = lambda m: F.from_json(m["coordinates"], "array<array<array<array<double>>>>")
    parts = F.flatten(F.transform(areas, lambda m: F.when(m["type"] == "Polygon", F.array(part(one(m)))).otherwise(F.transform(many(m), part))))
    return F.when(F.size(areas) > 0, st_from_parts(F.lit("multipolygon"), parts))


_FEATURE_HEAD = r'\{\s*(?:"id"\s*:\s*(?:"(?:[^"\\]|\\.)*"|[-+.0-9eE]+)\s*,\s*)?"type"\s*:\s*$'


def _split_features(spark: SparkSession, path: str, feature: str) -> DataFrame:
    """Features of collections of any size, cut from byte ranges of the files.

    Records end at ``"Feature"``, the type of each feature, so a task starts at the first one in its range. What
    follows is that feature from its type on, and the beginning of the next. This holds where a feature begins
    with its type, or with its id and its type; anything else is an error, not a loss.
    """
    pieces = spark.read.option("lineSep", '"Feature"').text(path)
    own = F.col("value").rlike(r"^\s*[,}]")
    last = F.col("value").rlike(r"^\s*[,}][\s\S]*[}\]]\s*$")
    sound = F.col("value").rlike(_FEATURE_HEAD) | last | (~own & F.col("value").rlike(r'^\uFEFF?\s*\{[\s\S]*\}\s*$'))
    text = F.concat(F.lit('{"type":"Feature"'), F.col("value"))  # parsing ends where the object does
    checked = F.when(sound, text).otherwise(F.raise_error(F.lit("features that do not begin with their type cannot be read in parts")))
    return (pieces.select(own.alias("own"), checked.alias("text")).filter("own AND text IS NOT NULL")
            .select(F.from_json("text", feature).alias("f")).select("f.*"))


def read_geojson(spark: SparkSession, path: str, properties: str, lines: bool = False, split: bool = False) -> DataFrame:
    """Features of GeoJSON files as attribute columns and ``geom``.

    ``properties`` is the schema of the attributes. ``lines`` reads one feature per line, which
    splits over many tasks. A classic collection is read file by file, or with ``split`` in parts of files, so
    that one large document keeps many tasks busy. Heights are dropped. Of a
    ``GeometryCollection`` the polygons are kept.
    """
    feature = (f"type string, geometry struct<type:string,coordinates:string,geometries:array<struct<type:string,coordinates:string>>>, "
               f"properties struct<{_as_fields(properties)}>")
    if lines:
        rows = spark.read.schema(feature).json(path)
    elif split:
        rows = _split_features(spark, path, feature)
    else:
        rows = (spark.read.schema(f"features array<struct<{_as_fields(feature)}>>")
                .option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.*"))
    own = _geojson_geometry(F.col("geometry.type"), F.col("geometry.coordinates"))
    return rows.select("properties.*", F.when(F.col("geometry.type") == "GeometryCollection", _collected_polygons(
        F.col("geometry.geometries"))).otherwise(own).alias("geom"))


def _as_fields(ddl: str) -> str:
    out, depth, item = [], 0, ""
    for ch in ddl + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, kind = item.strip().split(None, 1)
            out.append(f"{name}:{kind}")
            item = ""
        else:
            item += ch
    return ",".join(out)


def _kml_part(p: Column) -> Column:
    ring = lambda r: valid_ring(parse_coordinates(r["LinearRing"]["coordinates"]))
    rings = F.concat(F.array(ring(p["outerBoundaryIs"])),
                     F.coalesce(F.transform(p["innerBoundaryIs"], ring), F.array().cast(
                         "array<array<struct<x:double,y:double>>>")))
    return let(rings, lambda v: F.when(v[0].isNotNull(), F.filter(v, lambda r: r.isNotNull())))


def _placemarks(spark: SparkSession, path: str) -> DataFrame:
    """Placemark elements, cut from byte ranges of the files, so that parts of a document, which are no documents of
    their own, are read as well as whole ones. A record ends with a start or end tag; those before an end tag count."""
    pieces = (spark.read.option("lineSep", "Placemark>").text(path)
              .select("value", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")))
    closed = pieces.filter(F.col("value").rlike(r"</(\w+:)?$"))
    body = F.regexp_replace(F.regexp_replace("value", r"</(\w+:)?$", ""), r"(?s)^.*<(\w+:)?Placemark\s[^>]*>", "")
    element = F.from_xml(F.concat(F.lit("<Placemark>"), body, F.lit("</Placemark>")), PLACEMARK_SCHEMA, {"ignoreNamespace": "true"})
    return once(closed.select(element.alias("p"), "file"), "p").select("p.*", "file")


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """Placemarks: ``name``, ``data`` (map of the extended attributes), ``geom``, ``file``.

    Rings with fewer than three readable vertices are skipped; heights are dropped. A ``MultiGeometry``
    gives its polygons; without any its lines, and without those its points.
    """
    rows = _placemarks(spark, path)
    data = F.coalesce(F.col("ExtendedData.Data"), F.array().cast(_DATA))
    simple = F.transform(F.coalesce(F.col("ExtendedData.SchemaData.SimpleData"), F.array().cast(
        "array<struct<_name:string,_VALUE:string>>")), lambda d: F.struct(
            d["_name"].alias("_name"), d["_VALUE"].alias("value")))
    pairs = F.filter(F.concat(data, simple), lambda d: d["_name"].isNotNull())
    # what is used more than once is a column of its own, so that it is worked out once
    rows = rows.select(
        "name", "file", "Polygon", "Point", "LineString", "MultiGeometry", pairs.alias("_pairs"), _kml_part(F.col("Polygon")).alias("_one"),
        F.filter(F.transform(F.col("MultiGeometry.Polygon"), _kml_part), lambda p: p.isNotNull()).alias("_many"),
        parse_coordinates(F.col("Point.coordinates")).alias("_xy"), parse_coordinates(F.col("LineString.coordinates")).alias("_line"),
        F.filter(F.transform("MultiGeometry.LineString", lambda m: parse_coordinates(m["coordinates"])), lambda r: F.size(r) > 0).alias("_lines"),
        F.filter(F.transform("MultiGeometry.Point", lambda m: parse_coordinates(m["coordinates"])), lambda r: F.size(r) > 0).alias("_spots"))
    one, many, xy, line, lines, spots = (F.col(c) for c in ("_one", "_many", "_xy", "_line", "_lines", "_spots"))
    # the first of several equal names counts
    firsts = lambda v: F.filter(v, lambda d, i: F.array_position(F.transform(v, lambda e: e["_name"]), d["_name"]) == i + 1)
    named = let(let(F.col("_pairs"), firsts), lambda v: F.map_from_arrays(F.transform(v, lambda d: d["_name"]), F.transform(v, lambda d: d["value"])))
    some = lambda a: F.coalesce(F.size(a), F.lit(0)) > 0
    gtype = (F.when(F.col("Polygon").isNotNull(), "polygon")
             .when(F.col("MultiGeometry").isNotNull() & (some("MultiGeometry.Polygon") | ~some(lines) & ~some(spots)), "multipolygon")
             .when(some(lines), "multilinestring").when(some(spots), "multipoint")
             .when(F.col("Point").isNotNull(), "point").when(F.col("LineString").isNotNull(), "linestring"))
    rows = rows.withColumn("_gtype", gtype)
    kind = F.col("_gtype")
    parts = (F.when((kind == "polygon") & one.isNotNull(), F.array(one)).when(kind == "multipolygon", many)
             .when(kind == "multilinestring", F.transform(lines, lambda r: F.array(r)))
             .when(kind == "multipoint", F.transform(spots, lambda r: F.array(r)))
             .when((kind == "point") & (F.size(xy) > 0), F.array(F.array(xy)))
             .when(kind == "linestring", F.array(F.array(line))))
    made = rows.select(F.trim("name").alias("name"), named.alias("data"), kind.alias("shape"), st_from_parts(kind, parts).alias("geom"), "file")
    return once(made, "geom")


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """``code, lon, lat, name`` from JSON objects keyed by municipality code. Records end at closing braces, so
    that a file is read by many tasks; a name with a brace in it is an error."""
    pieces = spark.read.option("lineSep", "}").text(path).filter(F.trim(F.translate("value", "\r\n\t", "   ")) != "")
    whole = r'^[\s,{]*"(\d+)"\s*:\s*(\{[^{}]*)$'
    entry = F.from_json(F.concat(F.regexp_extract("value", whole, 2), F.lit("}")), "lon double, lat double, name string")
    code = F.when(F.col("value").rlike(whole), F.regexp_extract("value", whole, 1)).otherwise(F.raise_error(F.lit("not an entry of a gazetteer")))
    rows = pieces.filter(~F.col("value").rlike(r"^\s*[{]?\s*$")).select(code.cast("int").alias("code"), entry.alias("v"))
    return rows.select("code", "v.lon", "v.lat", "v.name")


def read_cases(spark: SparkSession, folders: dict[str, str], pages: bool = False) -> DataFrame:
    """Landed court documents per court, one document per line, or result pages with hits."""
    out = None
    for court, path in folders.items():
        if pages:
            schema = f"hits struct<hits:array<struct<_source:struct<{_as_fields(CASE_SCHEMA)}>>>>"
            one = (spark.read.schema(schema).json(path).select(F.explode("hits.hits").alias("h"))
                   .select("h._source.*"))
        else:
            one = spark.read.schema(CASE_SCHEMA).json(path)
        one = one.withColumn("tribunal_source", F.lit(court))
        out = one if out is None else out.unionByName(one)
    return out


def search_cases(df: DataFrame, subjects: list[int], classes: list[int], like: str | None = None) -> DataFrame:
    """Cases with one of the subjects or classes and, if given, a case number like the pattern."""
    codes = F.transform("assuntos", lambda a: a["codigo"])
    hit = (F.coalesce(F.arrays_overlap(codes, F.array(*map(F.lit, subjects))), F.lit(False))
           | F.coalesce(F.col("classe.codigo").isin(classes), F.lit(False)))
    return df.filter(hit if like is None else hit & F.col("numeroProcesso").like(like))


def preset_cases(df: DataFrame) -> DataFrame:
    """The standing search for land cases: the target subjects or classes; of the federal court only
    numbers of the state's section."""
    federal = F.coalesce(F.col("tribunal_source") == K.FEDERAL_COURT, F.lit(False))
    found = search_cases(df, K.TARGET_SUBJECTS, K.TARGET_CLASSES)
    return found.filter(~federal | F.col("numeroProcesso").like(K.FEDERAL_CASE_PATTERN))


def read_evictions(spark: SparkSession, path: str) -> DataFrame:
    """Eviction reports, one row per entry of ``conflito``; ``seq`` numbers them 0, 1, ... by file name and
    place in the file, over all files. ``meta`` is a map, so that a missing key differs from a null."""
    from ..operators.rowid import with_row_id
    rows = spark.read.schema(f"conflito array<{EVICTION_ITEM}>").option("multiLine", True).json(path)
    placed = rows.select(F.input_file_name().alias("_file"), F.posexplode("conflito").alias("_at", "c"))
    return with_row_id(placed, ["_file", "_at"], "seq").select((F.col("seq") - 1).alias("seq"), "c.*")


def load_boundary(df: DataFrame, cell: float | None = None) -> DataFrame:
    """Union of all features of a boundary layer as one row; fails when there is none."""
    from ..operators.dissolve import dissolve
    rows = df.filter(~st_is_empty("geom")).select(F.lit(1).alias("_all"), "geom")
    if not rows.take(1):
        raise ValueError("the boundary layer is empty; pass no boundary to leave the test out")
    return dissolve(rows, ["_all"], cell).select("geom")


def sanitize_columns(df: DataFrame, keep: tuple[str, ...] = ("geometry", "geom")) -> DataFrame:
    """Identifier-safe column names; names that collide get a number."""
    spark, plain = df.sparkSession, [c for c in df.columns if c not in keep]
    if not plain:
        return df
    safe = spark.range(1).select(*[sanitize_name(F.lit(c)).alias(f"c{i}") for i, c in enumerate(plain)]).first()
    renamed, seen = dict(zip(plain, safe)), {c: 1 for c in keep}
    names = []
    for c in df.columns:
        name = renamed.get(c, c) or "column"
        if c not in keep:
            n = seen[name] = seen.get(name, 0) + 1
            name = name if n == 1 else f"{name}_{n}"
        names.append(name)
    return df.toDF(*names)
