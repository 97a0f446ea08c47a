"""Feature titles and KML / GeoJSON text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import constants as K
from .geometry import as_col, let, number_text
from .text import blank_to_null, date_ptbr, format_ptbr


def xml_escape(c) -> Column:
    out = F.coalesce(as_col(c).cast("string"), F.lit(""))
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(plain), F.lit(safe))
    return out


def kml_color(c, alpha: str = "ff") -> Column:
    """#RGB, #RRGGBB or #RRGGBBAA as AABBGGRR; black when missing or malformed."""
    raw = as_col(c)
    h = F.trim(F.replace(raw, F.lit("#"), F.lit("")))
    h = F.when(F.length(h) == 3, F.regexp_replace(h, "(.)", "$1$1")).otherwise(h)
    part = lambda i: F.substring(h, i, 2)
    made = (F.when(F.length(h) == 6, F.concat(F.lit(alpha), part(5), part(3), part(1)))
            .when(F.length(h) == 8, F.concat(part(7), part(5), part(3), part(1)))
            .otherwise(F.lit(alpha + "000000")))
    return F.when(raw.isNull() | (raw == ""), "ff000000").otherwise(F.lower(made))


def feature_title(columns: list[str], layer) -> Column:
    """First filled title attribute among the columns present, else layer and id."""
    found = [F.concat(F.lit(prefix), blank_to_null(name))
             for name, prefix in K.TITLE_ATTRIBUTES if name in columns]
    ids = [blank_to_null(c) for c in K.TITLE_ID_ATTRIBUTES if c in columns]
    last = F.concat(as_col(layer), F.lit(" (ID: "), F.coalesce(*ids, F.lit("1")), F.lit(")"))
    return F.coalesce(*found, last)


def _positions(ring) -> Column:
    return F.array_join(F.transform(ring, lambda p: F.concat(
        number_text(p["x"]), F.lit(","), number_text(p["y"]), F.lit(",0"))), " ")


def _ring_kml(ring) -> Column:
    return F.concat(F.lit("<LinearRing><coordinates>"), _positions(ring),
                    F.lit("</coordinates></LinearRing>"))


def _polygon_kml(part) -> Column:
    holes = F.array_join(F.transform(F.slice(part, 2, F.size(part)), lambda r: F.concat(
        F.lit("<innerBoundaryIs>"), _ring_kml(r), F.lit("</innerBoundaryIs>"))), "")
    return F.concat(F.lit("<Polygon><outerBoundaryIs>"), _ring_kml(part[0]),
                    F.lit("</outerBoundaryIs>"), holes, F.lit("</Polygon>"))


def _line_kml(part) -> Column:
    return F.concat(F.lit("<LineString><coordinates>"), _positions(part[0]),
                    F.lit("</coordinates></LineString>"))


def to_kml(g) -> Column:
    return let(as_col(g), _kml_of)


def _kml_of(g: Column) -> Column:
    one = g["parts"][0]
    many = lambda f: F.concat(F.lit("<MultiGeometry>"), F.array_join(F.transform(g["parts"], f), ""),
                              F.lit("</MultiGeometry>"))
    return F.coalesce(
        F.when(g["gtype"] == "point", F.concat(F.lit("<Point><coordinates>"), _positions(one[0]),
                                               F.lit("</coordinates></Point>")))
        .when(g["gtype"] == "linestring", _line_kml(one))
        .when(g["gtype"] == "multilinestring", many(_line_kml))
        .when(g["gtype"] == "polygon", _polygon_kml(one))
        .when(g["gtype"] == "multipolygon", many(_polygon_kml)), F.lit(""))


def _pairs(columns: list[str]) -> Column:
    """Name and text of the columns that are not null, in column order."""
    rows = F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in columns])
    return F.filter(rows, lambda r: r["v"].isNotNull())


def extended_data(columns: list[str]) -> Column:
    tags = F.transform(_pairs(columns), lambda r: F.concat(
        F.lit('<Data name="'), xml_escape(r["k"]), F.lit('"><value>'), xml_escape(r["v"]),
        F.lit("</value></Data>")))
    return F.concat(F.lit("<ExtendedData>"), F.array_join(tags, ""), F.lit("</ExtendedData>"))


def _shown(name: str, types: dict[str, str]) -> Column:
    """Value of an attribute as people read it: areas and dates in Brazilian style."""
    c, text = F.col(name), F.col(name).cast("string")
    if "area" in name:
        n = text.try_cast("double")
        return F.when(n.isNotNull(), F.concat(format_ptbr(n, 4), F.lit(" ha"))).otherwise(text)
    if "data" in name:
        day = c if types.get(name) in ("date", "timestamp", "timestamp_ntz") else text.try_cast("date")
        return F.coalesce(date_ptbr(day), text)
    return text


def html_table(columns: list[str], types: dict[str, str] | None = None) -> Column:
    """Rows of a description table, technical and blank attributes left out."""
    cells = []
    for name in columns:
        if name.lower() in K.TABLE_SKIPPED:
            continue
        title = " ".join(w[:1].upper() + w[1:] for w in name.replace("_", " ").split(" "))
        value = F.when(F.col(name).cast("string") != "", _shown(name, types or {}))
        cells.append(F.when(value.isNotNull(), F.concat(
            F.lit(f"<tr><td>{title}:</td><td>"), xml_escape(value), F.lit("</td></tr>"))))
    return F.concat(F.lit("<table>"), F.concat_ws("", *cells), F.lit("</table>"))


def placemark(columns: list[str], layer, geom: str = "geom", style=None,
              types: dict[str, str] | None = None) -> Column:
    title = feature_title(columns, layer)
    link = F.lit("") if style is None else F.concat(F.lit("<styleUrl>#"), as_col(style), F.lit("</styleUrl>"))
    return F.concat(F.lit("<Placemark><name>"), xml_escape(title), F.lit("</name>"), link,
                    F.lit("<description><![CDATA["), html_table(columns, types), F.lit("]]></description>"),
                    extended_data(columns), to_kml(geom), F.lit("</Placemark>"))


def _position_json(p) -> Column:
    return F.concat(F.lit("["), number_text(p["x"]), F.lit(","), number_text(p["y"]), F.lit("]"))


def _list_json(arr, f) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(arr, f), ","), F.lit("]"))


def to_geojson(g) -> Column:
    """GeoJSON geometry text."""
    g = as_col(g)
    ring = lambda r: _list_json(r, _position_json)
    part = lambda p: _list_json(p, ring)
    one = g["parts"][0]
    shapes = [("point", "Point", _position_json(one[0][0])), ("linestring", "LineString", ring(one[0])),
              ("multilinestring", "MultiLineString", _list_json(g["parts"], lambda p: ring(p[0]))),
              ("polygon", "Polygon", part(one)), ("multipolygon", "MultiPolygon", _list_json(g["parts"], part))]
    out = F
    for gtype, name, text in shapes:
        out = out.when(g["gtype"] == gtype, F.concat(F.lit(f'{{"type":"{name}","coordinates":'), text, F.lit("}")))
    return out.otherwise(F.lit("null"))


def geojson_feature(columns: list[str], geom: str = "geom") -> Column:
    return F.concat(F.lit('{"type":"Feature","geometry":'), to_geojson(geom), F.lit(',"properties":'),
                    F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), F.lit("}"))
