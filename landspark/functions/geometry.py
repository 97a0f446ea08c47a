"""Geometry columns built from nested arrays.

A geometry is ``struct<gtype, parts, minx, miny, maxx, maxy>``; ``parts`` holds polygons, each a
list of rings (the first is the shell), each a closed list of vertices. Points and lines use the
same nesting. Keeping the box beside the vertices lets Parquet statistics prune row groups, and
every function here is a plain column expression.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

RING_TYPE = "array<struct<x:double,y:double>>"
PARTS_TYPE = f"array<array<{RING_TYPE}>>"
GEOM_TYPE = (f"struct<gtype:string,parts:{PARTS_TYPE},"
             "minx:double,miny:double,maxx:double,maxy:double>")
EARTH_RADIUS_M = 6371007.1809  # radius of the sphere with the area of the WGS84 ellipsoid
WGS84_E2 = 0.0066943799901413165


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f) -> Column:
    """``f`` of a value worked out once. Inside a lambda an outer expression is evaluated again for
    every element; a lambda variable is not."""
    return F.transform(F.array(value), f)[0]


def vertex(x, y) -> Column:
    return F.struct(as_col(x).cast("double").alias("x"), as_col(y).cast("double").alias("y"))


def _geom(gtype: Column, parts: Column, minx, miny, maxx, maxy) -> Column:
    return F.struct(gtype.alias("gtype"), parts.alias("parts"), minx.alias("minx"),
                    miny.alias("miny"), maxx.alias("maxx"), maxy.alias("maxy"))


def st_point(x, y) -> Column:
    x, y = as_col(x).cast("double"), as_col(y).cast("double")
    made = _geom(F.lit("point"), F.array(F.array(F.array(vertex(x, y)))), x, y, x, y)
    return F.when(x.isNotNull() & y.isNotNull(), made)


def st_box(x0, y0, x1, y1) -> Column:
    x0, y0, x1, y1 = (as_col(c).cast("double") for c in (x0, y0, x1, y1))
    ring = F.array(vertex(x0, y0), vertex(x1, y0), vertex(x1, y1), vertex(x0, y1), vertex(x0, y0))
    return _geom(F.lit("polygon"), F.array(F.array(ring)), x0, y0, x1, y1)


def st_rings(*rings: Column) -> Column:
    """A polygon from ring columns, shell first."""
    return st_from_parts(F.lit("polygon"), F.array(F.array(*rings)))


def box_ring(x0, y0, x1, y1) -> Column:
    return F.array(vertex(x0, y0), vertex(x1, y0), vertex(x1, y1), vertex(x0, y1), vertex(x0, y0))


def st_from_parts(gtype, parts) -> Column:
    """Add the bounding box to a vertex nesting; null where there is no vertex."""
    kind = as_col(gtype)

    def made(p):
        return let(F.flatten(F.flatten(p)), lambda flat: let(
            F.struct(F.transform(flat, lambda v: v["x"]).alias("x"), F.transform(flat, lambda v: v["y"]).alias("y")),
            lambda c: F.when(F.size(flat) > 0, _geom(
                kind, p, F.array_min(c["x"]), F.array_min(c["y"]), F.array_max(c["x"]), F.array_max(c["y"])))))

    return let(as_col(parts), made)


def st_is_empty(g) -> Column:
    g = as_col(g)
    return g.isNull() | g["parts"].isNull() | (F.size(F.flatten(F.flatten(g["parts"]))) <= 0)


def st_bounds(g) -> Column:
    g = as_col(g)
    return F.struct(*[g[c].alias(c) for c in ("minx", "miny", "maxx", "maxy")])


def bbox_area(g) -> Column:
    g = as_col(g)
    return (g["maxx"] - g["minx"]) * (g["maxy"] - g["miny"])


def _steps(ring: Column, f) -> Column:
    """``f(from, to)`` over the consecutive vertices of a closed ring."""
    n = F.size(ring)
    return F.zip_with(F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0))),
                      F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0))), f)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def ring_area(ring) -> Column:
    """Signed area, counter-clockwise positive; measured from the first vertex for precision."""

    def area(r):
        ox, oy = r[0]["x"], r[0]["y"]
        cross = _steps(r, lambda a, b: (a["x"] - ox) * (b["y"] - oy) - (b["x"] - ox) * (a["y"] - oy))
        return F.when(F.size(r) >= 4, _total(cross) / 2.0).otherwise(F.lit(0.0))

    return let(as_col(ring), area)


def _part_total(part: Column, ring_value) -> Column:
    """Value of the shell minus the values of the holes."""
    return let(F.transform(part, ring_value), lambda values: F.aggregate(
        values, F.lit(0.0), lambda acc, v: acc - v) + 2.0 * values[0])


def part_area(part) -> Column:
    return _part_total(as_col(part), lambda r: F.abs(ring_area(r)))


def st_area(g) -> Column:
    g = as_col(g)
    return F.when(g["gtype"].isin("polygon", "multipolygon"),
                  _total(F.transform(g["parts"], part_area))).otherwise(F.lit(0.0))


def st_perimeter(g) -> Column:
    g = as_col(g)
    lengths = F.transform(F.flatten(g["parts"]), lambda r: _total(
        _steps(r, lambda a, b: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"])
                                      + (b["y"] - a["y"]) * (b["y"] - a["y"])))))
    return _total(lengths)


def _authalic(lat_deg: Column) -> Column:
    """sin of the authalic latitude, times the polar value."""
    e = WGS84_E2 ** 0.5
    s = F.sin(F.radians(lat_deg))
    return (1 - WGS84_E2) * (s / (1 - WGS84_E2 * s * s)
                             - F.log((1 - e * s) / (1 + e * s)) / (2 * e))


def st_geodesic_area(g) -> Column:
    """Area in square metres of a lon/lat polygon on the WGS84 ellipsoid.

    Edges are taken as straight in the equal-area cylinder, which agrees with geodesics to well
    under 0.5 % for parcel-sized polygons.
    """
    import math
    e = WGS84_E2 ** 0.5
    polar = (1 - WGS84_E2) * (1 / (1 - WGS84_E2) - math.log((1 - e) / (1 + e)) / (2 * e))
    g = as_col(g)
    scale = EARTH_RADIUS_M * EARTH_RADIUS_M

    def ring_m2(r):
        ox = r[0]["x"]
        strip = _steps(r, lambda a, b: F.radians(b["x"] - a["x"])
                       * (_authalic(a["y"]) + _authalic(b["y"])) / (2 * polar))
        return F.abs(_total(strip)) * scale

    return _total(F.transform(g["parts"], lambda p: _part_total(p, ring_m2)))


def area_hectares(g) -> Column:
    return F.round(st_geodesic_area(g) / 10000.0, 2).cast("decimal(18,2)")


def st_is_box(g) -> Column:
    """True for one axis-aligned rectangle, whose box then says everything about it."""
    g = as_col(g)
    shell = g["parts"][0][0]
    cornered = F.forall(shell, lambda p: ((p["x"] == g["minx"]) | (p["x"] == g["maxx"]))
                        & ((p["y"] == g["miny"]) | (p["y"] == g["maxy"])))
    return ((F.size(g["parts"]) == 1) & (F.size(g["parts"][0]) == 1) & (F.size(shell) == 5)
            & cornered & (F.abs(ring_area(shell)) == bbox_area(g)))


def bbox_intersects(a, b) -> Column:
    a, b = as_col(a), as_col(b)
    return ((a["minx"] <= b["maxx"]) & (b["minx"] <= a["maxx"])
            & (a["miny"] <= b["maxy"]) & (b["miny"] <= a["maxy"]))


def bbox_overlap_area(a, b) -> Column:
    """Area shared by two boxes, zero where they only touch or are apart."""
    a, b = as_col(a), as_col(b)
    w = F.least(a["maxx"], b["maxx"]) - F.greatest(a["minx"], b["minx"])
    h = F.least(a["maxy"], b["maxy"]) - F.greatest(a["miny"], b["miny"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def box_intersection(a, b) -> Column:
    a, b = as_col(a), as_col(b)
    made = st_box(F.greatest(a["minx"], b["minx"]), F.greatest(a["miny"], b["miny"]),
                  F.least(a["maxx"], b["maxx"]), F.least(a["maxy"], b["maxy"]))
    return F.when(bbox_overlap_area(a, b) > 0, made)


def convex_intersection(a, b) -> Column:
    """The area that two convex polygons of one ring share, as one polygon; null when they share none.

    One ring is cut by the half-plane of each edge of the other, in turn. A fold over the edges keeps all of it
    in the JVM. Rings may run either way round.
    """
    ga, gb = as_col(a), as_col(b)
    ring_a, ring_b = ga["parts"][0][0], gb["parts"][0][0]
    sign = F.when(_total(_steps(ring_b, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])) < 0, -1.0).otherwise(1.0)
    edges = F.transform(F.sequence(F.lit(0), F.size(ring_b) - 2), lambda i: F.struct(
        F.get(ring_b, i).alias("p"), F.get(ring_b, i + 1).alias("q")))
    none = F.array().cast("array<struct<x:double,y:double>>")

    def side(e, v, s):
        return s * ((e["q"]["x"] - e["p"]["x"]) * (v["y"] - e["p"]["y"]) - (e["q"]["y"] - e["p"]["y"]) * (v["x"] - e["p"]["x"]))

    def cut(ring, e, s):
        marked = F.transform(ring, lambda v: F.struct(v.alias("v"), side(e, v, s).alias("d")))

        def kept(m):
            return F.flatten(F.transform(m, lambda c, i: let(F.get(m, F.pmod(i + 1, F.size(m))), lambda n: F.concat(
                F.when(c["d"] >= 0, F.array(c["v"])).otherwise(none),
                F.when(c["d"] * n["d"] < 0, F.array(vertex(
                    c["v"]["x"] + (n["v"]["x"] - c["v"]["x"]) * (c["d"] / (c["d"] - n["d"])),
                    c["v"]["y"] + (n["v"]["y"] - c["v"]["y"]) * (c["d"] / (c["d"] - n["d"]))))).otherwise(none)))))
        return let(marked, kept)

    start = F.slice(ring_a, 1, F.size(ring_a) - 1).cast("array<struct<x:double,y:double>>")
    left = let(sign, lambda s: F.aggregate(edges, start, lambda ring, e: F.when(F.size(ring) < 3, none).otherwise(cut(ring, e, s))))
    least = F.least(bbox_area(ga), bbox_area(gb)) * 1e-12  # less than that is a touch

    def closed(r):
        return let(F.concat(r, F.slice(r, 1, 1)), lambda ring: F.when(F.abs(ring_area(ring)) > least, st_rings(ring)))

    return let(left, lambda r: F.when(F.size(r) >= 3, closed(r)))


def bbox_distance2(a, b) -> Column:
    """Squared distance between two boxes."""
    a, b = as_col(a), as_col(b)
    zero = F.lit(0.0)
    dx = F.greatest(a["minx"] - b["maxx"], b["minx"] - a["maxx"], zero)
    dy = F.greatest(a["miny"] - b["maxy"], b["miny"] - a["maxy"], zero)
    return dx * dx + dy * dy


def segments(g) -> Column:
    g = as_col(g)
    return F.flatten(F.transform(F.flatten(g["parts"]), lambda r: _steps(
        r, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"),
                                 b["x"].alias("bx"), b["y"].alias("by")))))


def _turn(ax, ay, bx, by, cx, cy) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _on_segment(s, x, y) -> Column:
    return ((_turn(s["ax"], s["ay"], s["bx"], s["by"], x, y) == 0)
            & (x >= F.least(s["ax"], s["bx"])) & (x <= F.greatest(s["ax"], s["bx"]))
            & (y >= F.least(s["ay"], s["by"])) & (y <= F.greatest(s["ay"], s["by"])))


def _crossings_odd(segs: Column, x, y) -> Column:
    """Even-odd rule over all rings, so holes and several parts need no special case."""
    hit = F.filter(segs, lambda s: ((s["ay"] > y) != (s["by"] > y))
                   & (x < (s["bx"] - s["ax"]) * (y - s["ay"]) / (s["by"] - s["ay"]) + s["ax"]))
    return F.size(hit) % 2 == 1


def _covered(segs, x, y) -> Column:
    return _crossings_odd(segs, x, y) | F.exists(segs, lambda s: _on_segment(s, x, y))


def _in_bbox(g, x, y) -> Column:
    return (x >= g["minx"]) & (x <= g["maxx"]) & (y >= g["miny"]) & (y <= g["maxy"])


def st_contains(g, x, y) -> Column:
    """Point strictly inside the polygon; points on the boundary do not count."""
    g, x, y = as_col(g), as_col(x).cast("double"), as_col(y).cast("double")
    inside = let(segments(g), lambda segs: _crossings_odd(segs, x, y)
                 & ~F.exists(segs, lambda s: _on_segment(s, x, y)))
    return F.when(_in_bbox(g, x, y), inside).otherwise(F.lit(False))


def st_covers(g, x, y) -> Column:
    """Point inside the polygon or on its boundary."""
    g, x, y = as_col(g), as_col(x).cast("double"), as_col(y).cast("double")
    return F.when(_in_bbox(g, x, y), let(segments(g), lambda segs: _covered(segs, x, y))
                  ).otherwise(F.lit(False))


def _segments_meet(s, t) -> Column:
    d1 = _turn(t["ax"], t["ay"], t["bx"], t["by"], s["ax"], s["ay"])
    d2 = _turn(t["ax"], t["ay"], t["bx"], t["by"], s["bx"], s["by"])
    d3 = _turn(s["ax"], s["ay"], s["bx"], s["by"], t["ax"], t["ay"])
    d4 = _turn(s["ax"], s["ay"], s["bx"], s["by"], t["bx"], t["by"])
    apart = ((F.greatest(s["ax"], s["bx"]) < F.least(t["ax"], t["bx"]))
             | (F.greatest(t["ax"], t["bx"]) < F.least(s["ax"], s["bx"]))
             | (F.greatest(s["ay"], s["by"]) < F.least(t["ay"], t["by"]))
             | (F.greatest(t["ay"], t["by"]) < F.least(s["ay"], s["by"])))
    return ~apart & (F.signum(d1) * F.signum(d2) <= 0) & (F.signum(d3) * F.signum(d4) <= 0)


def _first_vertices(g) -> Column:
    return F.transform(g["parts"], lambda p: p[0][0])


def st_intersects(a, b) -> Column:
    """True where the geometries share at least a point; touching counts.

    Works for points and polygons. Either some edges meet, or one geometry lies wholly inside
    the other, which a single vertex per part decides.
    """
    a, b = as_col(a), as_col(b)

    def meet(e):
        edges = F.exists(e["a"], lambda s: F.exists(e["b"], lambda t: _segments_meet(s, t)))
        return (F.exists(_first_vertices(a), lambda p: _covered(e["b"], p["x"], p["y"]))
                | F.exists(_first_vertices(b), lambda p: _covered(e["a"], p["x"], p["y"])) | edges)

    same_point = ((a["gtype"] == "point") & (b["gtype"] == "point") & (a["minx"] == b["minx"])
                  & (a["miny"] == b["miny"]))
    both = F.struct(segments(a).alias("a"), segments(b).alias("b"))
    return F.when(bbox_intersects(a, b), same_point | let(both, meet)).otherwise(F.lit(False))


def st_dimension(g) -> Column:
    g = as_col(g)
    return (F.when(g["gtype"].contains("polygon"), 2).when(g["gtype"].contains("line"), 1)
            .when(g["gtype"].contains("point"), 0))


def st_swap_xy(g) -> Column:
    g = as_col(g)
    parts = F.transform(g["parts"], lambda p: F.transform(p, lambda r: F.transform(
        r, lambda v: F.struct(v["y"].alias("x"), v["x"].alias("y")))))
    return F.when(g.isNotNull(),
                  _geom(g["gtype"], parts, g["miny"], g["minx"], g["maxy"], g["maxx"]))


def st_multi(g) -> Column:
    """Polygon parts of a geometry as one multipolygon, null when no areal part is left."""
    g = as_col(g)
    parts = F.filter(g["parts"], lambda p: part_area(p) > 0)
    return F.when(g["gtype"].contains("polygon") & (F.size(parts) > 0),
                  st_from_parts(F.lit("multipolygon"), parts))


def st_centroid_of_points(x, y) -> tuple[Column, Column]:
    """Aggregates giving the centroid of a group of points."""
    return F.avg(as_col(x)), F.avg(as_col(y))


def _scanline(segs: Column, y: Column) -> Column:
    """Sorted x where the edges cross the horizontal at ``y``."""
    cut = F.filter(segs, lambda s: (s["ay"] > y) != (s["by"] > y))
    return F.array_sort(F.transform(cut, lambda s: s["ax"] + (s["bx"] - s["ax"])
                                    * (y - s["ay"]) / (s["by"] - s["ay"])))


def st_point_on_surface(g) -> Column:
    """A point inside the polygon: middle of the widest inner interval at mid height of the
    largest part. When mid height falls on a vertex the line is moved to half-way between the
    two vertex heights around it."""
    g = as_col(g)
    sized = F.transform(g["parts"], lambda p, i: F.struct(part_area(p).alias("a"), (-i).alias("i"), p.alias("p")))

    def on_part(p):
        ys = F.array_sort(F.array_distinct(F.transform(F.flatten(p), lambda v: v["y"])))
        return let(ys, lambda heights: let(
            (F.array_min(heights) + F.array_max(heights)) / 2.0, lambda mid: let(
                F.when(F.array_contains(heights, mid),
                       (mid + F.array_min(F.filter(heights, lambda v: v > mid))) / 2.0).otherwise(mid),
                lambda y: _on_line(p, y))))

    return let(F.array_max(sized)["p"], on_part)


def _on_line(p, y) -> Column:
    segs = F.flatten(F.transform(p, lambda r: _steps(r, lambda a, b: F.struct(
        a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))))

    def widest(xs):
        pairs = F.transform(F.sequence(F.lit(0), F.greatest((F.size(xs) / 2 - 1).cast("int"), F.lit(0))),
                            lambda i: F.struct((F.get(xs, 2 * i + 1) - F.get(xs, 2 * i)).alias("w"),
                                               F.get(xs, 2 * i).alias("x")))
        return let(F.array_max(pairs), lambda best: F.struct(
            (best["x"] + best["w"] / 2.0).alias("x"), y.alias("y")))

    return let(_scanline(segs, y), widest)


def _wkt_ring(r) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(
        r, lambda v: F.concat_ws(" ", number_text(v["x"]), number_text(v["y"]))), ", "), F.lit(")"))


def number_text(c) -> Column:
    """Shortest decimal text of a double, without exponent or trailing ``.0``."""
    c = as_col(c)
    return let(F.regexp_replace(c.cast("string"), r"\.0$", ""), lambda plain: F.when(plain.contains("E"), F.regexp_replace(
        F.regexp_replace(F.format_string("%.12f", c), r"0+$", ""), r"\.$", "")).otherwise(plain))


def st_as_text(g) -> Column:
    """Well-known text."""
    g = as_col(g)
    part = lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, _wkt_ring), ", "), F.lit(")"))
    parts = F.array_join(F.transform(g["parts"], part), ", ")
    return (F.when(g["gtype"] == "point", F.concat(F.lit("POINT "), _wkt_ring(g["parts"][0][0])))
            .when(g["gtype"] == "linestring",
                  F.concat(F.lit("LINESTRING "), _wkt_ring(g["parts"][0][0])))
            .when(g["gtype"] == "polygon", F.concat(F.lit("POLYGON "), part(g["parts"][0])))
            .when(g["gtype"] == "multipolygon", F.concat(F.lit("MULTIPOLYGON ("), parts, F.lit(")"))))


def _parse_ring(text) -> Column:
    return F.transform(F.split(F.trim(F.regexp_replace(text, r"[()]", " ")), r"\s*,\s*"), lambda p:
                       F.transform(F.array(F.split(F.trim(p), r"\s+")), lambda c: F.struct(
                           F.get(c, F.lit(0)).try_cast("double").alias("x"),
                           F.get(c, F.lit(1)).try_cast("double").alias("y")))[0])


def _read_lists(body: Column, depth: int, f) -> Column:
    """``f`` of the nested lists of ordinates in the parentheses of a text, which are read as JSON in one pass; null where
    a position is not two ordinates or more."""
    text = F.regexp_replace(F.translate(body, "()", "[]"), r'([^\s\[\],"\\\\]+)\s+([^\s\[\],"\\\\]+)[^\[\],]*', r'["$1","$2"]')
    read = lambda t: F.from_json(t, "array<" * depth + "string" + ">" * depth)
    return let(text, lambda t: F.when(~t.rlike(r'[\[,](?:[^\[\],"]|[,\]]|$)'), let(read(t), f)))


def st_from_text(wkt) -> Column:
    """Geometry from well-known text (point, linestring, polygon, multipolygon); extra
    ordinates are dropped."""
    listed = lambda t: F.transform(t, lambda r: F.transform(r, lambda p: F.struct(
        F.get(p, F.lit(0)).try_cast("double").alias("x"), F.get(p, F.lit(1)).try_cast("double").alias("y"))))
    rings = lambda t: F.transform(F.split(t, r"\),\("), _parse_ring)

    def made(v):
        gtype, body = v["gtype"], v["body"]
        parts = (F.when(gtype.isin("point", "linestring"), F.array(F.array(_parse_ring(body))))
                 .when(gtype == "polygon", F.array(F.coalesce(_read_lists(body, 3, listed), rings(body))))
                 .when(gtype == "multipolygon", F.coalesce(_read_lists(body, 4, lambda t: F.transform(t, listed)),
                                                           F.transform(F.split(body, r"\)\),\(\("), rings))))
        return st_from_parts(gtype, parts)

    return let(F.trim(as_col(wkt)), lambda t: let(F.struct(
        F.lower(F.regexp_extract(t, r"^\s*(?:SRID=\d+;)?\s*([A-Za-z]+)", 1)).alias("gtype"),
        F.regexp_replace(F.regexp_extract(t, r"(\(.*\))", 1), r"\s*([(),])\s*", "$1").alias("body")), made))


# --- flat form for the vectorised kernels -------------------------------------------------

def to_flat(g) -> Column:
    """Vertices as two plain arrays with ring and part lengths, cheap to move through Arrow."""
    g = as_col(g)
    rings = F.flatten(g["parts"])
    flat = F.flatten(rings)
    return F.struct(F.transform(flat, lambda p: p["x"]).alias("xs"),
                    F.transform(flat, lambda p: p["y"]).alias("ys"),
                    F.transform(rings, lambda r: F.size(r)).alias("ring_sizes"),
                    F.transform(g["parts"], lambda p: F.size(p)).alias("part_sizes"))
