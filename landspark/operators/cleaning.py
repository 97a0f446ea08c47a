"""Cleaning and territorial filters of feature layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions.geometry import as_col, st_from_parts, st_is_empty, st_multi, st_swap_xy
from ..session import once
from .overlap import intersecting_keys


def drop_empty(df: DataFrame, geom: str = "geom") -> DataFrame:
    return df.filter(~st_is_empty(geom))


def drop_bad_geometries(df: DataFrame, geom: str = "geom", limit: float = K.COORDINATE_LIMIT) -> DataFrame:
    """Drop missing geometries and those with a bound at or above ``limit`` in size (sentinels)."""
    g = F.col(geom)
    near = [F.abs(g[c]) < limit for c in ("minx", "miny", "maxx", "maxy")]
    return drop_empty(df, geom).filter(near[0] & near[1] & near[2] & near[3])


def layer_bounds(df: DataFrame, geom: str = "geom") -> DataFrame:
    g = F.col(geom)
    return df.agg(F.min(g["minx"]).alias("minx"), F.min(g["miny"]).alias("miny"),
                  F.max(g["maxx"]).alias("maxx"), F.max(g["maxy"]).alias("maxy"))


def fix_axis_order(df: DataFrame, geom: str = "geom") -> DataFrame:
    """Swap x and y of the whole layer when its bounds show that latitude came first."""
    swapped = layer_bounds(df, geom).select(
        ((F.col("miny") < K.AXIS_LIMIT) & (F.col("minx") > K.AXIS_LIMIT)).alias("_swap"))
    return (df.crossJoin(F.broadcast(swapped))  # exactly one row
            .withColumn(geom, F.when(F.col("_swap"), st_swap_xy(geom)).otherwise(F.col(geom)))
            .drop("_swap"))


def fix_point_axes(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    swap = (F.col(lat) < K.POINT_AXIS_LIMIT) & (F.col(lon) > K.POINT_AXIS_LIMIT)
    return df.withColumns({lon: F.when(swap, F.col(lat)).otherwise(F.col(lon)),
                           lat: F.when(swap, F.col(lon)).otherwise(F.col(lat))})


def within_bounds(df: DataFrame, lon: str, lat: str, box=K.EVICTION_BOX) -> DataFrame:
    return df.filter(F.col(lon).between(box[0], box[2]) & F.col(lat).between(box[1], box[3]))


def in_envelopes(geom, boxes=(K.MAINLAND_BOX, K.ISLAND_BOX)) -> Column:
    """Lower-left corner of the box inside one of the envelopes."""
    g = as_col(geom)
    out = F.lit(False)
    for x0, y0, x1, y1 in boxes:
        out = out | (g["minx"].between(x0, x1) & g["miny"].between(y0, y1))
    return out


def set_crs(df: DataFrame, declared: str | None) -> DataFrame:
    """Accept WGS84 and SIRGAS 2000, which agree; anything else would need a projection."""
    if declared is None or declared.upper() in ("EPSG:4326", "EPSG:4674", "OGC:CRS84"):
        return df
    raise ValueError(f"coordinates in {declared} are not supported, only EPSG:4326 and EPSG:4674")


def as_multipolygon(df: DataFrame, geom: str = "geom") -> DataFrame:
    return once(df.withColumn(geom, st_multi(geom)), geom).filter(F.col(geom).isNotNull())


def drop_parts(df: DataFrame, file: str, rules: dict[str, float] = K.SPURIOUS_PARTS,
               geom: str = "geom") -> DataFrame:
    """Discard parts that lie wholly west of the bound set for their file; only geometries of
    several parts are looked at. Rows left without parts are dropped."""
    g, bound = F.col(geom), F.lit(None).cast("double")
    for name, east in rules.items():
        bound = F.when(F.col(file) == name, F.lit(east)).otherwise(bound)
    max_x = lambda p: F.array_max(F.transform(F.flatten(p), lambda v: v["x"]))
    kept = F.filter(g["parts"], lambda p: max_x(p) >= bound)
    touched = bound.isNotNull() & (F.size(g["parts"]) > 1)
    return (once(df.withColumn(geom, F.when(touched, st_from_parts(g["gtype"], kept)).otherwise(g)), geom)
            .filter(F.col(geom).isNotNull()))


def filter_category(df: DataFrame, column: str, chosen: list, all_values: list) -> DataFrame:
    """No value chosen shows nothing, all chosen values show everything, nulls included."""
    if not chosen:
        return df.limit(0)
    if len(chosen) == len(all_values):
        return df
    return df.filter(F.col(column).isin(chosen))


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna("any", subset=columns)


def select_layers(layers: list[str], wanted: str | None, groups: dict[str, list[str]] | None = None):
    """Names equal to ``wanted``, or holding one of the keywords of the group of that name."""
    if not wanted:
        return list(layers)
    words = (groups or {"icmbio": ["icmbio", "limiteucsfederais"]}).get(wanted)
    return [n for n in layers if (any(w in n for w in words) if words else n == wanted)]


def _text(df: DataFrame, name: str) -> Column | None:
    return F.upper(F.col(name).cast("string")) if name in df.columns else None


def _state_in(df: DataFrame, state: str) -> Column | None:
    c = _text(df, "STATE")
    return None if c is None else F.coalesce(c.contains(state.upper()), F.lit(False))


def filter_territory(df: DataFrame, rule: str, boundary: DataFrame | None, key: str, cell: float,
                     uf: str = "PE", state: str = K.STATE_NAME) -> DataFrame:
    """Keep the features of the state, by the rule of the layer.

    ``units``: inside the boundary. ``notices`` (also embargoes): inside the boundary, or marked
    with the state and within its envelopes. ``alerts``: state attribute, then boundary.
    ``registry_alerts``: code prefix or state attribute, then boundary. Without a boundary the
    geometric test is left out. Attributes missing from the layer do not restrict ``alerts`` and
    match nothing elsewhere.
    """
    inside = lambda d: intersecting_keys(d, boundary, key, cell)
    if rule == "units":
        return df if boundary is None else df.join(inside(df), key, "left_semi")
    if rule == "notices":
        marked = _text(df, "uf")
        marked = F.lit(False) if marked is None else (
            F.coalesce(F.trim(marked) == uf, F.lit(False)) & in_envelopes("geom"))
        if boundary is None:
            return df.filter(marked)
        # rows already accepted by their attribute need no geometric test
        rest = inside(df.filter(~marked)).withColumn("_in", F.lit(True))
        return df.join(rest, key, "left").filter(marked | F.col("_in")).drop("_in")
    if rule == "alerts":
        cond = _state_in(df, state)
        df = df if cond is None else df.filter(cond)
    elif rule == "registry_alerts":
        cond = _state_in(df, state)
        cond = F.lit(False) if cond is None else cond
        if "CODSICAR" in df.columns:
            cond = cond | F.coalesce(F.col("CODSICAR").startswith(f"{uf}-"), F.lit(False))
        df = df.filter(cond)
    else:
        raise ValueError(f"unknown rule {rule}")
    return df if boundary is None else df.join(inside(df), key, "left_semi")


def state_case_flag(ufs: Column, towns: Column, uf: str = "pe") -> Column:
    """True: in the state by its tags; False: of another state; null: the tags do not tell."""
    clean = lambda a: F.transform(F.coalesce(a, F.array().cast("array<string>")),
                                  lambda v: F.trim(F.lower(v)))
    u, t = clean(ufs), clean(towns)
    foreign = ((F.size(F.array_except(u, F.array(F.lit(uf)))) > 0)
               | F.exists(t, lambda m: m.rlike(rf"-(?!{uf})[a-z]{{2}}$")))
    own = F.array_contains(u, uf) | F.exists(t, lambda m: m.endswith(f"-{uf}"))
    return F.when(foreign, False).when(own, True)
