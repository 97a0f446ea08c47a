"""Loading of a feature layer: clean, filter to the state, rename."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.cleaning import drop_bad_geometries, filter_territory, fix_axis_order, set_crs
from ..operators.polygons import make_valid
from ..sources.files import sanitize_columns


def clean_layer(df: DataFrame, rule: str | None = None, boundary: DataFrame | None = None,
                key: str | None = None, cell: float = 0.25, crs: str | None = None,
                rename: bool = True) -> DataFrame:
    """Drop bad geometries, mend axis order and validity, keep the state by ``rule``, make the
    column names safe. ``key`` tells the features apart and is needed with a rule."""
    out = make_valid(fix_axis_order(drop_bad_geometries(set_crs(df, crs))))
    if rule is not None:
        out = filter_territory(out, rule, boundary, key, cell)
    return sanitize_columns(out) if rename else out
