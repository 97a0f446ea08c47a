"""Registered queries: each builds domain tables from the given ones and runs one operator.

``QUERIES`` maps a name to ``f(spark, sf_dir)``; ``ORACLE`` holds the equivalent SQL on the same
given tables.
"""

from __future__ import annotations

from collections.abc import Callable

from .. import fixtures as fx

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f
    return add


def ctes(*names: str, **more: str) -> str:
    """WITH clause of derived tables, by name or given in full."""
    tables = {n: fx.SQL[n] for n in names} | more
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({sql})" for n, sql in tables.items()) + " "


def load_all() -> None:
    from . import cases, cleaning, courts, files, more, rows, spatial, text, zones  # noqa: F401
