"""Registered queries and the SQL that says the same."""

from . import extras, geometry, matrices, more, overlays, polygons, rankings, recoveries, results  # noqa: F401
from .adapters import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
