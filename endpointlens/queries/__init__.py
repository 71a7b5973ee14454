"""Registered queries with the SQL that checks them."""

from .base import ORACLES, QUERIES, Query
from . import detection, graphs, investigation, streams, telemetry_sources  # noqa: F401


def all_queries() -> dict[str, Query]:
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)
