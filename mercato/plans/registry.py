"""Name -> query and name -> oracle SQL of the price-observation boards."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

AREAS = ("boards", "moves", "series", "audit", "matching", "reviews", "strategy", "weekly", "operations", "retrieval", "textual", "incremental", "listings", "periods", "ingest", "upkeep", "brief", "lines", "identity", "webpages")

_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with SQL over the raw tables that gives the same rows.

    Ties at the fourth decimal are pushed up by 1e-9 on both sides, as engines round them differently.
    """

    def put(f):
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return put


def _load() -> None:
    for area in AREAS:
        import_module(f"mercato.plans.{area}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
