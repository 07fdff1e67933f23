"""All registered queries with their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from linienwerk.plans.fixtures import sql_views

MODULES = ("scalars", "usage", "feed", "service", "spatial", "lines", "itineraries", "stops", "sources", "network", "files", "places", "piers", "rounds")

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(views: str = "", oracle: str | None = None, name: str | None = None) -> Callable:
    """Registers ``(spark, sf_dir) → DataFrame``; ``oracle`` is SQL over the named adapter views."""

    def add(f: Callable) -> Callable:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = f
        if oracle:
            ORACLES[key] = sql_views(views, oracle)
        return f

    return add


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"linienwerk.plans.{m}")
