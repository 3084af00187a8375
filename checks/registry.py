"""``@query`` collects the registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from checks.fixtures import Fixtures

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(fn):
        key = name or fn.__name__
        QUERIES[key] = lambda spark, sf_dir: fn(Fixtures(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register
