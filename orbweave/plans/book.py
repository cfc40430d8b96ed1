"""How a query enters the registry: a function under its name, with its SQL."""

from __future__ import annotations

from collections.abc import Callable


def book() -> tuple[dict, dict[str, str], Callable]:
    queries: dict = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None, ctes: str = ""):
        def enter(fn):
            queries[fn.__name__] = fn
            if sql:
                oracles[fn.__name__] = f"WITH {ctes} {sql}" if ctes else sql
            return fn

        return enter

    return queries, oracles, query
