"""Registration of queries."""

from __future__ import annotations

from collections.abc import Callable


class Queries:
    """Queries of a module by name, with the SQL of those that have one."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable:
        def register(function: Callable) -> Callable:
            self.queries[function.__name__] = function
            if sql:
                self.oracles[function.__name__] = sql
            return function

        return register
