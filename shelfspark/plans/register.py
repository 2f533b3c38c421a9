"""A module's queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable


class Register:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            self.queries[name] = f
            if sql:
                self.oracles[name] = sql
            return f

        return add
