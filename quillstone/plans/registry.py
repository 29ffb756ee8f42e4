"""A register of queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries of one module; `add(sql)` registers a function under its name."""

    def __init__(self) -> None:
        self.plans: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, **fill: str) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.plans[f.__name__] = f
            if sql is not None:
                for k, v in fill.items():
                    assert f"@{k}" in sql
                text = sql
                for k, v in fill.items():
                    text = text.replace(f"@{k}", v)
                self.sql[f.__name__] = text
            return f

        return keep

    def queries(self) -> dict[str, Query]:
        return dict(self.plans)

    def oracle_sql(self) -> dict[str, str]:
        return dict(self.sql)
