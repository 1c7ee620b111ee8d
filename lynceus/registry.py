"""Queries by name, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with DuckDB SQL for the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(*names: str, digits: int = 5) -> list[Column]:
    return [F.round(n, digits).alias(n) for n in names]
