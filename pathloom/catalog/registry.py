"""Registry of runnable queries and the SQL that must give the same rows.

``columns`` declares the result once for both sides: ``i`` integer, ``d`` double (compared to
six places), ``s`` text, ``a`` array (compared as comma-separated text).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.session import use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _spark_column(name: str, kind: str):
    c = F.col(f"`{name}`")
    shown = {
        "i": lambda: c.cast("bigint"),
        "d": lambda: F.round(c.cast("double"), 6) + F.lit(0.0),
        "s": lambda: c.cast("string"),
        "a": lambda: F.array_join(c.cast("array<string>"), ","),
    }[kind]()
    return shown.alias(name)


def _sql_column(name: str, kind: str) -> str:
    shown = {
        "i": f"CAST({name} AS BIGINT)",
        "d": f"round(CAST({name} AS DOUBLE), 6) + 0.0::DOUBLE",
        "s": f"CAST({name} AS VARCHAR)",
        "a": f"array_to_string({name}, ',')",
    }[kind]
    return f"{shown} AS {name}"


def query(name: str, columns: str, sql: str | None = None):
    """Register a query under ``name``; ``columns`` is e.g. ``'user_id:i score:d'``."""
    spec = [tuple(c.split(":")) for c in columns.split()]

    def register(function: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            result = function(use_utc(spark), str(sf_dir).rstrip("/"))
            return result.select(*[_spark_column(n, k) for n, k in spec])

        run.__name__ = name
        run.__doc__ = function.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name!r} is already registered")
        QUERIES[name] = run
        if sql is not None:
            picked = ", ".join(_sql_column(n, k) for n, k in spec)
            ORACLES[name] = f"SELECT {picked} FROM (\n{sql.strip()}\n) AS result"
        return function

    return register
