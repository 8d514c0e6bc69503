"""The catalogue: every query by name, with the SQL that an independent engine can check it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Digits that doubles are rounded to on both sides of a comparison.
DIGITS = 6


def query(oracle: str | None = None, doubles: str = "") -> Callable[[Query], Query]:
    """Register a query under its function's name. `doubles` names the columns that both sides round, to DIGITS or as in name:3."""
    names = {c: int(d or DIGITS) for c, _, d in (word.partition(":") for word in doubles.split())}

    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.round(F.col(c), d) + F.lit(0.0) for c, d in names.items()}) if names else df

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        QUERIES[f.__name__] = run
        if oracle:
            replaced = ", ".join(f"round({c}, {d}) + 0.0 AS {c}" for c, d in names.items())
            ORACLES[f.__name__] = f"SELECT * REPLACE ({replaced}) FROM ({oracle}) AS checked" if names else oracle
        return run

    return register
