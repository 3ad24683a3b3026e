"""Shared pieces of the query bindings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]


# Rounding offset: just off one half, so that means of short decimals never sit on the boundary.
OFFSET = 0.4987


def to_six(c: Column) -> Column:
    return F.floor(c * 1e6 + OFFSET) / F.lit(1e6)


class Book:
    """Named queries with their oracle SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, oracle: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            self.queries[name] = lambda spark, sf: settled(fn(spark, sf))
            if oracle is not None:
                self.oracles[name] = oracle
            return fn

        return register


def settled(df: DataFrame) -> DataFrame:
    """Doubles to six decimals and integers to bigint, so that both engines print the same values."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = to_six(c).alias(f.name)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint").alias(f.name)
        cols.append(c)
    return df.select(*cols)


def sql(body: str, doubles: str = "", ints: str = "") -> str:
    """Oracle text: views in front, doubles to six decimals, integers to BIGINT."""
    from .views import with_views

    changes = [f"floor({c} * 1e6 + {OFFSET}) / 1e6 AS {c}" for c in doubles.split()]
    changes += [f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()]
    star = f"* REPLACE ({', '.join(changes)})" if changes else "*"
    return with_views(f"SELECT {star} FROM (\n{body.strip()}\n)", body)
