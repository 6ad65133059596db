"""Registered queries, each with the SQL statement that checks it where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossmarket.functions.prices import on_grid
from crossmarket.plans.oracle_views import oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
# The JVM interprets methods above this many bytes for good. Spark's own limit is eight times that; beyond the limit it makes
# several methods of a stage, which are compiled.
METHOD_LIMIT, COMPILED_METHOD = "spark.sql.codegen.hugeMethodLimit", "8000"


def tidy(df: DataFrame, rounded: list[str]) -> DataFrame:
    """Comparable column types: rounded doubles, zone-free timestamps, arrays as text."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        if f.name in rounded:
            # Through a decimal, so that ties round alike in every engine.
            tied = F.round(c.cast("decimal(38,9)"), 6).cast("double")
            c = on_grid(c, 6, tied) if isinstance(f.dataType, (T.DoubleType, T.DecimalType, T.FloatType)) else tied
        columns.append(c.alias(f.name))
    return df.select(*columns)


def query(name: str, sql: str | None = None, r: str = "", views: dict[str, str] | None = None):
    """Registers a query; `r` names the double columns rounded to six places on both sides."""
    rounded = r.split()

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")

        def run(spark: SparkSession, root: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            spark.conf.set(METHOD_LIMIT, COMPILED_METHOD)
            return tidy(fn(spark, root), rounded)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            body = sql
            if rounded:
                columns = ", ".join(f"CAST(round(CAST({c} AS DECIMAL(38,9)), 6) AS DOUBLE) AS {c}" for c in rounded)
                body = f"SELECT * REPLACE ({columns}) FROM ({sql}) AS result"
            ORACLES[name] = oracle(body, **(views or {}))
        return fn

    return register
