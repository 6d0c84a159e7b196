"""Queries by name, each with the SQL that DuckDB answers alike, and literal tables that both engines read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) under its name."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


class Literal:
    """A small table: ``schema`` in Spark DDL, one type a column of bigint, int, double or string."""

    def __init__(self, schema: str, *rows: tuple):
        self.schema, self.rows = schema, rows

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.schema)

    @property
    def sql(self) -> str:
        def one(v: object) -> str:
            return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

        names, kinds = zip(*(c.split() for c in self.schema.split(",")), strict=True)
        kinds = [{"string": "VARCHAR"}.get(k, k.upper()) for k in kinds]
        values = ", ".join("(" + ", ".join(map(one, r)) + ")" for r in self.rows)
        return "(SELECT " + ", ".join(f'CAST("{n}" AS {k}) AS "{n}"' for n, k in zip(names, kinds, strict=True)) + " FROM (VALUES " + values + ") AS v(" + ", ".join(f'"{n}"' for n in names) + "))"
