"""Registration of runnable queries together with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECK_SQL: dict[str, str] = {}
COVERS: dict[str, str] = {}


class Tables:
    """The tables of one scale folder, read lazily by attribute."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """Plain output types: whole numbers and flags as bigint, fractions as double rounded to six places."""
    cols = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.IntegralType, T.BooleanType)):
            col = col.cast("int").cast("long") if isinstance(field.dataType, T.BooleanType) else col.cast("long")
        elif isinstance(field.dataType, (T.FractionalType, T.DecimalType)):
            col = F.round(col.cast("double"), 6)
        cols.append(col.alias(field.name))
    return df.select(*cols)


def query(name: str, covers: str, sql: str | None = None) -> Callable:
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``covers`` lists the inventory rows it stands for."""

    def wrap(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return settled(fn(Tables(spark, folder)))

        run.family = fn.__module__.rsplit(".", 1)[-1]
        QUERIES[name] = run
        COVERS[name] = covers
        if sql is not None:
            CHECK_SQL[name] = sql
        return fn

    return wrap
