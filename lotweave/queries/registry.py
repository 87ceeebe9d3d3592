"""Named queries with their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotweave.queries.views import Data, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _comparable(df: DataFrame) -> DataFrame:
    """Doubles to six places and text for lists, so that results compare across engines."""
    out = []
    for f in df.schema.fields:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind in ("double", "float"):
            c = F.round(c.cast("double"), 6)
        elif kind == "array":
            c = F.array_join(c.cast("array<string>"), ",")
        elif kind == "byte":
            c = c.cast("int")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register ``fn(data) -> DataFrame`` under ``name``."""
    def wrap(fn: Callable[[Data], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: _comparable(fn(Data(spark, folder)))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn
    return wrap
