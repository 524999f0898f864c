"""Name -> (Spark query, SQL twin)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPARK: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Times and dates as text and narrow numbers widened, so that values
    compare the same whichever engine produced them."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.FloatType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        out.append(c.alias(f.name))
    return df.select(*out)


def register(name: str, sql: str | None = None):
    def wrap(fn: Callable) -> Callable:
        if name in SPARK:
            raise ValueError(f"query {name} is registered twice")
        SPARK[name] = lambda spark, sf: plain(fn(spark, sf))
        if sql is not None:
            SQL[name] = sql
        return fn
    return wrap
