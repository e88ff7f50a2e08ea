from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.functions.text import WS, WS_CHARS
from caseweave.session import sized, spread

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


class Tables:
    """Lazy access to the given tables: ``t.documents`` reads documents.parquet."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._read = spark, path, []

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        self._read.append(df)
        sized(self.spark, self._read)
        if name in ("documents", "pages", "orders", "lineitem", "events"):
            df = spread(df)
        setattr(self, name, df)
        return df


def _wide(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint and fractions as double, as the SQL twin has them."""
    small = (T.IntegerType, T.ShortType, T.ByteType)
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, small):
            c = c.cast("bigint").alias(f.name)
        elif isinstance(f.dataType, (T.FloatType, T.DecimalType)):
            c = c.cast("double").alias(f.name)
        cols.append(c)
    return df.select(*cols)


def query(name: str, sql: str | None = None):
    """Register a query. In ``sql`` @WS@ stands for the blank class, @WC@ for its characters."""
    if sql is not None:
        sql = sql.replace("@WS@", WS).replace("@WC@", WS_CHARS)

    def deco(fn):
        if name in REGISTRY:
            raise ValueError(name)

        def run(spark: SparkSession, path: str) -> DataFrame:
            return _wide(fn(Tables(spark, path)))

        REGISTRY[name] = (run, sql)
        return fn

    return deco
