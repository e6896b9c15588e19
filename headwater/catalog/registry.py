"""Registration of named queries, and the helpers their definitions share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.sources.driver_tables import VIEWS, table, with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Attribute access to domain views and driver tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return VIEWS[name](self.spark, self.folder)
        return table(self.spark, self.folder, name)


def query(sql: str | None = None, views: str = "") -> Callable:
    """Register a query under its function name; ``sql`` may start with more ``, name AS (...)``."""
    def register(build: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[build.__name__] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[build.__name__] = with_views(views, sql) if views else sql
        return build

    return register


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, so that sums taken in another order compare equal."""
    doubles = {name for name, kind in df.dtypes if kind == "double"}
    return df.select(*[F.round(c, digits).alias(c) if c in doubles else F.col(c) for c in df.columns])


def flat(df: DataFrame) -> DataFrame:
    """Arrays as comma-joined text, for comparison with SQL."""
    arrays = {name for name, kind in df.dtypes if kind.startswith("array")}
    return df.select(*[F.array_join(c, ",").alias(c) if c in arrays else F.col(c) for c in df.columns])
