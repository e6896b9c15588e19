"""Ecohydrology outputs: dataset routing, choropleths and time series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.functions.numbers import is_finite, series_label

# Scenarios, variables by scale, and the variables kept in growth files.
SCENARIOS = ("S1", "S2", "S4b")
GROWTH_VARIABLES = {"hillslope": ("lai", "gpsn", "plantc"), "patch": ("plant_c", "litter_c", "soil_c")}


def route_catalogue(spark: SparkSession, variables: dict[str, list[str]]) -> DataFrame:
    """SRC-02: every known (scenario, scale, variable, kind) with its file and id column.

    ``variables`` lists the supported variables of each scale. The table has a few hundred
    rows at most: scenarios x scales x variables x two kinds.
    """
    rows = []
    for scenario in SCENARIOS:
        for scale, names in variables.items():
            for variable in names:
                growth = variable in GROWTH_VARIABLES[scale]
                prefix = "grow_" if growth else ""
                for kind in ("choropleth", "time-series"):
                    if scale == "patch":
                        name, key = "patch.yearly", "patchID"
                    elif kind == "time-series":
                        name, key = "basin.daily", "basinID"
                    else:
                        name, key = "hillslope.daily", "basinID" if growth else "hillID"
                    rows.append((scenario, scale, variable, kind, f"{scenario}/{prefix}{name}.parquet", key))
    return spark.createDataFrame(
        rows, "scenario string, spatial_scale string, variable string, kind string, path string, id_column string"
    )


def route(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    """SRC-02: path and id column of each request; an unknown combination has none."""
    keys = ["scenario", "spatial_scale", "variable", "kind"]
    return requests.join(catalogue, keys, "left").withColumn(
        "supported", F.col("path").isNotNull()
    )


def _value(variable: str):
    # The mean skips NaN as it skips null.
    return F.when(~F.isnan(variable), F.col(variable).cast("double"))


def choropleth(df: DataFrame, id_column: str, variable: str, year: int, extra: list[str] = []) -> DataFrame:
    """AGG-06: mean of a variable per spatial id in one year; null ids and empty means dropped."""
    return (
        df.where((F.col("year") == year) & F.col(id_column).isNotNull())
        .groupBy(*extra, F.col(id_column).cast("long").alias("spatial_id"))
        .agg(F.avg(_value(variable)).alias("value"))
        .where(is_finite(F.col("value")))
        .orderBy(*extra, "spatial_id")
    )


def time_series(
    df: DataFrame, variable: str, yearly: bool = False, year: int | None = None, extra: list[str] = []
) -> DataFrame:
    """AGG-07: mean per year and month (basin) or per year (patch, month 0); day is always 1."""
    rows = df if year is None else df.where(F.col("year") == year)
    keys = ["year"] if yearly else ["year", "month"]
    rows = rows.where(F.col("year").isNotNull() if yearly else F.col("year").isNotNull() & F.col("month").isNotNull())
    month = F.lit(0) if yearly else F.col("month").cast("int")
    return (
        rows.groupBy(*extra, *keys).agg(F.avg(_value(variable)).alias("value"))
        .select(*extra, F.col("year").cast("int").alias("year"), month.alias("month"), F.lit(1).alias("day"), "value")
        .withColumn("label", series_label(F.col("year"), F.col("month")))
        .orderBy(*extra, "year", "month")
    )
