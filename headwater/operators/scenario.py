"""Fire and thinning scenarios: hillslope losses and outlet summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.functions.numbers import divide_or_null, finite_or, is_finite
from headwater.functions.text import scenario_label

# Source column names of the hillslope loss table, and the summary keys.
LOSS_COLUMNS = {
    "runoff": "Runoff Volume",
    "subrunoff": "Subrunoff Volume",
    "baseflow": "Baseflow Volume",
    "soil_loss": "Soil Loss",
    "sediment_deposition": "Sediment Deposition",
    "sediment_yield": "Sediment Yield",
    "hillslope_area": "Hillslope Area",
}
SUMMARY_KEYS = {
    "area": "Total contributing area to outlet",
    "discharge": "Avg. Ann. water discharge from outlet",
    "hillslope_loss": "Avg. Ann. total hillslope soil loss",
    "channel_loss": "Avg. Ann. total channel soil loss",
    "sediment": "Avg. Ann. sediment discharge from outlet",
}
BASE_RUN_SCENARIO = "wildfire"
DEFAULT_LANDUSE_SCENARIO = "undisturbed"


def scenario_folder(scenario: str | None) -> str | None:
    """SRC-02: the sub-folder of a scenario; the wildfire scenario is the base run itself."""
    return None if scenario == BASE_RUN_SCENARIO else scenario


def loss_rows(loss: DataFrame, extra: list[str] = []) -> DataFrame:
    """PRJ-04: renamed loss columns, non-finite values 0, ordered by model id.

    The other columns break ties, so that the sort can also split one id with very many rows.
    """
    named = loss.select(
        *extra,
        finite_or(F.col("wepp_id")).cast("long").alias("wepp_id"),
        *[finite_or(F.col(f"`{source}`")).alias(name) for name, source in LOSS_COLUMNS.items()],
    )
    return named.orderBy("wepp_id", *extra, *LOSS_COLUMNS)


def summary(pairs: DataFrame, position: str, groups: list[str] = ["scenario"]) -> DataFrame:
    """AGG-08: key/value rows to one row per scenario with per-area figures.

    Non-finite values are dropped first and the last value of a key wins, so a scenario
    without any finite metric does not appear. Keys other than the five are not read.
    """
    value = F.col("value").try_cast("double")
    finite = pairs.where(is_finite(value) & (F.coalesce("key", F.lit("")) != "")).withColumn("value", value)
    last = {
        name: F.max_by(
            F.when(F.col("key") == key, F.col("value")), F.when(F.col("key") == key, F.col(position))
        ).alias(name)
        for name, key in SUMMARY_KEYS.items()
    }
    wide = finite.groupBy(*groups).agg(*last.values())
    area = F.when(F.col("area") > 0, F.col("area"))
    per_area = lambda name: divide_or_null(F.col(name), area)
    return wide.select(
        *groups,
        scenario_label(F.col("scenario")).alias("label"),
        (divide_or_null(F.col("discharge"), area * 10_000) * 1_000).alias("water_discharge"),
        per_area("hillslope_loss").alias("hillslope_soil_loss"),
        per_area("channel_loss").alias("channel_soil_loss"),
        per_area("sediment").alias("sediment_discharge"),
        F.col("hillslope_loss").alias("hillslope_soil_loss_tonnes"),
        F.col("channel_loss").alias("channel_soil_loss_tonnes"),
        F.col("sediment").alias("sediment_discharge_tonnes"),
    )


def landuse_rows(landuse: DataFrame, limit: int | None = None) -> DataFrame:
    """SRT-02: land use per hillslope in id order; a limit is the caller's page size."""
    rows = landuse.select("topaz_id", "desc", "color").orderBy("topaz_id")
    return rows if limit is None else rows.limit(limit)


def landuse_legend(landuse: DataFrame, groups: list[str] = []) -> DataFrame:
    """AGG-24: each colour with the description of its lowest hillslope id; empties skipped."""
    filled = landuse.where((F.coalesce("color", F.lit("")) != "") & (F.coalesce("desc", F.lit("")) != ""))
    return filled.groupBy(*groups, "color").agg(F.min_by("desc", "topaz_id").alias("desc"))
