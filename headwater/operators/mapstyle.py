"""Map styles: values joined to features, placed in a robust range and coloured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.functions.colours import colour_of
from headwater.functions.numbers import is_finite, normalise
from headwater.operators.keys import join_large_parents, join_parents
from headwater.operators.ranking import robust_range
from headwater.session import checkpoint

# Colour of a feature no layer claims, and fill opacities of the three layers.
DEFAULT_COLOUR = "#ffff00"


def fill_colour(value: Column, low: Column, high: Column, scale: str) -> Column:
    """FN-N01 and FN-N02: colour of a value in a range; null where there is no value."""
    return F.when(value.isNotNull(), colour_of(normalise(value, low, high), scale))


def value_style(
    features: DataFrame, values: DataFrame, on: list[str], groups: list[str],
    scale: str = "viridis", low: float = 0.02, high: float = 0.98,
) -> DataFrame:
    """JN-13: features with their value, the range of the group and a fill colour.

    A feature without a value keeps a null colour. An empty group has the range 0..1.
    """
    finite = checkpoint(values.where(is_finite(F.col("value"))))  # read by every pass of the ranges
    ranges = robust_range(finite, groups, "value", low, high).drop("n")
    styled = join_parents(features.join(finite, on, "left"), ranges, groups, on)
    low_end, high_end = F.coalesce("range_min", F.lit(0.0)), F.coalesce("range_max", F.lit(1.0))
    return styled.withColumn("range_min", low_end).withColumn("range_max", high_end).withColumn(
        "fill_colour", fill_colour(F.col("value"), F.col("range_min"), F.col("range_max"), scale)
    )


def layered_colour(
    features: DataFrame, vegetation: DataFrame, scenario: DataFrame, landuse: DataFrame,
    run: list[str] = [],
) -> DataFrame:
    """JN-18: vegetation colour by model id, else scenario colour by model id, else land-use
    colour by hillslope id, else the default. Ids that are null or 0 skip a stage.

    The three colour tables hold one row per id (and run), so each join is one-to-one.
    """
    by_model = lambda df, name: df.select(*run, F.col("wepp_id").alias("weppid"), F.col("colour").alias(name))
    models = by_model(vegetation, "_vegetation").join(by_model(scenario, "_scenario"), [*run, "weppid"], "full_outer")
    hillslopes = landuse.select(*run, F.col("topaz_id").alias("topazid"), F.col("colour").alias("_landuse"))
    placed = join_large_parents(
        join_large_parents(features, models, [*run, "weppid"], features.columns), hillslopes, [*run, "topazid"], features.columns
    )
    has_model, has_hillslope = F.coalesce(F.col("weppid"), F.lit(0)) != 0, F.coalesce(F.col("topazid"), F.lit(0)) != 0
    landuse_colour = F.when(F.col("_landuse") != "", F.col("_landuse"))
    vegetation_hit = has_model & F.col("_vegetation").isNotNull()
    scenario_hit = has_model & F.col("_scenario").isNotNull()
    landuse_hit = has_hillslope & landuse_colour.isNotNull()
    return placed.select(
        *features.columns,
        F.when(vegetation_hit, F.col("_vegetation")).when(scenario_hit, F.col("_scenario"))
        .when(landuse_hit, landuse_colour).otherwise(F.lit(DEFAULT_COLOUR)).alias("colour"),
        F.when(vegetation_hit, "vegetation").when(scenario_hit, "scenario")
        .when(landuse_hit, "landuse").otherwise(F.lit("default")).alias("layer"),
    )
