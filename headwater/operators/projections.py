"""Public projections of the serving tables and their stable ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Public properties of the three feature kinds.
WATERSHED_PROPERTIES = [
    "pws_name", "county_nam", "shape_area", "srcname", "srctype", "owner_type", "pop_group", "treat_type",
    "huc10_utility_count", "huc10_pws_names",
]
SUBCATCHMENT_PROPERTIES = [
    "topazid", "weppid", "slope_scalar", "length", "width", "aspect", "hillslope_area", "simple_texture",
]
CHANNEL_PROPERTIES = ["topazid", "weppid", "order"]


def watershed_rows(df: DataFrame, simplified: bool = False, route_id: Column | None = None) -> DataFrame:
    """PRJ-06: id, public properties and one of the two boundaries."""
    geometry = F.col("simplified_geom" if simplified else "geom").alias("geometry")
    return df.select((F.col("runid") if route_id is None else route_id).alias("id"), *WATERSHED_PROPERTIES, geometry)


def subcatchment_rows(df: DataFrame, watershed_key: Column) -> DataFrame:
    """PRJ-06 and PRJ-07: public properties with the id ``subcatchment:<key>:<topazid>``."""
    stable = F.concat_ws(":", F.lit("subcatchment"), watershed_key, F.col("topazid").cast("string"))
    return df.select(stable.alias("stable_id"), *SUBCATCHMENT_PROPERTIES)


def channel_rows(df: DataFrame, watershed_key: Column) -> DataFrame:
    """PRJ-06 and PRJ-07: public properties with the id ``channel:<key>:<topazid>:<weppid>:<order>``."""
    parts = [F.col(c).cast("string") for c in CHANNEL_PROPERTIES]
    return df.select(F.concat_ws(":", F.lit("channel"), watershed_key, *parts).alias("stable_id"), *CHANNEL_PROPERTIES)
