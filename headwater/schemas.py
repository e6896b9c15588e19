"""Explicit schemas of the serving, ledger and pixel tables."""

from __future__ import annotations

from pyspark.sql import types as T

from headwater.functions.geometry import MULTIPOLYGON
from headwater.operators.ingest import HILLSLOPE_FIELDS, LANDUSE_FIELDS, SOIL_FIELDS

_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "bigint": T.LongType()}


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


def _attributes(fields: list[tuple[str, str, str]]) -> list[tuple[str, T.DataType]]:
    return [(target, _TYPES[kind]) for target, _, kind in fields]


TEXT, WHOLE, NUMBER, FLAG, TIME = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()

WATERSHEDS = _struct(
    ("runid", TEXT), ("logical_id", TEXT),
    *[(n, TEXT) for n in (
        "pws_id", "srcname", "pws_name", "county_nam", "state", "huc10_id", "huc10_name", "wws_code", "srctype",
    )],
    ("shape_leng", NUMBER), ("shape_area", NUMBER), ("area_km2", NUMBER),
    *[(n, TEXT) for n in (
        "owner_type", "pop_group", "treat_type", "conn_group", "huc10_pws_names", "huc10_owner_types",
        "huc10_pop_groups", "huc10_treat_types",
    )],
    ("huc10_utility_count", WHOLE), ("geom", MULTIPOLYGON), ("simplified_geom", MULTIPOLYGON),
)
SUBCATCHMENTS = _struct(
    ("watershed_id", TEXT), ("logical_id", TEXT), ("topazid", WHOLE), ("weppid", WHOLE), ("geom", MULTIPOLYGON),
    *_attributes(HILLSLOPE_FIELDS), *_attributes(SOIL_FIELDS), *_attributes(LANDUSE_FIELDS),
)
CHANNELS = _struct(
    ("watershed_id", TEXT), ("logical_id", TEXT), ("topazid", WHOLE), ("weppid", WHOLE), ("order", WHOLE),
    ("geom", MULTIPOLYGON),
)
RAP = _struct(("topaz_id", WHOLE), ("year", WHOLE), ("band", WHOLE), ("value", NUMBER))
LOSS_SUMMARY = _struct(("key", TEXT), ("value", TEXT))
RUN_ALIASES = _struct(("runid", TEXT), ("identity_id", TEXT), ("is_current", FLAG))
IDENTITIES = _struct(("identity_id", TEXT), ("watershed_key", TEXT), ("collection", TEXT), ("status", TEXT))
RUN_STATES = _struct(
    ("release_id", TEXT), ("collection", TEXT), ("watershed_key", TEXT), ("runid", TEXT),
    *[(f"{n}_fingerprint", TEXT) for n in (
        "run", "metadata", "geometry", "subcatchment", "channel", "hillslope", "soil", "landuse", "capability",
    )],
    ("actual_watersheds", WHOLE), ("actual_subcatchments", WHOLE), ("actual_channels", WHOLE),
    ("validation_status", TEXT),
)
ARTIFACTS = _struct(
    ("runid", TEXT), ("role", TEXT), ("uri", TEXT), ("sha256", TEXT), ("byte_size", T.LongType()), ("media_type", TEXT),
)
ATTEMPTS = _struct(
    ("id", TEXT), ("status", TEXT), ("updated_at", TIME), ("lease_expires_at", TIME), ("lease_active", FLAG),
)
PIXELS = _struct(("raster_id", TEXT), ("row", WHOLE), ("col", WHOLE), ("x", NUMBER), ("y", NUMBER), ("value", NUMBER))
