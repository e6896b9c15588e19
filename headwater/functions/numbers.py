"""Numeric column functions: finite coercion, rounding, scaling, ranges, rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")
# Decimal text the browser accepts as a number; Java suffixes such as "1d" are not among it.
NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def is_finite(value: Column) -> Column:
    """True for a non-null double that is neither NaN nor infinite (FLT-06)."""
    number = value.cast("double")
    return number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(INFINITY))


def finite_or(value: Column, fallback: float | None = 0.0) -> Column:
    """PRJ-05 for a numeric column: null becomes 0, NaN and infinities the fallback."""
    number = value.cast("double")
    return (
        F.when(number.isNull(), F.lit(0.0))
        .when(is_finite(number), number)
        .otherwise(F.lit(fallback).cast("double"))
    )


def finite_text_or(value: Column, fallback: float | None = 0.0) -> Column:
    """PRJ-05 for a text column: null and blank become 0, unparsable text the fallback."""
    number = F.when(value.rlike(NUMBER_TEXT), F.trim(value).try_cast("double"))
    return (
        F.when(value.isNull() | (F.trim(value) == ""), F.lit(0.0))
        .when(number.isNotNull() & is_finite(number), number)
        .otherwise(F.lit(fallback).cast("double"))
    )


def divide_or_null(numerator: Column, denominator: Column) -> Column:
    """Division that gives null on a zero divisor; plain division throws in ANSI mode."""
    return numerator / F.nullif(denominator, F.lit(0).cast("double"))


def round_half_up(value: Column) -> Column:
    """The browser's rounding: halves go towards positive infinity."""
    return F.floor(value + F.lit(0.5))


def normalise(value: Column, low: Column, high: Column) -> Column:
    """FN-N01: position of a value in a range, 0.5 on a flat range, clamped to 0..1."""
    span = F.nullif(high - low, F.lit(0.0))
    return F.when(high == low, F.lit(0.5)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / span))
    )


def render_range(
    own_min: Column, own_max: Column, group_min: Column, group_max: Column, clamp_max: Column
) -> tuple[Column, Column]:
    """FN-N07: group bounds before own bounds, upper bound clamped, defaults 0 and 1."""
    low = F.coalesce(group_min, own_min, F.lit(0.0))
    high = F.coalesce(group_max, own_max)
    return low, F.coalesce(F.when(high.isNotNull(), F.least(high, clamp_max)), F.lit(1.0))


def within_world(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """FN-N08: ordered bounds inside the longitude and latitude limits."""
    return (
        (minx >= -180) & (minx <= maxx) & (maxx <= 180) & (miny >= -90) & (miny <= maxy) & (maxy <= 90)
    )


def bounds_close(observed: list[Column], expected: list[Column], tolerance: float = 0.001) -> Column:
    """FN-N08: every one of the paired bounds differs by at most the tolerance."""
    close = F.lit(True)
    for seen, wanted in zip(observed, expected, strict=True):
        close = close & (F.abs(seen - wanted) <= F.lit(tolerance))
    return close


def scale_mass(kilograms: Column) -> Column:
    """FN-N06: tonnes from 1000 kg upwards."""
    return F.when(F.abs(kilograms) >= 1000, kilograms / F.lit(1000.0)).otherwise(kilograms)


def mass_unit(kilograms: Column) -> Column:
    return F.when(F.abs(kilograms) >= 1000, F.lit("t")).otherwise(F.lit("kg"))


def legend_range(low: Column, high: Column, unit: Column) -> Column:
    """FN-N06: a legend's range and unit, (low, high, unit): kilograms to tonnes if either end reaches 1000 kg."""
    large = (unit == "kg") & (F.greatest(F.abs(low), F.abs(high)) >= 1000)
    scaled = lambda end: F.when(large, end / F.lit(1000.0)).otherwise(end)
    return F.struct(scaled(low).alias("low"), scaled(high).alias("high"), F.when(large, "t").otherwise(unit).alias("unit"))


def _exponent_text(value: Column) -> Column:
    # "%.2e" pads the exponent to two digits, the browser does not.
    return F.regexp_replace(F.format_string("%.2e", value), r"e([+-])0(\d)$", "e$1$2")


def number_text(value: Column) -> Column:
    """FN-N06: legend text; exponent form from 1e6 and below 0.01, else 1 or 2 decimals."""
    size = F.abs(value)
    decimals_one = (value == F.floor(value).cast("double")) | (size >= 100)
    trimmed = lambda text: F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return (
        F.when((size >= 1e6) | ((value != 0) & (size < 0.01)), _exponent_text(value))
        .when(decimals_one, trimmed(F.format_number(value, 1)))
        .otherwise(trimmed(F.format_number(value, 2)))
    )


def age_seconds(now: Column, then: Column) -> Column:
    """FN-D01: whole seconds between two timestamps of one kind; negative means the time lies
    ahead. No session time zone enters the result for zone-less timestamps."""
    return F.timestamp_diff("SECOND", then, now)


def series_label(year: Column, month: Column) -> Column:
    """FN-D02: ``YYYY`` for a yearly point (month 0), else ``YYYY-MM``."""
    return F.when(month == 0, year.cast("string")).otherwise(
        F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"))
    )
