"""Vegetation cover: area-weighted yearly means, choropleths, hillslope series, chart fill.

Cover rows are combined per hillslope, year and band before they meet the hillslope table.
What is joined is then bounded by years times bands per hillslope, so one hillslope with a
large share of all rows costs no more than any other, and the sums stay exact in meaning:
``sum(value * area) = area * sum(value)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.functions.numbers import divide_or_null, finite_or
from headwater.operators.query import band_filter, year_filter

SHRUB, TREE = 5, 6
SPINE = (1986, 2023)


def _filtered(rap: DataFrame, bands: int | list[int], year=None) -> tuple[DataFrame, list[int]]:
    wanted = band_filter(bands)["value"]
    wanted = wanted if isinstance(wanted, list) else [wanted]
    rows = rap.where(F.col("band").isin(*wanted))
    for item in year_filter(year, "year"):
        rows = rows.where(F.col("year") == item["value"])
    return rows, wanted


def _weighted(rap: DataFrame, hillslopes: DataFrame, extra: list[str]) -> DataFrame:
    """Rows combined per hillslope, then joined: columns value_area and area are ready to sum."""
    combined = rap.groupBy("topaz_id", "year", "band").agg(
        F.sum("value").alias("_value"), F.count(F.lit(1)).alias("_rows"), F.count("value").alias("_valued")
    )
    dims = hillslopes.select("topaz_id", "area", *extra)
    return combined.join(dims, "topaz_id").select(
        "year", "band", *extra,
        (F.col("_value") * F.col("area")).alias("value_area"),
        (F.col("_rows") * F.col("area")).alias("area"),
    )


def _band_mean(band: int | None) -> Column:
    if band is None:
        return divide_or_null(F.sum("value_area"), F.sum("area"))
    pick = lambda name: F.sum(F.when(F.col("band") == band, F.col(name)).otherwise(F.lit(0.0)))
    return divide_or_null(pick("value_area"), pick("area"))


def cover_by_year(rap: DataFrame, hillslopes: DataFrame, year=None) -> DataFrame:
    """AGG-01: shrub and tree cover of the watershed per year; no cover counts as 0."""
    rows, _ = _filtered(rap, [SHRUB, TREE], year)
    yearly = _weighted(rows, hillslopes, []).groupBy("year").agg(
        _band_mean(SHRUB).alias("shrub"), _band_mean(TREE).alias("tree")
    )
    shrub, tree = finite_or(F.col("shrub")), finite_or(F.col("tree"))
    return yearly.select(
        "year", shrub.alias("shrub"), tree.alias("tree"), (shrub + tree).alias("coverage")
    ).orderBy("year")


def choropleth(rap: DataFrame, hillslopes: DataFrame, bands: int | list[int], year=None) -> DataFrame:
    """AGG-02 and AGG-03: cover per model id; several bands give the sum of the band means,
    with the shrub and tree parts beside it."""
    rows, wanted = _filtered(rap, bands, year)
    weighted = _weighted(rows, hillslopes, ["wepp_id"])
    zeroed = lambda column: F.coalesce(column, F.lit(0.0))
    if len(wanted) == 1:
        # One band needs no CASE per row.
        parts = [zeroed(_band_mean(None)).alias("value")]
    else:
        total = F.lit(0.0)
        for band in wanted:
            total = total + zeroed(_band_mean(band))
        names = {SHRUB: "shrub", TREE: "tree"}
        parts = [total.alias("value")] + [
            zeroed(_band_mean(band)).alias(names[band]) for band in dict.fromkeys(wanted) if band in names
        ]
    return weighted.groupBy("wepp_id").agg(*parts).orderBy("wepp_id")


def _missing(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of ``rows`` with each year of the spine that they have no row of.

    The years seen are the bits of one number per key, and the missing ones are written out after the grouping: no
    grouping sees more rows than ``rows`` has, and blank years are never shuffled.
    """
    seen = F.when(F.col("year").between(*SPINE), F.expr(f"shiftleft(1L, int(year) - {SPINE[0]})"))
    years = rows.select(*keys, seen.alias("_seen")).groupBy(*keys).agg(F.coalesce(F.bit_or("_seen"), F.lit(0)).cast("long").alias("_seen"))
    missing = F.expr(f"filter(sequence({SPINE[0]}, {SPINE[1]}), y -> getbit(_seen, y - {SPINE[0]}) = 0)")
    return years.select(*keys, F.explode(missing).alias("year"))


def hillslope_series(rap: DataFrame) -> DataFrame:
    """AGG-04 for every hillslope: yearly shrub, tree and coverage sums on the fixed spine.

    Years without rows are 0 and years off the spine are dropped. Years of zeros are added to the sums after the
    grouping, so no join is needed.
    """
    rows, _ = _filtered(rap, [SHRUB, TREE])
    value = finite_or(F.col("value"))
    pick = lambda band: F.when(F.col("band") == band, value).otherwise(F.lit(0.0))
    measured = (
        rows.where(F.col("year").between(*SPINE))
        .groupBy("topaz_id", "year").agg(F.sum(pick(SHRUB)).alias("shrub"), F.sum(pick(TREE)).alias("tree"))
    )
    zeros = _missing(rows, ["topaz_id"]).select("topaz_id", "year", F.lit(0.0).alias("shrub"), F.lit(0.0).alias("tree"))
    return measured.unionByName(zeros).withColumn("coverage", F.col("shrub") + F.col("tree"))


def one_hillslope_series(rap: DataFrame, topaz_id: int) -> DataFrame:
    """AGG-04 for one hillslope, in year order (FLT-01, SRT-01)."""
    return hillslope_series(rap.where(F.col("topaz_id") == topaz_id)).orderBy("year")


def chart_fill(series: DataFrame, keys: list[str], position: str, year: int | None = None) -> DataFrame:
    """AGG-05: chart points per key from series rows with an input position.

    For all years: the spine filled with zeros, the row with the highest position winning,
    years off the spine kept. For one year: the first row of that year, or zeros.
    """
    parts = ["coverage", "shrub", "tree"]
    point = F.struct(*[F.coalesce(F.col(p), F.lit(0.0)).alias(p) for p in parts])
    flat = [F.col(f"_point.{p}").alias(p) for p in parts]
    zero = F.struct(*[F.lit(0.0).alias(p) for p in parts])
    if year is not None:
        found = series.groupBy(*keys).agg(
            F.min_by(F.when(F.col("year") == year, point), F.when(F.col("year") == year, F.col(position))).alias("_point")
        )
        return found.withColumn("_point", F.coalesce("_point", zero)).select(
            *keys, F.lit(year).alias("year"), *flat
        )
    latest = series.select(*keys, "year", F.col(position).cast("long").alias("_at"), point.alias("_point"))
    found = latest.groupBy(*keys, "year").agg(F.max_by("_point", "_at").alias("_point"))
    blank = _missing(series, keys).select(*keys, "year", zero.alias("_point"))
    return found.withColumn("_point", F.coalesce("_point", zero)).unionByName(blank).select(*keys, "year", *flat)
