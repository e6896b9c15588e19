"""Raster values as pixel tables: ranges, rescaling, colour classes, legends, tile index."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.functions.colours import (
    BURN_CLASSES, BURN_PALETTES, STREAM, categorical_colour_of, hex_upper, legend_colours, map_colour_of,
)
from headwater.functions.numbers import is_finite
from headwater.operators.keys import join_parents

# Latitude limit of the square world map.
WEB_MERCATOR_LIMIT = 85.0511287798066


def value_ranges(pixels: DataFrame, keys: list[str], change: Column) -> DataFrame:
    """AGG-19: least and greatest value per raster; change maps that go below zero are made
    symmetric. ``change`` is an expression over the key columns."""
    plain = pixels.where(is_finite(F.col("value"))).groupBy(*keys).agg(
        F.min("value").alias("_low"), F.max("value").alias("_high"), F.count(F.lit(1)).alias("pixels")
    )
    far = F.greatest(F.abs("_low"), F.abs("_high"))
    mirrored = change & (F.col("_low") < 0)
    return plain.select(
        *keys, "pixels", change.alias("is_change"),
        F.when(mirrored, -far).otherwise(F.col("_low")).alias("range_min"),
        F.when(mirrored, far).otherwise(F.col("_high")).alias("range_max"),
    )


def rescale(pixels: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """RST-01: pixel levels 0..255 by the range of their raster.

    A flat change map is centred; any other flat raster stays at the bottom of the scale.
    """
    flat = F.col("range_min") == F.col("range_max")
    nudge = F.greatest(F.abs("range_min") * 0.01, F.lit(1e-10))
    low = F.when(flat & F.col("is_change"), F.col("range_min") - nudge).otherwise(F.col("range_min"))
    high = (
        F.when(flat & F.col("is_change"), F.col("range_max") + nudge)
        .when(flat, F.col("range_min") + F.lit(1e-10))
        .otherwise(F.col("range_max"))
    )
    bounded = ranges.select(*keys, "is_change", low.alias("_low"), high.alias("_high"))
    part = (F.col("value") - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0))
    level = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(part, F.lit(0.0)))) * 255
    return join_parents(pixels.where(is_finite(F.col("value"))), bounded, keys, pixels.columns, "inner").select(
        *pixels.columns, "is_change", level.alias("level")
    )


def coloured(levels: DataFrame) -> DataFrame:
    """RST-02: diverging colours for change maps, sequential ones for the rest."""
    return levels.withColumn(
        "colour",
        F.when(F.col("is_change"), map_colour_of(F.col("level"), "diverging"))
        .otherwise(map_colour_of(F.col("level"), "sequential")),
    )


def burn_palette(spark: SparkSession, mode: str = "legacy") -> DataFrame:
    """RST-03: the four burn classes; an unknown mode falls back to the first palette."""
    palette = BURN_PALETTES.get(mode, BURN_PALETTES["legacy"])
    rows = [
        (pixel, code, label, *rgb, 255, hex_upper(rgb))
        for pixel, ((code, label), rgb) in enumerate(zip(BURN_CLASSES, palette))
    ]
    return spark.createDataFrame(
        rows, "pixel int, class_value int, label string, red int, green int, blue int, alpha int, hex string"
    )


def burn_classes(pixels: DataFrame, mode: str = "legacy") -> DataFrame:
    """RST-03: class, label and colour of every burn severity pixel; other codes have none."""
    palette = burn_palette(pixels.sparkSession, mode)  # four rows
    return pixels.join(F.broadcast(palette), F.col("value").cast("int") == F.col("pixel"), "left").drop("pixel")


def stream_colour(value: Column) -> Column:
    """RST-04: stream pixels (value 1) in one colour, all others transparent."""
    return F.when(value == 1, F.lit(hex_upper(STREAM)))


def continuous_legend(ranges: DataFrame, kind: Column, kinds: list[str], digits: int, stops: int = 5) -> DataFrame:
    """FN-N03: evenly spaced legend stops of every range row, rounded half to even.

    ``kind`` picks the colour scale of a row among ``kinds``; 6 digits for map outputs, 4
    for map inputs.
    """
    table = F.create_map(*[
        part for name in kinds
        for part in (F.lit(name), F.array(*[F.lit(c) for c in legend_colours(name, stops)]))
    ])
    return (
        ranges.withColumn("stop", F.explode(F.sequence(F.lit(0), F.lit(stops - 1))))
        .withColumn("fraction", F.col("stop") / (stops - 1) if stops > 1 else F.lit(0.5))
        .withColumn("value", F.bround(F.col("range_min") + F.col("fraction") * (F.col("range_max") - F.col("range_min")), digits))
        .withColumn("hex", F.get(F.element_at(table, kind), F.col("stop")))
        .drop("fraction")
    )


def categorical_legend(classes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """FN-N04: distinct values of each categorical raster with the palette cycled in value order.

    Class values are distinct before they are ranked; a raster declares at most 1024 of them.
    """
    from pyspark.sql import Window

    distinct = classes.select(*keys, value).distinct()
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(value)) - 1
    return distinct.withColumn("position", position).withColumn("hex", categorical_colour_of(F.col("position")))


def tile_address(lon: Column, lat: Column, zoom: int) -> Column:
    """RST-05: Web-Mercator tile column and row, and the pixel inside a 256-pixel tile."""
    size = float(2**zoom)
    bounded = F.greatest(F.lit(-WEB_MERCATOR_LIMIT), F.least(F.lit(WEB_MERCATOR_LIMIT), lat))
    across = (lon + 180.0) / 360.0 * size
    sine = F.sin(F.radians(bounded))
    down = (F.lit(0.5) - F.log((1 + sine) / (1 - sine)) / (4 * math.pi)) * size
    cell = lambda place: F.least(F.lit(int(size) - 1), F.greatest(F.lit(0), F.floor(place))).cast("int")
    inside = lambda place, tile: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((place - tile) * 256))).cast("int")
    x, y = cell(across), cell(down)
    return F.struct(
        F.lit(zoom).alias("z"), x.alias("x"), y.alias("y"),
        inside(across, x).alias("px"), inside(down, y).alias("py"),
        across.alias("across"), down.alias("down"),
    )


def tile_pixels(pixels: DataFrame, keys: list[str], zoom: int) -> DataFrame:
    """RST-05: one value per tile pixel, that of the source pixel nearest its centre."""
    placed = pixels.where(is_finite(F.col("value"))).withColumn("_t", tile_address(F.col("x"), F.col("y"), zoom))
    centre = lambda place, tile, pixel: F.abs((F.col(place) - F.col(tile)) * 256 - F.col(pixel) - 0.5)
    away = F.pow(centre("_t.across", "_t.x", "_t.px"), 2) + F.pow(centre("_t.down", "_t.y", "_t.py"), 2)
    return placed.groupBy(
        *keys, F.col("_t.z").alias("z"), F.col("_t.x").alias("tile_x"), F.col("_t.y").alias("tile_y"),
        F.col("_t.px").alias("px"), F.col("_t.py").alias("py"),
    ).agg(
        # Ties on distance go to the lower source row and column.
        F.min_by("value", F.struct(away, F.col("row"), F.col("col"))).alias("value")
    )


def tile_counts(pixels: DataFrame, keys: list[str], zoom: int) -> DataFrame:
    """RST-05: how many tile pixels and what values each tile holds."""
    return tile_pixels(pixels, keys, zoom).groupBy(*keys, "z", "tile_x", "tile_y").agg(
        F.count(F.lit(1)).alias("tile_pixels"), F.min("value").alias("low"), F.max("value").alias("high")
    )


def metadata_agreement(declared: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """RST-06: declared against observed raster metadata; bounds may differ by 1e-9."""
    exact = ["crs", "width", "height", "bands", "nodata"]
    bounds = ["minx", "miny", "maxx", "maxy"]
    right = observed.select(key, *[F.col(c).alias(f"_o_{c}") for c in exact + bounds], F.lit(True).alias("_seen"))
    joined = declared.join(right, key, "left")
    differing = [F.when(~F.col(c).eqNullSafe(F.col(f"_o_{c}")), F.lit(c)) for c in exact]
    near = F.lit(True)
    for name in bounds:
        near = near & F.coalesce(F.abs(F.col(name) - F.col(f"_o_{name}")) <= F.lit(1e-9), F.lit(False))
    differing.append(F.when(~near, F.lit("bounds")))
    fields = F.when(F.col("_seen").isNull(), F.array(F.lit("missing"))).otherwise(
        F.array_compact(F.array(*differing))
    )
    return joined.select(key, F.array_join(fields, ",").alias("differs"), (F.size(fields) == 0).alias("agrees"))


def sources_by_role(geometries: DataFrame, requests: DataFrame) -> DataFrame:
    """JN-19: the first declared geometry of a scale whose scenarios hold the requested one.

    ``geometries``: position, scale, scenarios, revision. A request without a scenario takes
    the first geometry of the scale.
    """
    listed = geometries.select("scale", "position", "revision", F.explode("scenarios").alias("scenario"))
    by_scenario = listed.groupBy("scale", "scenario").agg(F.min_by("revision", "position").alias("_exact"))
    by_scale = geometries.groupBy("scale").agg(F.min_by("revision", "position").alias("_any"))
    return requests.join(by_scenario, ["scale", "scenario"], "left").join(by_scale, "scale", "left").withColumn(
        "revision", F.when(F.col("scenario").isNull(), F.col("_any")).otherwise(F.col("_exact"))
    ).drop("_exact", "_any")


def legacy_revision(scale: Column, scenario: Column) -> Column:
    """JN-19, older rule: one hillslope geometry; patches of 2021 for two scenarios, else 1985."""
    return F.when(scale == "hillslope", F.lit("legacy-hillslope")).when(
        scale == "patch",
        F.when(scenario.isin("S2", "S4b"), F.lit("legacy-2021")).otherwise(F.lit("legacy-1985")),
    )


def variable_scales(parquets: DataFrame) -> DataFrame:
    """AGG-27: the scales each declared variable is available at, sorted."""
    scale = F.when(F.col("role") == "patch", F.lit("patch")).otherwise(F.lit("hillslope"))
    declared = parquets.select(F.explode("variables").alias("variable"), scale.alias("scale"))
    # A set of at most two values.
    return declared.groupBy("variable").agg(F.array_join(F.array_sort(F.collect_set("scale")), ",").alias("scales"))
