"""Geometry as nested arrays: polygons of rings of points, all as column expressions.

A multipolygon is ``array<array<array<struct<x:double,y:double>>>>``. It is a wide column:
drop it before a shuffle that does not need it and join it back by key.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headwater.functions.outlines import TOLERANCE, thinned

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
MULTIPOLYGON = T.ArrayType(T.ArrayType(T.ArrayType(POINT)))
GEOMETRY_TYPES = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon")
_RING = "array<array<double>>"


def _as_points(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y")))


def multipolygon(kind: Column, coordinates: Column) -> Column:
    """FN-G01: GeoJSON type and coordinates text to a multipolygon; anything empty gives null."""
    single = F.array(F.from_json(coordinates, f"array<{_RING}>"))
    several = F.from_json(coordinates, f"array<array<{_RING}>>")
    polygons = F.when(kind == "Polygon", single).when(kind == "MultiPolygon", several)
    built = F.transform(polygons, lambda polygon: F.transform(polygon, _as_points))
    return F.when(F.size(points(built)) > 0, built)


def _bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: lambdas would evaluate it on every use."""
    return F.get(F.transform(F.array(value), body), 0)


def points(geometry: Column) -> Column:
    return F.flatten(F.flatten(geometry))


def bbox(geometry: Column) -> Column:
    """AGG-25 for one row: struct of minx, miny, maxx, maxy; null without points."""
    def box(flat):
        xs, ys = F.transform(flat, lambda p: p["x"]), F.transform(flat, lambda p: p["y"])
        return F.struct(
            F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"),
            F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"),
        )

    return F.when(F.size(points(geometry)) > 0, _bound(points(geometry), box))


def _ring_area(ring: Column) -> Column:
    """Shoelace formula relative to the first point, which keeps small rings far from the
    origin exact."""
    def measured(bound):
        steps, origin = F.size(bound) - 1, F.get(bound, 0)
        crosses = F.zip_with(
            F.slice(bound, F.lit(1), steps), F.slice(bound, F.lit(2), steps),
            lambda a, b: (a["x"] - origin["x"]) * (b["y"] - origin["y"]) - (b["x"] - origin["x"]) * (a["y"] - origin["y"]),
        )
        return F.abs(F.aggregate(crosses, F.lit(0.0), lambda total, c: total + c)) / 2

    return _bound(ring, measured)


def area(geometry: Column) -> Column:
    """FN-G04: planar area in squared degrees; the first ring of a polygon less its holes."""
    def polygon_area(polygon):
        holes = F.slice(polygon, F.lit(2), F.greatest(F.size(polygon) - 1, F.lit(0)))
        return _ring_area(F.get(polygon, 0)) - F.aggregate(
            holes, F.lit(0.0), lambda total, ring: total + _ring_area(ring)
        )

    return F.aggregate(geometry, F.lit(0.0), lambda total, polygon: total + polygon_area(polygon))


def geojson(geometry: Column, digits: int = 6) -> Column:
    """FN-G02: GeoJSON text with rounded coordinates; null geometry stays null."""
    rounded = F.transform(
        geometry,
        lambda polygon: F.transform(
            polygon,
            lambda ring: F.transform(ring, lambda p: F.array(F.round(p["x"], digits), F.round(p["y"], digits))),
        ),
    )
    return F.when(
        geometry.isNotNull(),
        F.concat(F.lit('{"type":"MultiPolygon","coordinates":'), F.to_json(rounded), F.lit("}")),
    )


def _finite(number: Column) -> Column:
    return ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))


def valid_coordinates(flat_points: Column) -> Column:
    """FN-G03: at least one point, all finite and inside the longitude/latitude limits."""
    return F.coalesce(
        (F.size(flat_points) > 0)
        & F.forall(
            flat_points,
            lambda p: p["x"].isNotNull() & p["y"].isNotNull() & _finite(p["x"]) & _finite(p["y"])
            & p["x"].between(-180, 180) & p["y"].between(-90, 90),
        ),
        F.lit(False),
    )


def geojson_points(kind: Column, coordinates: Column) -> Column:
    """Points of any of the six plain geometry types from GeoJSON text (FN-G03, AGG-25)."""
    nest = lambda depth: F.from_json(coordinates, "array<" * depth + "double" + ">" * depth)
    level = (
        F.when(kind == "Point", F.array(nest(1)))
        .when(kind.isin("MultiPoint", "LineString"), nest(2))
        .when(kind.isin("MultiLineString", "Polygon"), F.flatten(nest(3)))
        .when(kind == "MultiPolygon", F.flatten(F.flatten(nest(4))))
    )
    return _as_points(level)


# --- reprojection -----------------------------------------------------------------------

_SEMI_MAJOR = 6378137.0
# Inverse flattening of the two ellipsoids (NAD83 / WGS84 zones).
_INVERSE_FLATTENING = {"269": 298.257222101, "326": 298.257223563}


def epsg_of_crs_name(name: str | None) -> int | None:
    """The EPSG code at the end of a coordinate-system name, or None."""
    found = re.search(r"(?:^|:)EPSG:(?:.*:)?(\d+)$", name or "")
    return int(found.group(1)) if found else None


def utm_to_wgs84(epsg: int, x: Column, y: Column) -> Column:
    """FN-G05: struct of longitude x and latitude y for a northern UTM zone (269xx, 326xx).

    Krueger's inverse series to the fourth order of the third flattening: well below a
    millimetre inside a zone. The datum shift between the two families is taken as nil.
    """
    family, zone = str(epsg)[:3], int(str(epsg)[3:])
    if family not in _INVERSE_FLATTENING or not 1 <= zone <= 60:
        raise ValueError(f"EPSG:{epsg} is not a supported UTM zone")
    flattening = 1 / _INVERSE_FLATTENING[family]
    n = flattening / (2 - flattening)
    radius = _SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    ]
    delta = [
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
        56 * n**3 / 15 - 136 * n**4 / 35,
        4279 * n**4 / 630,
    ]
    xi = y / F.lit(0.9996 * radius)
    eta = (x - F.lit(500000.0)) / F.lit(0.9996 * radius)
    xi_true, eta_true = xi, eta
    for order, b in enumerate(beta, start=1):
        xi_true = xi_true - F.lit(b) * F.sin(2 * order * xi) * F.cosh(2 * order * eta)
        eta_true = eta_true - F.lit(b) * F.cos(2 * order * xi) * F.sinh(2 * order * eta)
    chi = F.asin(F.sin(xi_true) / F.cosh(eta_true))
    phi = chi
    for order, d in enumerate(delta, start=1):
        phi = phi + F.lit(d) * F.sin(2 * order * chi)
    lam = F.atan2(F.sinh(eta_true), F.cos(xi_true))
    meridian = zone * 6 - 183
    return F.struct((F.degrees(lam) + F.lit(float(meridian))).alias("x"), F.degrees(phi).alias("y"))


def reproject(geometry: Column, crs_name: str | None) -> Column:
    """FN-G05 over a multipolygon; no code or 4326 leaves it as it is."""
    epsg = epsg_of_crs_name(crs_name)
    if epsg in (None, 4326):
        return geometry
    return F.transform(
        geometry,
        lambda polygon: F.transform(
            polygon, lambda ring: F.transform(ring, lambda p: utm_to_wgs84(epsg, p["x"], p["y"]))
        ),
    )


# --- simplification ---------------------------------------------------------------------


def simplifier(tolerance: float = TOLERANCE):
    """FN-G06: Arrow function that thins every ring by itself; a ring that would collapse stays whole.

    ``operators.simplify`` keeps the borders that neighbours share.
    """
    @F.arrow_udf(MULTIPOLYGON)
    def simplify(geometries: pa.Array) -> pa.Array:
        return thinned(geometries, pa.array([[]] * len(geometries), pa.list_(pa.int64())), tolerance)

    return simplify


# --- edges ------------------------------------------------------------------------------


def edges(geometry: Column) -> Column:
    """All ring edges as flat structs, so that a test reads plain numbers."""
    def of(ring):
        steps = F.size(ring) - 1
        return F.zip_with(
            F.slice(ring, F.lit(1), steps), F.slice(ring, F.lit(2), steps),
            lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")),
        )

    return F.flatten(F.transform(F.flatten(geometry), of))
