"""Colour tables, built once on the driver (256 shades each), and lookups as expressions."""

from __future__ import annotations

import colorsys
from bisect import bisect_right
from math import floor

from pyspark.sql import Column
from pyspark.sql import functions as F

SHADES = 256

# Browser colour scales as (position, red, green, blue) stops.
SCALES = {
    "jet": [(0, 0, 0, 131), (0.125, 0, 60, 170), (0.375, 5, 255, 255), (0.625, 255, 255, 0),
            (0.875, 250, 0, 0), (1, 128, 0, 0)],
    "jet2": [(0, 5, 255, 255), (0.4, 255, 255, 0), (0.8, 250, 0, 0), (1, 128, 0, 0)],
    "viridis": [(0, 68, 1, 84), (0.13, 71, 44, 122), (0.25, 59, 81, 139), (0.38, 44, 113, 142),
                (0.5, 33, 144, 141), (0.63, 39, 173, 129), (0.75, 92, 200, 99),
                (0.88, 170, 220, 50), (1, 253, 231, 37)],
    "inferno": [(0, 0, 0, 4), (0.13, 31, 12, 72), (0.25, 85, 15, 109), (0.38, 136, 34, 106),
                (0.5, 186, 54, 85), (0.63, 227, 89, 51), (0.75, 249, 140, 10),
                (0.88, 249, 201, 50), (1, 252, 255, 164)],
    "plasma": [(0, 13, 8, 135), (0.13, 75, 3, 161), (0.25, 125, 3, 168), (0.38, 168, 34, 150),
               (0.5, 203, 70, 121), (0.63, 229, 107, 93), (0.75, 248, 148, 65),
               (0.88, 253, 195, 40), (1, 240, 249, 33)],
    "winter": [(0, 0, 0, 255), (1, 0, 255, 128)],
    "greens": [(0, 0, 68, 27), (0.125, 0, 109, 44), (0.25, 35, 139, 69), (0.375, 65, 171, 93),
               (0.5, 116, 196, 118), (0.625, 161, 217, 155), (0.75, 199, 233, 192),
               (0.875, 229, 245, 224), (1, 247, 252, 245)],
    "rdbu": [(0, 5, 10, 172), (0.35, 106, 137, 247), (0.5, 190, 190, 190), (0.6, 220, 170, 132),
             (0.7, 230, 145, 90), (1, 178, 10, 28)],
    "hot": [(0, 0, 0, 0), (0.3, 230, 0, 0), (0.6, 255, 210, 0), (1, 255, 255, 255)],
    "cool": [(0, 0, 255, 255), (1, 255, 0, 255)],
    "rainbow": [(0, 150, 0, 90), (0.125, 0, 0, 200), (0.25, 0, 25, 255), (0.375, 0, 152, 255),
                (0.5, 44, 255, 150), (0.625, 151, 255, 0), (0.75, 255, 234, 0),
                (0.875, 255, 111, 0), (1, 255, 0, 0)],
    "greys": [(0, 0, 0, 0), (1, 255, 255, 255)],
    "bluered": [(0, 0, 0, 255), (1, 255, 0, 0)],
    "et-green": [(0, 139, 90, 43), (0.25, 210, 180, 140), (0.5, 255, 255, 200),
                 (0.75, 144, 238, 144), (1, 34, 139, 34)],
    "et-blue": [(0, 255, 247, 236), (0.25, 254, 232, 200), (0.5, 127, 205, 187),
                (0.75, 65, 182, 196), (1, 8, 104, 172)],
}

# Anchors of the two map-output scales.
SEQUENTIAL = [(0.0, 68, 1, 84), (0.25, 59, 82, 139), (0.5, 33, 145, 140),
              (0.75, 94, 201, 98), (1.0, 253, 231, 37)]
DIVERGING = [(0.0, 33, 102, 172), (0.25, 103, 169, 207), (0.5, 247, 247, 247),
             (0.75, 239, 138, 98), (1.0, 178, 24, 43)]

# Ten class colours, cycled; the stream colour.
CATEGORICAL = [(31, 119, 180), (255, 127, 14), (44, 160, 44), (214, 39, 40), (148, 103, 189),
               (140, 86, 75), (227, 119, 194), (127, 127, 127), (188, 189, 34), (23, 190, 207)]
STREAM = (0, 255, 255, 255)

# Burn severity classes, pixel code 0..3 in this order, in two palettes.
BURN_CLASSES = [(130, "Unburned"), (131, "Low"), (132, "Moderate"), (133, "High")]
BURN_PALETTES = {
    "legacy": [(0, 115, 74), (77, 230, 0), (255, 255, 0), (255, 0, 0)],
    "shift": [(0, 158, 115), (86, 180, 233), (240, 228, 66), (204, 121, 167)],
}


def shade_table(scale: str) -> list[str]:
    """Hex shades of a browser scale: linear between knots, halves rounded up."""
    stops = SCALES[scale.lower()]
    top = SHADES - 1
    knots = [floor(stop[0] * top + 0.5) for stop in stops]

    def shade(step: int) -> str:
        left = min(bisect_right(knots, step) - 1, len(knots) - 2)
        t = (step - knots[left]) / (knots[left + 1] - knots[left])
        pairs = zip(stops[left][1:], stops[left + 1][1:])
        return "#" + "".join(f"{floor(a * (1 - t) + b * t + 0.5):02x}" for a, b in pairs)

    return [shade(step) for step in range(SHADES)]


def anchor_colour(anchors: list[tuple], t: float) -> tuple[int, int, int]:
    """Colour at 0..1 between anchors; halves go to the even neighbour."""
    right = next(i for i, anchor in enumerate(anchors) if i and t <= anchor[0])
    low, high = anchors[right - 1], anchors[right]
    part = (t - low[0]) / (high[0] - low[0])
    return tuple(round(a + part * (b - a)) for a, b in zip(low[1:], high[1:]))


def rainbow_colour(t: float) -> tuple[int, int, int]:
    """Pure hues from blue at 0 to red at 1."""
    return tuple(round(part * 255) for part in colorsys.hls_to_rgb((1 - t) * 240 / 360, 0.5, 1.0))


def hex_upper(rgb: tuple[int, ...]) -> str:
    return "#" + "".join(f"{part:02X}" for part in rgb[:3])


def map_table(kind: str) -> list[str]:
    """256 hex shades of a map-output scale: sequential, diverging, rainbow, rainbow-reversed."""
    steps = [i / (SHADES - 1) for i in range(SHADES)]
    if kind == "sequential":
        return [hex_upper(anchor_colour(SEQUENTIAL, t)) for t in steps]
    if kind == "diverging":
        return [hex_upper(anchor_colour(DIVERGING, t)) for t in steps]
    if kind == "rainbow":
        return [hex_upper(rainbow_colour(t)) for t in steps]
    if kind == "rainbow-reversed":
        return [hex_upper(rainbow_colour(1 - t)) for t in steps]
    raise ValueError(f"unknown map scale {kind!r}")


def legend_colours(kind: str, stops: int = 5) -> list[str]:
    """Hex colours at evenly spaced places of a map-output scale."""
    places = [i / (stops - 1) if stops > 1 else 0.5 for i in range(stops)]
    pick = {
        "sequential": lambda t: anchor_colour(SEQUENTIAL, t),
        "diverging": lambda t: anchor_colour(DIVERGING, t),
        "rainbow": rainbow_colour,
        "rainbow-reversed": lambda t: rainbow_colour(1 - t),
    }[kind]
    return [hex_upper(pick(t)) for t in places]


def _pick(table: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(shade) for shade in table]), index.cast("int") + 1)


def colour_of(position: Column, scale: str = "viridis") -> Column:
    """FN-N02: shade at ``floor(255 * clamp(v))`` of a browser scale."""
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), position))
    return _pick(shade_table(scale), F.floor(clamped * (SHADES - 1)))


def map_colour_of(level: Column, kind: str) -> Column:
    """RST-02: shade of a level already rescaled to 0..255."""
    return _pick(map_table(kind), F.least(F.lit(255), F.greatest(F.lit(0), F.floor(level))))


def categorical_colour_of(position: Column) -> Column:
    """FN-N04: the palette cycled by 0-based position."""
    return _pick([hex_upper(rgb) for rgb in CATEGORICAL], F.pmod(position, F.lit(len(CATEGORICAL))))
