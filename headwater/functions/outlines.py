"""Outlines thinned arc by arc, on Arrow arrays: the numbers under FN-G06."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOLERANCE = 0.00025
LEAST_POINTS = 4  # of a ring, its closing point included


def kept_on_arc(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of an open arc stay: both ends, and those farther from the chord of their neighbours that stay."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    spans = [(0, len(points) - 1)]
    while spans:
        first, last = spans.pop()
        if last - first < 2:
            continue
        base, inner = points[last] - points[first], points[first + 1 : last] - points[first]
        length = math.hypot(*base)
        away = np.abs(base[0] * inner[:, 1] - base[1] * inner[:, 0]) / length if length else np.hypot(inner[:, 0], inner[:, 1])
        worst = int(np.argmax(away))
        if away[worst] > tolerance:
            middle = first + 1 + worst
            keep[middle] = True
            spans += [(first, middle), (middle, last)]
    return keep


def _kept_in_order(points: np.ndarray, tolerance: float) -> np.ndarray:
    """``kept_on_arc`` from the end that comes first by coordinates, so that both directions keep the same points."""
    backwards = points[::-1]
    other = np.flatnonzero((points != backwards).any(axis=1))
    if len(other) and tuple(points[other[0]]) > tuple(backwards[other[0]]):
        return kept_on_arc(backwards, tolerance)[::-1]
    return kept_on_arc(points, tolerance)


def kept_on_ring(ring: np.ndarray, junctions: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of a closed ring stay; ``junctions`` marks its points where borders meet.

    A ring without junctions is cut at its least point and the one farthest from there. A ring that would
    collapse stays whole.
    """
    n = len(ring) - 1
    if n < LEAST_POINTS - 1:
        return np.ones(len(ring), bool)
    cuts = np.flatnonzero(junctions[:n])
    if len(cuts) < 2:
        start = int(cuts[0]) if len(cuts) else int(np.lexsort((ring[:n, 1], ring[:n, 0]))[0])
        far = int(np.argmax(((ring[:n] - ring[start]) ** 2).sum(axis=1)))
        cuts = np.unique([start, far])
    keep = np.zeros(n, bool)
    for a, b in zip(cuts, np.append(cuts[1:], cuts[0] + n)):
        places = np.arange(a, b + 1) % n
        keep[places] |= _kept_in_order(ring[places], tolerance)
    if keep.sum() < LEAST_POINTS - 1:
        return np.ones(len(ring), bool)
    return np.append(keep, keep[0])


def _nested(values: pa.Array, lists: list[pa.Array]) -> pa.Array:
    """``values`` put into lists again, innermost first; each list gives its lengths and nulls."""
    for one in reversed(lists):
        lengths = pc.fill_null(pc.list_value_length(one), 0).to_numpy(zero_copy_only=False)
        offsets = pa.array(np.append(0, np.cumsum(lengths)), pa.int32())
        values = pa.ListArray.from_arrays(offsets, values, type=one.type, mask=one.is_null() if one.null_count else None)
    return values


def thinned(geometry: pa.Array, junctions: pa.Array, tolerance: float) -> pa.Array:
    """Multipolygons with the points that stay. ``junctions`` lists, per row, numbers of points in its flat order."""
    polygons = geometry.flatten()
    rings = polygons.flatten()
    points = rings.flatten()
    at = np.stack([points.field("x").to_numpy(zero_copy_only=False), points.field("y").to_numpy(zero_copy_only=False)], axis=1)
    sizes = pc.fill_null(pc.list_value_length(rings), 0).to_numpy(zero_copy_only=False)
    ring_ends = np.append(0, np.cumsum(sizes))
    in_polygon = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(polygons), 0).to_numpy(zero_copy_only=False)))
    in_row = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(geometry), 0).to_numpy(zero_copy_only=False)))
    first_point = ring_ends[in_polygon[in_row[:-1]]]
    marked = np.zeros(len(at), bool)
    counts = pc.fill_null(pc.list_value_length(junctions), 0).to_numpy(zero_copy_only=False)
    marked[np.repeat(first_point, counts) + junctions.flatten().to_numpy(zero_copy_only=False)] = True
    keep = np.ones(len(at), bool)
    for a, b in zip(ring_ends[:-1], ring_ends[1:]):
        if b > a:
            keep[a:b] = kept_on_ring(at[a:b], marked[a:b], tolerance)
    total = np.append(0, np.cumsum(keep))[ring_ends]
    shorter = pa.ListArray.from_arrays(pa.array(total, pa.int32()), points.filter(pa.array(keep)), type=rings.type)
    return _nested(shorter, [geometry, polygons])
