"""JN-16: which children their parent's geometry covers, by an equi-join over bands.

The interior of a polygon is in one piece. If no edge of the parent enters it, it lies wholly inside the parent
or wholly outside, and one interior point tells which. So a child is covered when (a) the even-odd count of each
of its polygons' interior points is odd and (b) no parent edge enters the interior of any of them. Holes, notches,
concave parents and shared borders need no rules of their own.

A parent is cut into horizontal bands, more of them the more edges it has. Edges are dealt to the bands they
reach, polygons to those of their box, and the two meet on (run, band): a point sees the edges of its band, not all
of its parent's, and the children of a large run are spread over its bands. Counts are summed per polygon. Only
polygons whose box an edge reaches into are looked at with all their points.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.functions import geometry as G
from headwater.session import checkpoint

TOLERANCE = 1e-11  # degrees, a micrometre: what reaches no deeper than this touches the border
EDGES_PER_BAND, MOST_BANDS = 4, 512
TOGETHER = 500_000  # pairs of numbers compared at once, at most twice as many
_SIDES = ["minx", "miny", "maxx", "maxy"]
_ENDS = ["ax", "ay", "bx", "by"]  # named as in geometry.edges


def parts_of(geometry: pa.Array) -> pa.Array:
    """Per multipolygon a row for each polygon with points: its number, how many there are, its box and a point inside.

    The point lies halfway between the first two crossings of a level between the two lowest vertices; it is null for a
    polygon without area on that level. A geometry without points, or with coordinates that are missing, not
    finite or outside the world limits, has no rows.
    """
    lengths = lambda lists: pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    numbers = lambda counts: np.repeat(np.arange(len(counts)), counts)
    nulls = lambda values: values.is_null().to_numpy(zero_copy_only=False)
    polygons = geometry.flatten()
    rings = polygons.flatten()
    points = rings.flatten()
    x, y = (pc.cast(pc.struct_field(points, axis), pa.float64()).to_numpy(zero_copy_only=False) for axis in "xy")
    row_of_polygon, polygon_of_ring, ring_of_point = numbers(lengths(geometry)), numbers(lengths(polygons)), numbers(lengths(rings))
    polygon_of_point = polygon_of_ring[ring_of_point]
    bad = np.zeros(len(geometry), bool)
    bad[row_of_polygon[nulls(polygons)]] = True
    bad[row_of_polygon[polygon_of_ring[nulls(rings)]]] = True
    bad[row_of_polygon[polygon_of_point[~((np.abs(x) <= 180) & (np.abs(y) <= 90))]]] = True
    sizes = np.bincount(polygon_of_point, minlength=len(polygons))
    kept = np.flatnonzero((sizes > 0) & ~bad[row_of_polygon])
    low = lambda values, at, of: np.minimum.reduceat(values[at], np.flatnonzero(np.append(True, np.diff(of[at]) != 0))) if len(at) else values[at]
    inside = np.flatnonzero(~bad[row_of_polygon[polygon_of_point]])
    box = [low(x, inside, polygon_of_point), low(y, inside, polygon_of_point), -low(-x, inside, polygon_of_point), -low(-y, inside, polygon_of_point)]

    first = inside[np.append(ring_of_point[1:] == ring_of_point[:-1], False)[inside]] if len(inside) else inside
    of = polygon_of_point[first]  # ascending, as all numbers here
    level = np.full(len(polygons), np.nan)
    if len(first):
        lowest = np.full(len(polygons), np.inf)
        np.minimum.at(lowest, of, y[first])
        higher, second = y[first] > lowest[of], np.full(len(polygons), np.inf)
        np.minimum.at(second, of[higher], y[first][higher])
        level = np.where(np.isfinite(second), (lowest + second) / 2, np.nan)
    known = np.isfinite(level[of])
    first, of = first[known], of[known]
    spans = (y[first] > level[of]) != (y[first + 1] > level[of])
    first, of = first[spans], of[spans]
    crossing = x[first] + (level[of] - y[first]) * (x[first + 1] - x[first]) / (y[first + 1] - y[first])
    order = np.lexsort((crossing, of))
    crossing, of = crossing[order], of[order]
    one = np.flatnonzero((np.append(True, np.diff(of) != 0) if len(of) else np.zeros(0, bool)) & np.append(of[1:] == of[:-1], False)[: len(of)])
    middle = np.full(len(polygons), np.nan)
    middle[of[one]] = (crossing[one] + crossing[one + 1]) / 2

    rows = row_of_polygon[kept]
    counts = np.bincount(rows, minlength=len(geometry))
    starts = np.append(0, np.cumsum(lengths(geometry)))
    maybe = lambda values: pa.array(values, pa.float64(), mask=np.isnan(values))
    fields = {
        "_part": pa.array(kept - starts[rows], pa.int32()), "_of": pa.array(counts[rows], pa.int32()),
        **{side: pa.array(values, pa.float64()) for side, values in zip(_SIDES, box)}, "px": maybe(middle[kept]), "py": maybe(level[kept]),
    }
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def _parts(geometry: Column) -> Column:
    sides = ", ".join(f"{name}: double" for name in [*_SIDES, "px", "py"])

    @F.arrow_udf(f"array<struct<_part: int, _of: int, {sides}>>")
    def parts(geometries: pa.Array) -> pa.Array:
        return parts_of(geometries)

    return parts(geometry)


def _digest(geometry: Column) -> list[Column]:
    """128 bits of a geometry: whether it is covered depends on nothing else of a child."""
    return [F.xxhash64(geometry).alias("_h1"), F.xxhash64(F.lit(7), geometry).alias("_h2")]


def _bands(low: Column, high: Column) -> Column:
    """The bands from one height to another, within those of the parent."""
    number = lambda y: F.greatest(F.lit(0), F.least(F.col("_bands") - 1, F.floor((y - F.col("_low")) / F.col("_height")).cast("int")))
    return F.sequence(number(low), number(high))


def parent_frames(parents: DataFrame, run: str = "runid") -> tuple[DataFrame, DataFrame]:
    """(run, box, bands) of each parent, and its edges by (run, band). Parents without points have neither.

    An edge that two polygons of a parent share is inside it: edges that occur an even number of times go.
    """
    cut = parents.select(F.col(run).alias("_run"), G.bbox(F.col("geometry")).alias("_box"), G.edges(F.col("geometry")).alias("_edges")).where("_box IS NOT NULL")
    bands = F.greatest(F.lit(1), F.least(F.lit(MOST_BANDS), F.ceil(F.size("_edges") / EDGES_PER_BAND).cast("int")))
    tall = F.col("_box.maxy") - F.col("_box.miny")
    framed = cut.select(
        "_run", "_box", "_edges", bands.alias("_bands"), F.col("_box.miny").alias("_low"),
        F.when(tall > 0, tall / bands).otherwise(F.lit(1.0)).alias("_height"),
    )
    one, other = F.struct(F.col("_e.ax").alias("x"), F.col("_e.ay").alias("y")), F.struct(F.col("_e.bx").alias("x"), F.col("_e.by").alias("y"))
    single = framed.select("_run", "_bands", "_low", "_height", F.explode("_edges").alias("_e")).select(
        "_run", "_bands", "_low", "_height", F.least(one, other).alias("_a"), F.greatest(one, other).alias("_b")
    ).groupBy("_run", "_bands", "_low", "_height", "_a", "_b").agg(F.count(F.lit(1)).alias("_times")).where("_times % 2 = 1")
    edges = single.select(
        "_run", F.explode(_bands(F.least("_a.y", "_b.y"), F.greatest("_a.y", "_b.y"))).alias("_band"),
        *[F.col(f"_{end}.{axis}").alias(end + axis) for end in "ab" for axis in "xy"],
    )
    return framed.drop("_edges"), edges


def _met(units: DataFrame, edges: DataFrame) -> DataFrame:
    """Each unit beside the parent edges of its bands; ``_near`` where the edge reaches into the unit's box."""
    dealt = units.withColumn("_band", F.explode(_bands(F.col("miny"), F.col("maxy"))))
    low, high = lambda a, b: F.least(a, b), lambda a, b: F.greatest(a, b)
    near = (
        (high("ax", "bx") > F.col("minx") + TOLERANCE) & (low("ax", "bx") < F.col("maxx") - TOLERANCE)
        & (high("ay", "by") > F.col("miny") + TOLERANCE) & (low("ay", "by") < F.col("maxy") - TOLERANCE)
    )
    return dealt.join(edges, ["_run", "_band"]).withColumn("_near", near)


def _crosses() -> Column:
    """Whether the ray to the right of the interior point crosses the edge; asked in the point's own band."""
    x, y = F.col("px"), F.col("py")
    spans = (F.col("ay") > y) != (F.col("by") > y)
    left, right = (x - F.col("ax")) * (F.col("by") - F.col("ay")), (y - F.col("ay")) * (F.col("bx") - F.col("ax"))
    return (F.col("_band") == F.get(_bands(y, y), 0)) & spans & F.when(F.col("by") > F.col("ay"), left < right).otherwise(left > right)


def enters(near: np.ndarray, ring: np.ndarray) -> bool:
    """Whether an edge (rows ax, ay, bx, by) of ``near`` has a point deeper inside the rings ``ring`` than the tolerance.

    An edge is cut where it meets the rings, and where ring points lie on it; the middle of each part tells.
    """
    c, s = ring[:, :2], ring[:, 2:] - ring[:, :2]
    length = np.hypot(*s.T)
    c, s, length = c[length > 0], s[length > 0], length[length > 0]
    for edge in near:
        a, r = edge[:2], edge[2:] - edge[:2]
        span = np.hypot(*r)
        if span == 0:
            continue
        to = c - a
        aside = (to[:, 0] * r[1] - to[:, 1] * r[0]) / span
        turned = r[0] * s[:, 1] - r[1] * s[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (to[:, 0] * s[:, 1] - to[:, 1] * s[:, 0]) / turned
        on = np.abs(aside) <= TOLERANCE
        cuts = np.concatenate([[0.0, 1.0], t[np.isfinite(t)], (to[on] @ r) / span**2])
        cuts = np.unique(cuts[(cuts >= 0) & (cuts <= 1)])
        middles = a + (cuts[1:] + cuts[:-1])[:, None] / 2 * r
        for p in middles:
            d = p - c
            along = np.clip((d * s).sum(axis=1) / length**2, 0, 1)
            if np.hypot(*(d - along[:, None] * s).T).min() <= TOLERANCE:
                continue
            spans = (c[:, 1] > p[1]) != (c[:, 1] + s[:, 1] > p[1])
            if (p[0] < c[spans, 0] + (p[1] - c[spans, 1]) * s[spans, 0] / s[spans, 1]).sum() % 2:
                return True
    return False


def _dealt(of: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (number in ``of``, row) of each entry with all rows of the group it names."""
    counts = sizes[of]
    left = np.repeat(np.arange(len(of)), counts)
    return left, np.arange(len(left)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[of][left]


def _enters_together(near: list[np.ndarray], ring: list[np.ndarray]) -> np.ndarray:
    """``enters`` for several units at once, in the same steps."""
    found = np.zeros(len(near), bool)
    e_of, c_of = (np.repeat(np.arange(len(near)), [len(a) for a in side]) for side in (near, ring))
    e, c = np.concatenate(near), np.concatenate(ring)
    c, s = c[:, :2], c[:, 2:] - c[:, :2]
    a, r = e[:, :2], e[:, 2:] - e[:, :2]
    length, span = np.hypot(*s.T), np.hypot(*r.T)
    c, s, c_of, length = c[length > 0], s[length > 0], c_of[length > 0], length[length > 0]
    sizes = np.bincount(c_of, minlength=len(near))
    starts = np.cumsum(sizes) - sizes
    used = (span > 0) & (sizes[e_of] > 0)
    a, r, e_of, span = a[used], r[used], e_of[used], span[used]
    if not len(a):
        return found
    i, j = _dealt(e_of, sizes, starts)
    to = c[j] - a[i]
    aside = (to[:, 0] * r[i, 1] - to[:, 1] * r[i, 0]) / span[i]
    turned = r[i, 0] * s[j, 1] - r[i, 1] * s[j, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (to[:, 0] * s[j, 1] - to[:, 1] * s[j, 0]) / turned
    on = np.abs(aside) <= TOLERANCE
    every = np.arange(len(a))
    cuts = np.concatenate([np.zeros(len(a)), np.ones(len(a)), t, ((to * r[i]).sum(axis=1) / span[i] ** 2)[on]])
    whose = np.concatenate([every, every, i, i[on]])
    good = np.isfinite(cuts) & (cuts >= 0) & (cuts <= 1)
    cuts, whose = cuts[good], whose[good]
    order = np.lexsort((cuts, whose))
    cuts, whose = cuts[order], whose[order]
    parts = np.flatnonzero((whose[1:] == whose[:-1]) & (cuts[1:] > cuts[:-1]))
    edge = whose[parts]
    p = a[edge] + (cuts[parts + 1] + cuts[parts])[:, None] / 2 * r[edge]
    m, j = _dealt(e_of[edge], sizes, starts)
    d = p[m] - c[j]
    along = np.clip((d * s[j]).sum(axis=1) / length[j] ** 2, 0, 1)
    firsts = np.flatnonzero(np.append(True, np.diff(m) != 0))
    away = np.minimum.reduceat(np.hypot(*(d - along[:, None] * s[j]).T), firsts)
    spans = (c[j, 1] > p[m, 1]) != (c[j, 1] + s[j, 1] > p[m, 1])
    with np.errstate(divide="ignore", invalid="ignore"):
        left = spans & (p[m, 0] < c[j, 0] + (p[m, 1] - c[j, 1]) * s[j, 0] / s[j, 1])
    odd = np.add.reduceat(left.astype(np.int64), firsts) % 2 == 1
    found[e_of[edge[(away > TOLERANCE) & odd]]] = True
    return found


def enter(near: list[np.ndarray], ring: list[np.ndarray]) -> np.ndarray:
    """``enters`` of each unit, taken together up to ``TOGETHER`` numbers at once; a larger unit goes edge by edge."""
    work = np.array([len(a) * (2 * len(b) + 1) * len(b) for a, b in zip(near, ring)], np.int64)
    found = np.zeros(len(near), bool)
    small = np.flatnonzero(work <= TOGETHER)
    for unit in np.flatnonzero(work > TOGETHER):
        found[unit] = enters(near[unit], ring[unit])
    for units in np.split(small, np.flatnonzero(np.diff(np.cumsum(work[small]) // TOGETHER)) + 1):
        if len(units):
            found[units] = _enters_together([near[u] for u in units], [ring[u] for u in units])
    return found


def _entered():
    @F.pandas_udf("boolean")
    def entered(near: pd.Series, ring: pd.Series) -> pd.Series:
        rows = lambda side: [np.asarray(a, float).reshape(-1, 4) for a in side]
        return pd.Series(enter(rows(near), rows(ring)), dtype=bool)

    return entered


def _flat(edges: Column) -> Column:
    return F.flatten(F.transform(edges, lambda e: F.array(*[e[c] for c in _ENDS])))


def covered_children(parents: DataFrame, children: DataFrame, run: str = "runid") -> DataFrame:
    """``children`` (run, geometry, other columns) without the geometry, with ``covered``.

    One parent (run, geometry) per run. A child without points, with coordinates outside the world limits or
    without a parent is not covered. Touching the parent's border from within is covered.
    """
    frames, edges = parent_frames(parents, run)
    marked = children.withColumns({"_run": F.col(run), "_h1": _digest(F.col("geometry"))[0], "_h2": _digest(F.col("geometry"))[1]})
    key = ["_run", "_h1", "_h2"]
    unit = [*key, "_part"]
    measured = marked.select(*key, _parts(F.col("geometry")).alias("_parts")).select(*key, F.explode("_parts").alias("_p"))
    units = measured.select(*key, "_p.*").distinct()
    # Frames are a row per run and not repeated; where they are too many to send to all tasks, Spark splits a hot run.
    framed = units.join(frames, "_run")
    inside = (
        (F.col("_box.minx") <= F.col("minx") + TOLERANCE) & (F.col("_box.miny") <= F.col("miny") + TOLERANCE)
        & (F.col("_box.maxx") >= F.col("maxx") - TOLERANCE) & (F.col("_box.maxy") >= F.col("maxy") - TOLERANCE)
    )
    fitting = framed.where(inside).drop("_box")
    # What is asked of a unit later is carried along, so that children are measured once.
    place = ["_of", *_SIDES, "_bands", "_low", "_height"]
    counted = checkpoint(_met(fitting, edges).groupBy(*unit, *place).agg(
        (F.count_if(_crosses()) % 2 == 1).alias("_in"), F.max("_near").alias("_asked")
    ).where("_in"))
    # The few polygons that a parent edge reaches into, with all their points.
    asked = counted.where("_asked")
    edge = F.struct(*_ENDS)
    near = _met(asked.select(*unit, *place), edges).where("_near").groupBy(*unit).agg(F.collect_set(edge).alias("_edges"))
    wide = marked.select(*key, "geometry").join(asked.select(*key).distinct(), key, "left_semi")
    parts = wide.select(*key, F.posexplode("geometry").alias("_part", "_polygon")).join(asked.select(*unit), unit, "left_semi")
    shapes = parts.select(*unit, _flat(G.edges(F.array(F.col("_polygon")))).alias("_ring")).dropDuplicates(unit)
    bad = near.join(shapes, unit).where(_entered()(_flat(F.col("_edges")), F.col("_ring"))).select(*unit)
    good = counted.join(bad, unit, "left_anti").groupBy(*key, "_of").agg(F.count(F.lit(1)).alias("_good")).where("_good = _of")
    narrow = marked.drop("geometry")
    return narrow.join(good.select(*key, F.lit(True).alias("covered")), key, "left").withColumn("covered", F.coalesce("covered", F.lit(False))).drop(*key)
