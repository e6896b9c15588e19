"""Containment against cell sets: parents and children made of unit squares, turned and scaled."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from headwater.functions import geometry as G
from headwater.operators import containment

MULTI = "array<array<array<struct<x:double,y:double>>>>"


def place(x, y, turn, scale):
    return {"x": -120 + scale * (x * math.cos(turn) - y * math.sin(turn)), "y": 40 + scale * (x * math.sin(turn) + y * math.cos(turn))}


def ring(corners, turn, scale):
    return [place(x, y, turn, scale) for x, y in [*corners, corners[0]]]


def squares(cells, turn, scale):
    return [[ring([(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)], turn, scale)] for x, y in cells]


def box(x, y, w, h, turn, scale):
    return [ring([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], turn, scale)]


@pytest.mark.parametrize("bands", [containment.MOST_BANDS, 1])
def test_cells(spark, monkeypatch, bands):
    monkeypatch.setattr(containment, "MOST_BANDS", bands)
    pick, parents, children = random.Random(2), [], []
    for run, (turn, scale) in enumerate([(0, 1.0), (0.3, 1.0), (0.3, 1e-5), (1.1, 0.01), (math.pi / 4, 0.37)]):
        cells = {(x, y) for x in range(7) for y in range(7) if pick.random() < 0.85}
        parents.append((str(run), squares(sorted(cells), turn, scale)))
        for i in range(60):
            x, y, w, h = pick.randrange(-1, 7), pick.randrange(-1, 7), pick.randrange(1, 5), pick.randrange(1, 4)
            own = {(a, b) for a in range(x, x + w) for b in range(y, y + h)}
            shape = [box(x, y, w, h, turn, scale)]
            if i % 4 == 0:  # two parts
                shape.append(box(x, y + h + 1, 1, 1, turn, scale))
                own.add((x, y + h + 1))
            children.append((str(run), i, shape, own <= cells))
    found = containment.covered_children(
        spark.createDataFrame(parents, f"runid string, geometry {MULTI}"), spark.createDataFrame(children, f"runid string, child int, geometry {MULTI}, expected boolean"),
    ).collect()
    assert len(found) == len(children) and 40 < sum(r.expected for r in found) < 200
    assert [r for r in found if r.covered != r.expected] == []


HOLED = [[[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]], [[4, 4], [6, 4], [6, 6], [4, 6], [4, 4]]]


@pytest.mark.parametrize("child,inside", [
    ("[[[1,1],[2,1],[2,2],[1,2],[1,1]]]", True), ("[[[0,0],[3,0],[3,3],[0,3],[0,0]]]", True), ("[[[9,9],[11,9],[11,11],[9,11],[9,9]]]", False),
    ("[[[3,3],[7,3],[7,7],[3,7],[3,3]]]", False), ("[[[4.5,4.5],[5.5,4.5],[5.5,5.5],[4.5,5.5],[4.5,4.5]]]", False),
    ("[[[3,4.5],[7,4.5],[7,5.5],[3,5.5],[3,4.5]]]", False), ("[[[20,20],[21,20],[21,21],[20,20]]]", False),
    ("[[[3,3],[7,3],[7,7],[3,7],[3,3]],[[4,4],[6,4],[6,6],[4,6],[4,4]]]", True), ("[[[4,4],[6,4],[6,6],[4,6],[4,4]]]", False),
    ("[[[0,0],[10,0],[10,10],[0,10],[0,0]],[[4,4],[6,4],[6,6],[4,6],[4,4]]]", True), ("[[[1,1],[2,1],[1,1]]]", False), ("[[[1,1],[200,1],[1,2],[1,1]]]", False), (None, False),
])
def test_a_parent_with_a_hole(spark, child, inside):
    df = spark.createDataFrame([("r", str([HOLED]), child)], "runid string, p string, c string")
    parents = df.select("runid", G.multipolygon(F.lit("MultiPolygon"), F.col("p")).alias("geometry"))
    children = df.select("runid", G.multipolygon(F.lit("Polygon"), F.col("c")).alias("geometry"))
    assert [r.covered for r in containment.covered_children(parents, children).collect()] == [inside]
    assert [r.covered for r in containment.covered_children(parents.limit(0), children).collect()] == [False]


def test_a_large_run_is_spread(spark):
    """The children of one run meet its edges by band: no task sees them all."""
    turn = [2 * math.pi * i / 400 for i in range(400)]
    disc = [[ring([(10 * math.cos(a), 10 * math.sin(a)) for a in turn], 0, 0.1)]]
    pick = np.random.default_rng(1)
    at = pick.uniform(-10, 10, (3000, 2))
    children = [("r", i, [box(x, y, 0.01, 0.01, 0, 0.1)], bool(np.hypot(abs(x) + 0.01, abs(y) + 0.01) < 9.99)) for i, (x, y) in enumerate(at.tolist())]
    parents = spark.createDataFrame([("r", disc)], f"runid string, geometry {MULTI}")
    table = spark.createDataFrame(children, f"runid string, child int, geometry {MULTI}, surely boolean")
    found = containment.covered_children(parents, table)
    assert found.where("surely AND NOT covered").isEmpty()
    assert abs(found.where("covered").count() - 3000 * math.pi / 4) < 120
    _, edges = containment.parent_frames(parents)
    assert edges.groupBy("_band").count().agg(F.max("count")).first()[0] < 40 and edges.select("_band").distinct().count() == 100


def test_units_are_judged_together_as_one_by_one():
    rng = np.random.default_rng(5)
    near, ring = [], []
    for _ in range(300):
        n = int(rng.integers(3, 9))
        corners = rng.integers(0, 5, (n, 2)).astype(float)
        ring.append(np.hstack([corners, np.roll(corners, -1, axis=0)]))
        near.append(rng.integers(0, 5, (int(rng.integers(1, 6)), 4)).astype(float))
    alone = [containment.enters(a, b) if (np.hypot(*(b[:, 2:] - b[:, :2]).T) > 0).any() else False for a, b in zip(near, ring)]
    assert containment.enter(near, ring).tolist() == alone and 30 < sum(alone) < 290


def test_parts_of_odd_geometries():
    kind = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
    ring = lambda *ps: [None if p is None else {"x": p[0], "y": p[1]} for p in ps]
    square = [ring((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))]
    holed = [square[0], ring((0.5, 0.5), (0.5, 1), (1, 1), (1, 0.5), (0.5, 0.5))]
    rows = [
        [square, [], holed], None, [], [[]], [square, None], [[None]], [[ring((0, 0), None, (1, 1))]], [[ring((0, 0), (1, float("nan")))]],
        [[ring((0, 0), (200, 0), (1, 1), (0, 0))]], [[ring((0, 1), (2, 1), (0, 1))]], [[ring((3, 4))]],
    ]
    got = containment.parts_of(pa.array(rows, kind)).to_pylist()
    assert [(p["_part"], p["_of"], p["minx"], p["maxy"], p["px"], p["py"]) for p in got[0]] == [(0, 2, 0, 2, 1, 1), (2, 2, 0, 2, 1, 0.25)]
    assert got[1:9] == [[]] * 8 and [(p["px"], p["minx"]) for r in got[9:] for p in r] == [(None, 0), (None, 3)]
    assert containment.parts_of(pa.array(rows, kind)[2:9]).to_pylist() == [[]] * 7
