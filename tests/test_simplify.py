"""Simplified meshes: borders stay shared, junctions stay, everything near them goes."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from headwater.functions import geometry as G
from headwater.operators import simplify

MULTI = "array<array<array<struct<x:double,y:double>>>>"


def borders(pick, rows, columns, bends):
    """Points inside the border of each two neighbouring corners, told by the corners."""
    out = {}
    for r in range(rows + 1):
        for c in range(columns + 1):
            for to in ((r, c + 1), (r + 1, c)):
                (dy, dx), steps = (to[0] - r, to[1] - c), sorted(pick.random() for _ in range(bends))
                out[(r, c), to] = [(c + dx * s + dy * pick.gauss(0, 0.01), r + dy * s + dx * pick.gauss(0, 0.01)) for s in steps]
    return out


def cell(lines, r, c):
    corners = [(r, c), (r, c + 1), (r + 1, c + 1), (r + 1, c)]
    ring = []
    for a, b in zip(corners, corners[1:] + corners[:1]):
        ring.append((float(a[1]), float(a[0])))
        ring += lines[a, b] if (a, b) in lines else lines[b, a][::-1]
    return ring


def edges(rows):
    found = Counter()
    for _, geometry in rows:
        for polygon in geometry:
            for ring in polygon:
                points = [(p["x"], p["y"]) for p in ring]
                found.update(tuple(sorted(e)) for e in zip(points, points[1:]))
    return found


def test_neighbours_neither_part_nor_overlap(spark):
    pick = random.Random(3)
    lines = borders(pick, 6, 7, 20)
    cells = {}
    for r in range(6):
        for c in range(7):
            ring = cell(lines, r, c)
            turn = pick.randrange(len(ring))  # a ring may begin anywhere, and run either way
            ring = ring[turn:] + ring[:turn]
            ring = ring[::-1] if pick.random() < 0.5 else ring
            cells[r, c] = [[[{"x": x, "y": y} for x, y in [*ring, ring[0]]]]]
    df = spark.createDataFrame([("m", f"{k}", g) for k, g in cells.items()], f"mesh string, k string, geometry {MULTI}").repartition(5)
    out = simplify.simplified_mesh(df, ["mesh"], ["k"], 0.02)
    assert out.schema == df.schema
    rows = [(r.k, r.geometry) for r in out.collect()]
    before, after = edges([(k, g) for k, g in cells.items()]), edges(rows)
    outer = lambda found: sum(1 for n in found.values() if n == 1)
    assert sum(after.values()) < sum(before.values()) / 3 and set(after.values()) == {1, 2}
    rim = 2 * (6 + 7)
    assert outer(before) == rim * 21 and rim <= outer(after) < rim * 12  # only the rim is single: no border has parted
    areas = {r.k: r.a for r in out.select("k", G.area(F.col("geometry")).alias("a")).collect()}
    whole = np.array([(p["x"], p["y"]) for p in cells[0, 0][0][0]])
    assert all(abs(a - 1) < 0.1 for a in areas.values()) and len(whole) == 85
    corners = {(float(c), float(r)) for r in range(7) for c in range(8)}
    assert corners <= {p for e in after for p in e}


def test_a_ring_alone(spark):
    turn = [2 * math.pi * i / 200 for i in range(200)]
    disc = [[[{"x": math.cos(a), "y": math.sin(a)} for a in [*turn, 0.0]]]]
    tiny = [[[{"x": x, "y": y} for x, y in ((0.0, 0.0), (1e-6, 0.0), (1e-6, 1e-6), (0.0, 0.0))]]]
    holed = [disc[0] + [[{"x": p["x"] / 2, "y": p["y"] / 2} for p in disc[0][0]]], tiny[0]]
    rows = [(1, disc), (2, tiny), (3, None), (4, []), (5, holed), (6, [[]])]
    df = spark.createDataFrame([(k, k, g) for k, g in rows], f"mesh int, k int, geometry {MULTI}").coalesce(1)
    got = {r.k: r.geometry for r in simplify.simplified_mesh(df, ["mesh"], ["k"], 0.01).collect()}
    assert 8 < len(got[1][0][0]) < 60 and got[1][0][0][0] == got[1][0][0][-1]
    assert got[3] is None and got[4] == [] and got[6] == [[]]
    assert len(got[2][0][0]) == 4 == len(got[5][1][0]) and len(got[5][0]) == 2 and len(got[5][0][1]) < 60


def test_points_are_never_broadcast(spark):
    cells = spark.range(50).selectExpr("0 mesh", "id k", "array(array(transform(sequence(0, 4), i -> struct(double(id + (i + 1) % 4 div 2) x, double((i % 4) div 2) y)))) geometry")
    out = simplify.simplified_mesh(cells, ["mesh"], ["k"], 0.01)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().sparkPlan().toString()
    assert {r.k for r in out.collect()} == set(range(50))
