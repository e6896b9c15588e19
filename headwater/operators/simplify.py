"""FN-G06: simplified outlines whose neighbours keep their shared borders.

Rings are cut at junctions, the points where more than two borders meet. An arc between junctions is thinned
by the distance of its points from the chord, always in the same direction, so every ring that runs along a border
gets the same points of it: neighbours neither part nor overlap. Junctions stay. Points are found by an equi-join on
their coordinates; a mesh of any size is dealt over all tasks, and geometries travel once. The joins are merged by
hint: points are made from few columns, so their size is estimated far too low, and they would be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.functions.outlines import TOLERANCE, thinned

def junction_numbers(features: DataFrame, mesh: list[str], key: list[str]) -> DataFrame:
    """(mesh, key, junctions): the numbers of a feature's points, in flat order, at which borders meet.

    A point's neighbours are those before and after it in every ring of the mesh; with more than two of
    them it is a junction. A point has as many rows as rings meet there, so no point is hot.
    """
    ring = F.struct("_start", "_ring")
    rings = features.select(*mesh, *key, F.flatten("geometry").alias("_rings")).select(
        *mesh, *key, F.posexplode("_rings").alias("_n", "_ring"),
        F.expr("transform(_rings, (r, i) -> aggregate(slice(_rings, 1, i), 0, (n, q) -> n + size(q)))").alias("_starts"),
    ).select(*mesh, *key, F.get("_starts", F.col("_n")).alias("_start"), "_ring").where("size(_ring) > 3")
    point = lambda i: F.get("_ring", i)
    last = F.size("_ring") - 1
    walked = rings.select(*mesh, *key, ring.alias("_r")).select(*mesh, *key, "_r._start", "_r._ring").select(
        *mesh, *key, "_start", F.posexplode(F.slice("_ring", 1, last)).alias("_i", "_p"), "_ring"
    )
    beside = walked.select(
        *mesh, *key, (F.col("_start") + F.col("_i")).alias("_number"), "_p",
        F.explode(F.array(point((F.col("_i") + last - 1) % last), point((F.col("_i") + 1) % last))).alias("_beside"),
    )
    degree = beside.groupBy(*mesh, "_p").agg(F.size(F.collect_set("_beside")).alias("_degree")).where("_degree > 2").drop("_degree")
    own = walked.select(*mesh, *key, (F.col("_start") + F.col("_i")).alias("_number"), "_p")
    return own.join(degree.hint("merge"), [*mesh, "_p"]).groupBy(*mesh, *key).agg(F.sort_array(F.collect_list(F.col("_number").cast("long"))).alias("junctions"))


def _thinner(names: list[str], tolerance: float):
    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = list(batch.columns)
            place = names.index("geometry")
            simple = thinned(arrays[place], arrays[-1], tolerance)
            arrays[place] = simple.cast(batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(arrays[:-1], names)

    return thin


def simplified_mesh(features: DataFrame, mesh: list[str], key: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """``features`` with their multipolygons (geometry) simplified; those of one mesh keep their shared borders.

    ``key`` is unique within a mesh. Null geometries stay null, rings that would collapse stay whole, and a
    feature that shares no border is simplified by itself.
    """
    marks = junction_numbers(features, mesh, key)
    names = features.columns
    joined = features.join(marks.hint("merge"), [*mesh, *key], "left").select(*names, F.coalesce("junctions", F.array().cast("array<bigint>")).alias("_junctions"))
    return joined.mapInArrow(_thinner(names, tolerance), features.schema)
