"""Pixel tables, geometry and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from headwater.catalog.registry import query, rounded
from headwater.functions import geometry as G
from headwater.functions import numbers as N
from headwater.functions import text as X
from headwater.functions.canonical import canonical_decimal
from headwater.functions.colours import BURN_CLASSES, BURN_PALETTES, CATEGORICAL, hex_upper, legend_colours, map_table
from headwater.operators import containment, raster
from headwater.operators import simplify as outlines
from headwater.plans import quality
from headwater.sources.files import feature_text


def is_change():
    """Half of the rasters are change maps."""
    return F.substring("raster_id", -1, 1).cast("int") < 5


CHANGE_SQL = "substr(raster_id, length(raster_id), 1)::INTEGER < 5"
RANGES = f""", rg AS (SELECT raster_id, count(*) AS pixels, {CHANGE_SQL} AS is_change, min(value) AS lo, max(value) AS hi FROM pixels GROUP BY raster_id),
r AS (SELECT raster_id, pixels, is_change, CASE WHEN is_change AND lo < 0 THEN -greatest(abs(lo), abs(hi)) ELSE lo END AS range_min,
  CASE WHEN is_change AND lo < 0 THEN greatest(abs(lo), abs(hi)) ELSE hi END AS range_max FROM rg)"""
LEVELS = RANGES + """, lv AS (SELECT p.raster_id, p."row", p.col, r.is_change,
  greatest(0::DOUBLE, least(1::DOUBLE, (p.value - range_min) / (range_max - range_min))) * 255 AS level FROM pixels p JOIN r USING (raster_id))"""


@query(RANGES + " SELECT * FROM r", "pixels")
def pixel_range(t):
    return raster.value_ranges(t.pixels, ["raster_id"], is_change())


def levels(t):
    return raster.rescale(t.pixels, raster.value_ranges(t.pixels, ["raster_id"], is_change()), ["raster_id"])


@query(LEVELS + ' SELECT raster_id, "row", col, is_change, round(level, 6) AS level FROM lv', "pixels")
def pixel_rescale(t):
    return rounded(levels(t).select("raster_id", "row", "col", "is_change", "level"), 6)


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def anchored_sql(kind: str) -> str:
    return f"list_extract({sql_list(map_table(kind))}, i + 1)"


@query(
    LEVELS + f""", i AS (SELECT *, least(255, greatest(0, floor(level)))::INTEGER AS i FROM lv)
SELECT raster_id, "row", col, CASE WHEN is_change THEN {anchored_sql('diverging')} ELSE {anchored_sql('sequential')} END AS colour FROM i""",
    "pixels",
)
def pixel_colour(t):
    return raster.coloured(levels(t)).select("raster_id", "row", "col", "colour")


def burn_values(mode: str) -> str:
    rows = [
        f"({pixel}, {code}, '{label}', '{hex_upper(rgb)}')"
        for pixel, ((code, label), rgb) in enumerate(zip(BURN_CLASSES, BURN_PALETTES[mode]))
    ]
    return f"(VALUES {', '.join(rows)}) b(pixel, class_value, label, hex)"


@query(
    f"""WITH p AS (SELECT event_id, 'legacy' AS mode, (user_id % 6)::INTEGER AS value FROM events)
SELECT event_id, l.class_value, l.label, l.hex, s.hex AS shift_hex FROM p
LEFT JOIN {burn_values('legacy')} ON b.pixel = p.value LEFT JOIN (SELECT * FROM {burn_values('shift')}) s ON s.pixel = p.value
LEFT JOIN (SELECT * FROM {burn_values('legacy')}) l ON l.pixel = p.value"""
)
def burn_class(t):
    pixels = t.events.select("event_id", (F.col("user_id") % 6).cast("int").alias("value"))
    legacy = raster.burn_classes(pixels, "no such mode").select("event_id", "value", "class_value", "label", "hex")
    shift = raster.burn_palette(t.spark, "shift").select("pixel", F.col("hex").alias("shift_hex"))
    return legacy.join(F.broadcast(shift), F.col("value") == F.col("pixel"), "left").select(
        "event_id", "class_value", "label", "hex", "shift_hex"
    )


@query(
    """SELECT vec_id, label AS value, CASE WHEN label = 1 THEN '#00FFFF' END AS stream_colour FROM embeddings"""
)
def stream_pixels(t):
    return t.embeddings.select("vec_id", F.col("label").alias("value"), raster.stream_colour(F.col("label")).alias("stream_colour"))


TILE = """, m AS (SELECT raster_id, "row", col, value, (x + 180) / 360 * 16 AS ax,
  (0.5::DOUBLE - ln((1 + sin(radians(y))) / (1 - sin(radians(y)))) / (4 * pi())) * 16 AS ay FROM pixels),
c AS (SELECT *, floor(ax)::INTEGER AS tx, floor(ay)::INTEGER AS ty FROM m),
p AS (SELECT *, floor((ax - tx) * 256)::INTEGER AS px, floor((ay - ty) * 256)::INTEGER AS py FROM c),
b AS (SELECT raster_id, tx, ty, px, py, min_by(value, {'d': pow(abs((ax - tx) * 256 - px - 0.5::DOUBLE), 2) + pow(abs((ay - ty) * 256 - py - 0.5::DOUBLE), 2), 'r': "row", 'c': col}) AS value
  FROM p GROUP BY raster_id, tx, ty, px, py)"""


@query(
    TILE + """ SELECT raster_id, 4 AS z, tx AS tile_x, ty AS tile_y, count(*) AS tile_pixels, round(min(value), 6) AS low, round(max(value), 6) AS high
FROM b GROUP BY raster_id, tx, ty""",
    "pixels",
)
def tile_index(t):
    return rounded(raster.tile_counts(t.pixels, ["raster_id"], 4), 6)


@query(
    f""", b AS (SELECT 'r-' || l_suppkey AS raster_id, min(l_quantity) AS range_min, max(l_extendedprice) AS range_max, CASE WHEN l_suppkey % 2 = 0 THEN 'sequential' ELSE 'diverging' END AS kind FROM lineitem GROUP BY l_suppkey),
s AS (SELECT raster_id, kind, unnest([0, 1, 2, 3, 4]) AS stop, range_min, range_max FROM b)
SELECT raster_id, stop, round(range_min + stop / 4.0::DOUBLE * (range_max - range_min), 6) AS value,
  list_extract(CASE kind WHEN 'sequential' THEN {sql_list(legend_colours('sequential'))} ELSE {sql_list(legend_colours('diverging'))} END, stop + 1) AS hex FROM s""",
    "pixels",
)
def legend(t):
    ranges = t.lineitem.groupBy("l_suppkey").agg(F.min("l_quantity").alias("range_min"), F.max("l_extendedprice").alias("range_max"))
    kind = F.when(F.col("l_suppkey") % 2 == 0, "sequential").otherwise(F.lit("diverging"))
    stops = raster.continuous_legend(ranges, kind, ["sequential", "diverging"], 6)
    return stops.select(F.concat(F.lit("r-"), F.col("l_suppkey").cast("string")).alias("raster_id"), "stop", "value", "hex")


@query(
    f"""WITH v AS (SELECT DISTINCT o_orderpriority AS raster_id, month(o_orderdate)::INTEGER AS value FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY raster_id ORDER BY value) - 1 AS position FROM v)
SELECT raster_id, value, position::INTEGER AS position, list_extract({sql_list([hex_upper(c) for c in CATEGORICAL])}, (position % 10 + 1)::INTEGER) AS hex FROM n"""
)
def category_legend(t):
    classes = t.orders.select(F.col("o_orderpriority").alias("raster_id"), F.month("o_orderdate").alias("value"))
    return raster.categorical_legend(classes, ["raster_id"], "value")


@query(
    """WITH d AS (SELECT s_suppkey AS id, 'EPSG:' || (26900 + s_nationkey) AS crs, 512 AS width, s_nationkey AS height, 1 AS bands, -9999.0::DOUBLE AS nodata, s_acctbal AS minx FROM supplier),
o AS (SELECT l_suppkey AS id, 'EPSG:' || (26900 + max(s_nationkey)) AS crs, 512 AS width, CASE WHEN count(*) > 600 THEN -1 ELSE max(s_nationkey) END AS height,
    min(l_linenumber) AS bands, -9999.0::DOUBLE AS nodata, max(s_acctbal) + CASE WHEN max(s_nationkey) < 10 THEN 0.5 ELSE 0 END AS minx
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 0 GROUP BY l_suppkey)
SELECT d.id, CASE WHEN o.id IS NULL THEN 'missing' ELSE array_to_string(list_filter([CASE WHEN d.height IS DISTINCT FROM o.height THEN 'height' END,
    CASE WHEN abs(d.minx - o.minx) > 1e-9 THEN 'bounds' END], lambda x: x IS NOT NULL), ',') END AS differs,
  o.id IS NOT NULL AND d.height IS NOT DISTINCT FROM o.height AND abs(d.minx - o.minx) <= 1e-9 AS agrees FROM d LEFT JOIN o USING (id)"""
)
def raster_agreement(t):
    crs = lambda key: F.concat(F.lit("EPSG:"), (key + 26900).cast("string")).alias("crs")
    box = [F.lit(0.0).alias("miny"), F.lit(1.0).alias("maxx"), F.lit(1.0).alias("maxy")]
    declared = t.supplier.select(
        F.col("s_suppkey").alias("id"), crs(F.col("s_nationkey")), F.lit(512).alias("width"), F.col("s_nationkey").alias("height"),
        F.lit(1).alias("bands"), F.lit(-9999.0).alias("nodata"), F.col("s_acctbal").alias("minx"), *box,
    )
    counted = t.lineitem.groupBy(F.col("l_suppkey").alias("id")).agg(F.count(F.lit(1)).alias("_n"), F.min("l_linenumber").alias("bands"))
    observed = counted.join(t.supplier.where("s_acctbal > 0"), F.col("id") == F.col("s_suppkey")).select(
        "id", crs(F.col("s_nationkey")), F.lit(512).alias("width"),
        F.when(F.col("_n") > 600, -1).otherwise(F.col("s_nationkey")).alias("height"), "bands", F.lit(-9999.0).alias("nodata"),
        (F.col("s_acctbal") + F.when(F.col("s_nationkey") < 10, 0.5).otherwise(F.lit(0.0))).alias("minx"), *box,
    )
    return raster.metadata_agreement(declared, observed, "id")


@query(
    """SELECT raster_id, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy, (min(x) + max(x)) / 2 AS centre_x, (min(y) + max(y)) / 2 AS centre_y
FROM pixels GROUP BY raster_id""",
    "pixels",
)
def extent(t):
    box = t.pixels.groupBy("raster_id").agg(
        F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy")
    )
    return box.withColumn("centre_x", (F.col("minx") + F.col("maxx")) / 2).withColumn("centre_y", (F.col("miny") + F.col("maxy")) / 2)


def parcel(minx, miny, width, height):
    """A rectangle as a one-ring multipolygon."""
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    right, top = minx + width, miny + height
    return F.array(F.array(F.array(
        corner(minx, miny), corner(right, miny), corner(right, top), corner(minx, top), corner(minx, miny)
    )))


def supplier_parcels(t):
    """Parent parcels per supplier and child parcels per line, in degrees."""
    parents = t.supplier.select(
        F.concat(F.lit("s-"), F.col("s_suppkey").cast("string")).alias("runid"),
        parcel(F.lit(-120.0), F.lit(40.0), (F.col("s_nationkey") + 1) / 10.0, (F.col("s_nationkey") + 1) / 20.0).alias("geometry"),
    )
    children = t.lineitem.select(
        F.concat(F.lit("s-"), F.col("l_suppkey").cast("string")).alias("runid"), F.col("l_orderkey").alias("topazid"),
        parcel(F.lit(-120.0) + F.col("l_tax"), F.lit(40.0) + F.col("l_discount"), F.col("l_quantity") / 1000.0, F.col("l_linenumber") / 100.0).alias("geometry"),
    )
    return parents, children


@query(
    """WITH c AS (SELECT l_suppkey AS k, sum(l_quantity / 1000 * l_linenumber / 100) AS child_area FROM lineitem GROUP BY l_suppkey),
p AS (SELECT s_suppkey AS k, (s_nationkey + 1) / 10.0::DOUBLE * ((s_nationkey + 1) / 20.0::DOUBLE) AS parent_area FROM supplier)
SELECT 's-' || k AS runid, round(COALESCE(child_area, 0), 6) AS child_area, round(parent_area, 6) AS parent_area, round(COALESCE(child_area, 0) / parent_area, 10) AS ratio,
  COALESCE(child_area, 0) / parent_area BETWEEN 0.01 AND 2.0 AS reasonable FROM p LEFT JOIN c USING (k)"""
)
def area_ratio(t):
    parents, children = supplier_parcels(t)
    area = lambda df: df.select("runid", G.area(F.col("geometry")).alias("area"))
    ratios = quality.area_ratio(area(children), area(parents))
    return ratios.select(
        "runid", F.round("child_area", 6).alias("child_area"), F.round("parent_area", 6).alias("parent_area"),
        F.round("ratio", 10).alias("ratio"), "reasonable",
    )


def catchments(t, x0=None, width=None):
    """Parents that are not convex: a rectangle with a hole, or with its upper right quarter cut away.

    ``x0`` and ``width`` replace the left side and the width.
    """
    x0 = F.lit(-120.0) if x0 is None else x0
    width, height = (F.col("s_nationkey") + 1) / 10.0 if width is None else width, (F.col("s_nationkey") + 1) / 20.0
    ring = lambda *corners: F.array(*[F.struct((x0 + width * a).alias("x"), (F.lit(40.0) + height * b).alias("y")) for a, b in corners])
    holed = F.array(F.array(
        ring((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)), ring((0.25, 0.25), (0.25, 0.5), (0.5, 0.5), (0.5, 0.25), (0.25, 0.25))
    ))
    notched = F.array(F.array(ring((0, 0), (1, 0), (1, 0.5), (0.5, 0.5), (0.5, 1), (0, 1), (0, 0))))
    return t.supplier.select("s_suppkey", "s_acctbal", F.when(F.col("s_nationkey") % 2 == 0, holed).otherwise(notched).alias("geometry"))


def catchment_children(t, run):
    """A parcel per line, at the lower left corner of its parent or a little away from it."""
    return t.lineitem.select(
        run.alias("runid"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("topazid"), "l_suppkey", "l_quantity", "l_returnflag",
        parcel(F.lit(-120.0) + F.col("l_tax"), F.lit(40.0) + F.col("l_discount"), F.col("l_quantity") / 1000.0, F.col("l_linenumber") / 100.0).alias("geometry"),
    )


# Inside the rectangle, and beside the part cut out of it; touching is neither outside nor overlapping.
CHILD_SQL = "l_tax AS l, l_tax + l_quantity / 1000 AS r, l_discount AS b, l_discount + l_linenumber / 100.0::DOUBLE AS tp"
COVERED_SQL = """(r <= w + 1e-11 AND tp <= h + 1e-11 AND NOT (CASE WHEN n % 2 = 0
  THEN r > w / 4 + 1e-11 AND l < w / 2 - 1e-11 AND tp > h / 4 + 1e-11 AND b < h / 2 - 1e-11 ELSE r > w / 2 + 1e-11 AND tp > h / 2 + 1e-11 END))"""


def covers_sql(parent: str) -> str:
    return f"""WITH c AS (SELECT {parent} AS k, {CHILD_SQL} FROM lineitem),
p AS (SELECT s_suppkey AS k, s_nationkey AS n, (s_nationkey + 1) / 10.0::DOUBLE AS w, (s_nationkey + 1) / 20.0::DOUBLE AS h FROM supplier)
SELECT 's-' || k AS runid, count(*) AS children, count(*) FILTER (WHERE {COVERED_SQL}) AS covered FROM c JOIN p USING (k) GROUP BY k"""


def _covered(t, parent):
    run = lambda number: F.concat(F.lit("s-"), number.cast("string"))
    parents = catchments(t).select(run(F.col("s_suppkey")).alias("runid"), "geometry")
    answers = containment.covered_children(parents, catchment_children(t, run(parent)).select("runid", "topazid", "geometry"))
    # Combined over the children's own keys first: a join leaves the children of a large run together.
    return answers.groupBy("runid").agg(F.count(F.lit(1)).alias("children"), F.count_if("covered").alias("covered"))


@query(covers_sql("l_suppkey"))
def covers(t):
    return _covered(t, F.col("l_suppkey"))


@query(covers_sql("CASE WHEN l_orderkey % 10 <> 0 THEN 1 ELSE l_suppkey END"))
def covers_hot_run(t):
    """Nine tenths of all children belong to one run."""
    return _covered(t, F.when(F.col("l_orderkey") % 10 != 0, F.lit(1)).otherwise(F.col("l_suppkey")))


# Border lines between unit cells, 64 to a row: a line bends out by a tenth of a cell where its number says so, and
# else wavers by less than the tolerance. A cell keeps its four corners, its closing point and the bends of its sides.
@query(
    """WITH c AS (SELECT p_partkey // 64 AS r, p_partkey % 64 AS c, p_partkey FROM part)
SELECT p_partkey, 17 AS points_before, 5 + (r * 3 + c * 5) % 7 // 6 + ((r + 1) * 3 + c * 5) % 7 // 6 + (r * 7 + c * 3) % 5 // 4 + (r * 7 + (c + 1) * 3) % 5 // 4 AS points_after,
  round(1 + 0.05 * (((r + 1) * 3 + c * 5) % 7 // 6 - (r * 3 + c * 5) % 7 // 6 + (r * 7 + (c + 1) * 3) % 5 // 4 - (r * 7 + c * 3) % 5 // 4), 9) AS area FROM c"""
)
def simplified_mesh(t):
    """Parts as cells of one mesh, whose neighbours share wavering and bent borders."""
    row, column = F.floor(F.col("p_partkey") / 64).cast("long"), F.col("p_partkey") % 64
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    out = lambda bent, s, wave: F.when(bent, 0.1 * (1 - F.abs(F.lit(2 * s - 1.0)))).otherwise(F.lit(wave))
    inner = ((0.25, 1e-5), (0.5, -1e-5), (0.75, 1e-5))
    level = lambda r, c: [point(c + s, r + out((r * 3 + c * 5) % 7 == 6, s, w)) for s, w in inner]
    upright = lambda r, c: [point(c + out((r * 7 + c * 3) % 5 == 4, s, w), r + s) for s, w in inner]
    corner = lambda a, b: point(column + a, row + b)
    ring = F.array(
        corner(0, 0), *level(row, column), corner(1, 0), *upright(row, column + 1), corner(1, 1), *level(row + 1, column)[::-1],
        corner(0, 1), *upright(row, column)[::-1], corner(0, 0),
    )
    cells = t.part.select(F.lit(0).alias("mesh"), "p_partkey", F.array(F.array(ring)).alias("geometry"))
    thin = outlines.simplified_mesh(cells, ["mesh"], ["p_partkey"], 0.001)
    before = cells.select("p_partkey", F.size(G.points(F.col("geometry"))).alias("points_before"))
    both = thin.join(before.hint("merge"), "p_partkey")
    return both.select(
        "p_partkey", "points_before", F.size(G.points(F.col("geometry"))).alias("points_after"), F.round(G.area(F.col("geometry")), 9).alias("area"))


@query()
def simplify(t):
    """Rings drawn from embeddings (rows-only): area, box and point counts before and after."""
    turn = F.lit(6.283185307179586) / 64
    ring = F.transform(
        F.sequence(F.lit(0), F.lit(64)),
        lambda i: F.struct(
            (F.cos(turn * (i % 64)) * (F.lit(0.01) + F.get("embedding", i % 64).cast("double") / 100) - 120).alias("x"),
            (F.sin(turn * (i % 64)) * (F.lit(0.01) + F.get("embedding", i % 64).cast("double") / 100) + 40).alias("y"),
        ),
    )
    shapes = t.embeddings.select("vec_id", F.array(F.array(ring)).alias("geometry"))
    thin = shapes.withColumn("simple", G.simplifier()(F.col("geometry")))
    return thin.select(
        "vec_id", F.size(G.points(F.col("geometry"))).alias("points_before"), F.size(G.points(F.col("simple"))).alias("points_after"),
        F.round(G.area(F.col("geometry")), 9).alias("area_before"), F.round(G.area(F.col("simple")), 9).alias("area_after"),
    )


def utm_sql(x: str, y: str, flattening: float, meridian: int) -> str:
    """The inverse transverse Mercator series in SQL, over columns k, line and the two coordinates.

    Written from the published series in the third flattening, apart from the code it checks; a sum per series.
    """
    n = flattening / (2 - flattening)
    scale = 0.9996 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    back = [n / 2 - n**2 * 2 / 3 + n**3 * 37 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - n**4 * 437 / 1440, n**3 * 17 / 480 - n**4 * 37 / 840, n**4 * 4397 / 161280]
    to = [2 * n - n**2 * 2 / 3 - 2 * n**3 + n**4 * 116 / 45, n**2 * 7 / 3 - n**3 * 8 / 5 - n**4 * 227 / 45, n**3 * 56 / 15 - n**4 * 136 / 35, n**4 * 4279 / 630]
    total = lambda sign, series, term: " ".join(f"{sign} ({c!r}::DOUBLE) * {term.format(2 * i)}" for i, c in enumerate(series, 1))
    return f"""(SELECT k, line, {y} / {scale!r}::DOUBLE AS north, ({x} - 500000) / {scale!r}::DOUBLE AS east FROM lines) a,
LATERAL (SELECT north {total('-', back, 'sin({0} * north) * cosh({0} * east)')} AS u, east {total('-', back, 'cos({0} * north) * sinh({0} * east)')} AS v) b,
LATERAL (SELECT asin(sin(u) / cosh(v)) AS chi, {meridian} + degrees(atan2(sinh(v), cos(u))) AS lon) c,
LATERAL (SELECT degrees(chi {total('+', to, 'sin({0} * chi)')}) AS lat) d"""


@query(
    f"""WITH lines AS (SELECT l_orderkey AS k, l_linenumber AS line, 400000 + l_extendedprice AS x, 4500000 + l_quantity * 10000 AS y FROM lineitem)
SELECT k AS l_orderkey, line AS l_linenumber, round(lon, 8) AS lon, round(lat, 8) AS lat FROM {utm_sql('x', 'y', 1 / 298.257222101, -123)}"""
)
def reproject(t):
    """UTM zone 10 coordinates made from line items, as longitude and latitude."""
    place = G.utm_to_wgs84(26910, F.lit(400000.0) + F.col("l_extendedprice"), F.lit(4500000.0) + F.col("l_quantity") * 10000)
    return t.lineitem.select("l_orderkey", "l_linenumber", place.alias("_p")).select(
        "l_orderkey", "l_linenumber", F.round("_p.x", 8).alias("lon"), F.round("_p.y", 8).alias("lat")
    )


@query(
    """SELECT s_suppkey AS id, '{"id":"s-' || s_suppkey || '","type":"Feature","properties":{"s_name":"' || s_name || '","owner":'
  || CASE WHEN s_acctbal > 0 THEN '"n' || s_nationkey || '"' ELSE 'null' END || '},"geometry":'
  || CASE WHEN s_acctbal > 1000 THEN '{"type":"MultiPolygon","coordinates":[[[[-120.0,40.0],[-119.5,40.0],[-119.5,' || (40 + (s_nationkey + 1) / 2.0::DOUBLE) || '],[-120.0,'
  || (40 + (s_nationkey + 1) / 2.0::DOUBLE) || '],[-120.0,40.0]]]]}' ELSE 'null' END || '}' AS feature FROM supplier"""
)
def feature_rows(t):
    shape = parcel(F.lit(-120.0), F.lit(40.0), F.lit(0.5), (F.col("s_nationkey") + 1) / 2.0)
    rows = t.supplier.select(
        "s_suppkey", "s_name", F.when(F.col("s_acctbal") > 0, F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))).alias("owner"),
        F.when(F.col("s_acctbal") > 1000, shape).alias("geometry"),
    )
    name = F.concat(F.lit("s-"), F.col("s_suppkey").cast("string"))
    return rows.select(F.col("s_suppkey").alias("id"), feature_text(name, ["s_name", "owner"], F.col("geometry")).alias("feature"))


# --- scalar functions --------------------------------------------------------------------


@query(
    """, s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 5 THEN 'thinning_' || (l_quantity::INTEGER) || '_' || l_suppkey WHEN l_linenumber > 3 THEN 'prescribed_fire' ELSE 'mixed_' || lower(l_returnflag) || '_run_' || l_suppkey END AS scenario FROM lineitem)
SELECT l_orderkey, l_linenumber, scenario, array_to_string(list_transform(string_split(regexp_replace(scenario, '([0-9]+)_([0-9]+)', '\\1-\\2', 'g'), '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS label,
  CASE scenario WHEN 'prescribed_fire' THEN 'Prescribed fire (2020)' WHEN 'mixed_r_run_3' THEN 'run 3, returned' ELSE array_to_string(list_transform(string_split(scenario, '_'), lambda w: upper(w[1]) || w[2:]), ' ') END AS display FROM s""",
    "watersheds",
)
def labels(t):
    line = F.col("l_linenumber")
    key = F.col("l_suppkey").cast("string")
    name = F.when(line > 5, F.concat(F.lit("thinning_"), F.col("l_quantity").cast("int").cast("string"), F.lit("_"), key)).when(
        line > 3, "prescribed_fire"
    ).otherwise(F.concat(F.lit("mixed_"), F.lower("l_returnflag"), F.lit("_run_"), key))
    return t.lineitem.select("l_orderkey", "l_linenumber", name.alias("scenario")).select(
        "l_orderkey", "l_linenumber", "scenario", X.scenario_label(F.col("scenario")).alias("label"),
        X.file_display_name(F.concat("scenario", F.lit(".tif")), {"prescribed_fire.tif": "Prescribed fire (2020)", "mixed_r_run_3.tif": "run 3, returned"}).alias("display"),
    )


@query(
    """WITH g AS (SELECT o_custkey, min(o_totalprice) - 5000 AS lo, max(o_totalprice) / CASE WHEN o_custkey % 3 = 0 THEN 1000 ELSE 1 END AS hi, CASE WHEN o_custkey % 2 = 0 THEN 'kg' ELSE 'mm' END AS unit FROM orders GROUP BY o_custkey),
l AS (SELECT *, unit = 'kg' AND greatest(abs(lo), abs(hi)) >= 1000 AS large FROM g)
SELECT o_custkey, round(CASE WHEN large THEN lo / 1000 ELSE lo END, 6) AS low, round(CASE WHEN large THEN hi / 1000 ELSE hi END, 6) AS high, CASE WHEN large THEN 't' ELSE unit END AS unit FROM l"""
)
def legend_ranges(t):
    ranges = t.orders.groupBy("o_custkey").agg((F.min("o_totalprice") - 5000).alias("lo"), F.max("o_totalprice").alias("hi"))
    high = F.when(F.col("o_custkey") % 3 == 0, F.col("hi") / 1000).otherwise(F.col("hi"))
    unit = F.when(F.col("o_custkey") % 2 == 0, "kg").otherwise(F.lit("mm"))
    scaled = ranges.select("o_custkey", N.legend_range(F.col("lo"), high, unit).alias("_r"))
    return scaled.select("o_custkey", F.round("_r.low", 6).alias("low"), F.round("_r.high", 6).alias("high"), "_r.unit")


REDACT_SQL = r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)(https?://)[^/@\s]+@', '\1[REDACTED]@', 'g'),
  '(?i)\b(password|passwd|token|secret|api[_-]?key)\s*[:=]\s*(?:"[^"]*"|''[^'']*''|\S+)', '\1=[REDACTED]', 'g'),
  '[\x00-\x1f\x7f]+', ' ', 'g'), '[\t\n\r\f\x0B\p{Z}\x{85}]+', ' ', 'g')) AS summary
FROM (SELECT doc_id, 'token: ' || doc_id || ' https://u' || doc_id || ':p@host/' || source || E'\tapi-key="' || lang || ' x" ' || text AS t FROM documents)"""


@query(REDACT_SQL)
def redact(t):
    text = F.concat(
        F.lit("token: "), F.col("doc_id").cast("string"), F.lit(" https://u"), F.col("doc_id").cast("string"), F.lit(":p@host/"),
        F.col("source"), F.lit('\tapi-key="'), F.col("lang"), F.lit(' x" '), F.col("text"),
    )
    return t.documents.select("doc_id", X.redact(text).alias("summary"))


@query(
    r"""SELECT page_id, starts_with(h, '<!doctype html') OR starts_with(h, '<html') OR starts_with(h, '<head') OR starts_with(h, '<body') AS is_html, FALSE AS text_is_html
FROM (SELECT page_id, lower(regexp_replace(substr(html, 1, 1024), '^\s+', '')) AS h FROM pages)"""
)
def html_sniff(t):
    return t.pages.select(
        "page_id", X.looks_like_html(F.col("html")).alias("is_html"), X.looks_like_html(F.col("url")).alias("text_is_html")
    )


COORD = r"'^(-?\d+(?:\.\d+)?)\s*(?:,\s*|\s+)(-?\d+(?:\.\d+)?)$'"


@query(
    f""", s AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN (l_partkey - 100) || '.5, -' || l_suppkey WHEN 2 THEN ' ' || l_suppkey || ' ' || l_partkey || ' '
   WHEN 3 THEN l_suppkey || ',' WHEN 4 THEN 'creek ' || l_suppkey WHEN 5 THEN '1 2 ' || l_suppkey ELSE 'creek' END AS t FROM lineitem),
p AS (SELECT *, trim(t) AS q, regexp_matches(trim(t), {COORD}) AS ok FROM s),
v AS (SELECT *, CASE WHEN ok THEN regexp_extract(q, {COORD}, 1)::DOUBLE END AS lat, CASE WHEN ok THEN regexp_extract(q, {COORD}, 2)::DOUBLE END AS lng FROM p)
SELECT l_orderkey, l_linenumber, lat, lng, COALESCE(lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180, FALSE) AS in_range,
  regexp_matches(q, '\\d') AND (ok OR contains(q, ',') OR len(list_filter(regexp_split_to_array(q, '\\s+'), lambda x: regexp_full_match(x, '-?\\d+(\\.\\d+)?'))) >= 2) AS coordinate_like FROM v""",
    "watersheds",
)
def coord_parse(t):
    line, part, supp = F.col("l_linenumber"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    text = (
        F.when(line == 1, F.concat((F.col("l_partkey") - 100).cast("string"), F.lit(".5, -"), supp))
        .when(line == 2, F.concat(F.lit(" "), supp, F.lit(" "), part, F.lit(" "))).when(line == 3, F.concat(supp, F.lit(",")))
        .when(line == 4, F.concat(F.lit("creek "), supp)).when(line == 5, F.concat(F.lit("1 2 "), supp)).otherwise(F.lit("creek"))
    )
    return t.lineitem.select("l_orderkey", "l_linenumber", X.parse_coordinates(text).alias("_p")).select(
        "l_orderkey", "l_linenumber", "_p.lat", "_p.lng", "_p.in_range", "_p.coordinate_like"
    )


@query(
    r"""SELECT page_id, regexp_full_match(url, 'https://[^/?#@\s]+(/[^?#]*)?') AS public_https,
  array_to_string(list_filter(list_transform(string_split(replace(url, '/', ' ; '), ';'), lambda s: trim(s)), lambda s: s <> ''), '|') AS items,
  regexp_replace(regexp_replace(url || ' ' || page_id, '[^a-zA-Z0-9_\s-]', '', 'g'), '\s+', '_', 'g') AS filename,
  regexp_full_match(md5(url) || md5(url), '[a-f0-9]{64}') AS sha_ok, regexp_full_match('2026-07-' || lpad((page_id % 32)::VARCHAR, 2, '0') || '.' || (page_id % 3), '[0-9]{4}-[0-9]{2}-[0-9]{2}\.[1-9][0-9]*') AS release_ok,
  regexp_full_match(split_part(url, '/', 4), '[a-z0-9]+(-[a-z0-9]+)*') AS key_ok FROM pages"""
)
def text_functions(t):
    release = F.concat(
        F.lit("2026-07-"), F.lpad((F.col("page_id") % 32).cast("string"), 2, "0"), F.lit("."), (F.col("page_id") % 3).cast("string")
    )
    digest = F.concat(F.md5("url"), F.md5("url"))
    return t.pages.select(
        "page_id", X.is_public_https(F.col("url")).alias("public_https"),
        F.array_join(X.semicolon_list(F.replace("url", F.lit("/"), F.lit(" ; ")), F.col("url")), "|").alias("items"),
        X.safe_filename(F.concat_ws(" ", "url", "page_id")).alias("filename"),
        X.matches(digest, X.SHA256_HEX).alias("sha_ok"), X.matches(release, X.RELEASE_ID).alias("release_ok"),
        X.matches(F.split_part(F.col("url"), F.lit("/"), F.lit(4)), X.STABLE_KEY).alias("key_ok"),
    )


@query(
    """, v AS (SELECT l_orderkey, l_linenumber, l_extendedprice * (l_quantity - 25) AS kg, l_tax, l_discount, l_quantity, l_suppkey FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN abs(kg) >= 1000 THEN kg / 1000 ELSE kg END, 6) AS mass, CASE WHEN abs(kg) >= 1000 THEN 't' ELSE 'kg' END AS unit,
  COALESCE(CASE WHEN l_suppkey > 50 THEN l_tax END, CASE WHEN l_suppkey > 20 THEN l_discount END, 0) AS range_low,
  CASE WHEN l_suppkey > 60 THEN least(l_quantity, 30) WHEN l_suppkey > 30 THEN least(l_suppkey, 30) ELSE 1 END::DOUBLE AS range_high,
  l_quantity * 4 - 90 BETWEEN -90 AND 90 AND l_quantity * 4 - 90 <= l_quantity * 3 AND l_quantity * 3 <= 90 AS in_world,
  abs(l_tax - l_discount) <= 0.001 AS close FROM v""",
    "watersheds",
)
def number_functions(t):
    kg = F.col("l_extendedprice") * (F.col("l_quantity") - 25)
    over = lambda limit, name: F.when(F.col("l_suppkey") > limit, F.col(name).cast("double"))
    low, high = N.render_range(over(20, "l_discount"), over(30, "l_suppkey"), over(50, "l_tax"), over(60, "l_quantity"), F.lit(30.0))
    south, north = F.col("l_quantity") * 4 - 90, F.col("l_quantity") * 3
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.round(N.scale_mass(kg), 6).alias("mass"), N.mass_unit(kg).alias("unit"),
        low.alias("range_low"), high.alias("range_high"), N.within_world(F.lit(0.0), south, F.lit(1.0), north).alias("in_world"),
        N.bounds_close([F.col("l_tax")], [F.col("l_discount")]).alias("close"),
    )


@query(
    r"""SELECT l_orderkey, l_linenumber, CASE WHEN v = 0 THEN '0' ELSE regexp_replace(regexp_replace(v::VARCHAR, '(\.\d*?)0+$', '\1'), '\.$', '') END AS canonical,
  CASE WHEN i >= 1000000 THEN NULL ELSE i::VARCHAR END AS small_whole
FROM (SELECT l_orderkey, l_linenumber, CAST(l_discount * l_quantity - l_tax AS DECIMAL(18, 4)) AS v, l_linenumber AS i FROM lineitem)"""
)
def canonical_numbers(t):
    value = (F.col("l_discount") * F.col("l_quantity") - F.col("l_tax")).cast("decimal(18,4)")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", canonical_decimal(value).alias("canonical"),
        N.number_text(F.col("l_linenumber").cast("double")).alias("small_whole"),
    )
