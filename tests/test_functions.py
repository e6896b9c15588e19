"""Column functions on worked cases."""

import math

import pytest
from pyspark.sql import functions as F

from headwater.functions import canonical as C
from headwater.functions import colours, geometry as G, numbers as N, text as X


def values(spark, items, kind, *columns):
    df = spark.createDataFrame([(i,) for i in items], f"v {kind}")
    return [r[0] if len(columns) == 1 else tuple(r) for r in df.select(*columns).collect()]


V = lambda: F.col("v")


def test_finite_text(spark):
    items = ["abc", None, "", " 3.5e2 ", "NaN", "Infinity", "1d", "-0.5"]
    assert values(spark, items, "string", N.finite_text_or(V())) == [0, 0, 0, 350, 0, 0, 0, -0.5]
    assert values(spark, items, "string", N.finite_text_or(V(), None)) == [None, 0, 0, 350, None, None, None, -0.5]


def test_finite_number(spark):
    items = [1.5, None, float("nan"), float("inf")]
    assert values(spark, items, "double", N.finite_or(V())) == [1.5, 0, 0, 0]
    assert values(spark, items, "double", N.is_finite(V())) == [True, False, False, False]


def test_normalise_and_colour(spark):
    got = values(spark, [-1.0, 0.0, 5.0, 10.0, 99.0], "double", N.normalise(V(), F.lit(0.0), F.lit(10.0)))
    assert got == [0, 0, 0.5, 1, 1]
    assert values(spark, [3.0], "double", N.normalise(V(), F.lit(3.0), F.lit(3.0))) == [0.5]
    shades = values(spark, [0.0, 1.0, 2.0, -1.0], "double", colours.colour_of(V(), "viridis"))
    assert shades == ["#440154", "#fde725", "#fde725", "#440154"]


@pytest.mark.parametrize("scale", sorted(colours.SCALES))
def test_shade_tables(scale):
    table = colours.shade_table(scale)
    first, last = colours.SCALES[scale][0][1:], colours.SCALES[scale][-1][1:]
    assert len(table) == 256
    assert table[0] == "#" + "".join(f"{c:02x}" for c in first)
    assert table[-1] == "#" + "".join(f"{c:02x}" for c in last)


def test_map_tables():
    assert colours.map_table("diverging")[0] == "#2166AC"
    assert colours.map_table("rainbow")[0] == "#0000FF" and colours.map_table("rainbow")[-1] == "#FF0000"
    assert colours.map_table("rainbow-reversed") == colours.map_table("rainbow")[::-1]
    assert colours.legend_colours("sequential")[2] == "#21918C"


def test_number_text(spark):
    items = [1234567.0, 0.001, 0.0, 5.0, 12.345, 1234.56]
    assert values(spark, items, "double", N.number_text(V())) == ["1.23e+6", "1.00e-3", "0", "5", "12.35", "1,234.6"]


def test_render_range(spark):
    low, high = N.render_range(F.lit(None).cast("double"), V(), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(60.0))
    assert values(spark, [90.0, 10.0, None], "double", low, high) == [(0, 60), (0, 10), (0, 1)]


def test_runids(spark):
    items = [
        "batch;;nasa-roses-2026-sbs;;or-10", "batch;;victoria-ca-2026-sbs;;Leech", "plain-run", "batch;;nasa-roses-202606-psbs;;wa-1",
    ]
    assert values(spark, items, "string", X.normalise_runid(V())) == [
        "batch;;nasa-roses-2026-sbs;;OR-10", "batch;;victoria-ca-2026-sbs;;Leech", "plain-run", "batch;;nasa-roses-202606-psbs;;WA-1",
    ]
    starts = {"batch;;": "any", "batch;;victoria-ca-2026-sbs;;": "victoria-ca"}
    assert values(spark, items, "string", X.collection_of_run(V(), {"plain-run": "creek"}, starts)) == ["any", "victoria-ca", "creek", "any"]


def test_labels(spark):
    assert values(spark, ["thinning_40_75", "prescribed_fire", "mulch_15_sbs_map"], "string", X.scenario_label(V())) == [
        "Thinning 40-75", "Prescribed Fire", "Mulch 15 Sbs Map",
    ]
    assert values(spark, ["canopy_cover_1985.tif"], "string", X.file_display_name(V())) == ["Canopy Cover 1985"]
    assert values(spark, ["s2-map_1985veg.tif"], "string", X.file_display_name(V())) == ["S2-Map 1985Veg"]
    assert values(spark, [" a ;; b;", "", None], "string", X.semicolon_list(V(), F.lit("z"))) == [["a", "b"], ["z"], ["z"]]
    assert values(spark, ["batch;;x y-1"], "string", X.safe_filename(V())) == ["batchx_y-1"]


def test_redaction(spark):
    text = 'see https://user:pw@host/x, password = "a b" and API-KEY:zzz\n\tend'
    assert values(spark, [text], "string", X.redact(V())) == [
        "see https://[REDACTED]@host/x, password=[REDACTED] and API-KEY=[REDACTED] end"
    ]
    assert values(spark, ["x" * 600], "string", F.length(X.redact(V(), 512))) == [512]
    assert values(spark, ["x" * 600 + "\u00a0\u3000y"], "string", F.length(X.redact(V()))) == [602]


def test_secret_keys(spark):
    documents = ['{"a":{"Api-Key":1,"b":"token: x"},"c":["secret"]}', '{"say \\"token\\":":1}', '{"TOKEN" : [{"credentials":{}}]}']
    assert values(spark, documents, "string", X.secret_keys_in_json(V())) == [["api_key"], [], ["token", "credentials"]]


def test_checks(spark):
    uris = ["https://a.test/x", "http://a.test/x", "https://u@a.test/x", "https://a.test/x?q", "https://a.test/x#f", None, "HTTPS://a.test", "https://a.test/x?"]
    assert values(spark, uris, "string", X.is_public_https(V())) == [True, False, False, False, False, False, True, True]
    pages = ["  \n<HTML>", "<!DOCTYPE html><p>", "plain", "x<html>"]
    assert values(spark, pages, "string", X.looks_like_html(V())) == [True, True, False, False]


@pytest.mark.parametrize("text,expected", [
    ("45.5, -120", (45.5, -120.0, True, True)), ("45 -120", (45.0, -120.0, True, True)), ("95,0", (95.0, 0.0, False, True)),
    ("45,", (None, None, False, True)), ("creek 5", (None, None, False, False)), ("1 2 3", (None, None, False, True)), ("creek", (None, None, False, False)),
])
def test_coordinates(spark, text, expected):
    assert tuple(values(spark, [text], "string", X.parse_coordinates(V()))[0]) == expected


def test_canonical_numbers(spark):
    items = [0.0, -0.0, 1e21, 1.5e-7, 0.1, 100.0, float("nan")]
    assert values(spark, items, "double", C.canonical_double(V())) == ["0", "0", "1000000000000000000000", "0.00000015", "0.1", "100", None]
    assert values(spark, [100, 0, -5], "bigint", C.canonical_decimal(V())) == ["100", "0", "-5"]


def test_canonical_line(spark):
    line = C.json_line({"b": F.lit(None).cast("string"), "a": F.struct(F.lit(True).alias("x"), V().alias("y"))})
    assert values(spark, ["é\n\"q\""], "string", line) == ['{"a":{"x":true,"y":"é\\n\\"q\\""},"b":null}\n']
    assert values(spark, ["é"], "string", C.compose_unicode(V())) == ["é"]


def test_attribute_maps(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": None, "c": "3"})], "old map<string,string>, new map<string,string>")
    assert df.select(C.merge_attributes(F.col("old"), F.col("new"))).first()[0] == {"a": "1", "b": None, "c": "3"}
    assert df.select(C.attribute_map({"x": F.lit(1), "y": F.lit(None)})).first()[0] == {"x": "1"}


SQUARE = "[[[0,0],[10,0],[10,10],[0,10],[0,0]],[[4,4],[6,4],[6,6],[4,6],[4,4]]]"


def shapes(spark, rows):
    return spark.createDataFrame(rows, "kind string, coordinates string").select(
        G.multipolygon(F.col("kind"), F.col("coordinates")).alias("g")
    )


def test_geometry(spark):
    df = shapes(spark, [("Polygon", SQUARE), ("MultiPolygon", f"[{SQUARE},{SQUARE}]"), ("Polygon", "[]"), ("Point", "[1,2]")])
    rows = df.select(F.size("g").alias("n"), G.area(F.col("g")).alias("a"), G.bbox(F.col("g")).alias("b")).collect()
    assert [(r.n, r.a) for r in rows[:2]] == [(1, 96.0), (2, 192.0)]
    assert tuple(rows[0].b) == (0, 0, 10, 10)
    assert rows[2].b is None and rows[3].b is None
    text = df.select(G.geojson(F.col("g"), 2)).collect()
    assert text[0][0].startswith('{"type":"MultiPolygon","coordinates":[[[[0.0,0.0],[10.0,0.0]') and text[2][0] is None


def test_valid_coordinates(spark):
    rows = [("Polygon", SQUARE), ("Point", "[181,0]"), ("LineString", "[[0,0],[1,1]]"), ("MultiPoint", "[]"), ("Point", "[5,6]")]
    df = spark.createDataFrame(rows, "kind string, coordinates string")
    flat = G.geojson_points(F.col("kind"), F.col("coordinates"))
    assert [r[0] for r in df.select(G.valid_coordinates(flat)).collect()] == [True, False, True, False, True]


def test_simplify_keeps_shape(spark):
    turn = [2 * math.pi * i / 200 for i in range(200)]
    ring = [[math.cos(a), math.sin(a)] for a in turn] + [[1.0, 0.0]]
    df = shapes(spark, [("Polygon", str([ring])), ("Polygon", "[[[0,0],[1e-6,0],[1e-6,1e-6],[0,0]]]")])
    rows = df.select("g", G.simplifier(0.01)(F.col("g")).alias("s")).select(
        F.size(G.points(F.col("s"))).alias("n"), G.area(F.col("g")).alias("a"), G.area(F.col("s")).alias("b")
    ).collect()
    assert rows[0].n < 60 and abs(rows[0].a - rows[0].b) < 0.05
    assert rows[1].n == 4


def test_reprojection(spark):
    place = spark.range(1).select(G.utm_to_wgs84(32610, F.lit(500000.0), F.lit(0.0)), G.utm_to_wgs84(26910, F.lit(600000.0), F.lit(5000000.0))).first()
    assert tuple(place[0]) == pytest.approx((-123.0, 0.0), abs=1e-12)
    assert tuple(place[1]) == pytest.approx((-121.727967, 45.146393), abs=1e-6)
    assert G.epsg_of_crs_name("urn:ogc:def:crs:EPSG::26910") == 26910 and G.epsg_of_crs_name(None) is None
    with pytest.raises(ValueError):
        G.utm_to_wgs84(3857, F.lit(0.0), F.lit(0.0))


def test_composed_values(spark):
    marked, document = "e\u0301", '{"a\\u0301":"e\u0301","n":1.50,"x":"\\n\u0301\\ud800","p":"\\\\u0301"}'
    assert values(spark, [marked, "plain", None], "string", C.canonical_text(V())) == ["\u00e9", "plain", None]
    assert values(spark, [document, None, '{"a":1e3}'], "string", C.composed_document(V())) == [
        '{"\u00e1":"\u00e9","n":1.50,"x":"\\n\u0301\\ud800","p":"\\\\u0301"}', None, '{"a":1e3}']
    # A mark after an escaped line break stays a mark of its own.
    line = C.json_line({"a": C.canonical_text(V())})
    assert values(spark, ["\n\u0301"], "string", line) == ['{"a":"\\n\u0301"}\n']
