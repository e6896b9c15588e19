"""Sources and sinks on written files, and what the plans push down."""

import csv
import glob
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headwater.functions import geometry as G
from headwater.operators import ingest
from headwater.operators.query import parquet_opener
from headwater.sources import files

SQUARE = [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]
PROPERTIES = T.StructType([T.StructField("TopazID", T.IntegerType()), T.StructField("name", T.StringType())])


def feature(i, kind="Polygon", coordinates=SQUARE):
    return {"type": "Feature", "properties": {"TopazID": i, "name": f"é{i}"}, "geometry": {"type": kind, "coordinates": coordinates}}


def test_read_features(spark, tmp_path):
    path = tmp_path / "a.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [feature(1), feature(2, "MultiPolygon", [SQUARE, SQUARE])]}, indent=1))
    rows = files.read_features(spark, str(path), PROPERTIES).select(
        "position", "properties.TopazID", G.multipolygon(F.col("kind"), F.col("coordinates")).alias("g")
    ).select("position", "TopazID", F.size("g"), G.area(F.col("g"))).orderBy("position").collect()
    assert [tuple(r) for r in rows] == [(0, 1, 1, 1.0), (1, 2, 2, 2.0)]


@pytest.mark.parametrize("document,fault", [
    ({"type": "FeatureCollection", "features": [feature(1)]}, None), ({"type": "Feature", "features": [feature(1)]}, "type"),
    ({"type": "FeatureCollection", "features": []}, "no-features"), ({"type": "FeatureCollection", "features": [{**feature(1), "type": "x"}]}, "feature"),
    ({"type": "FeatureCollection", "features": [{**feature(1), "properties": None}]}, "properties"),
])
def test_collection_faults(spark, tmp_path, document, fault):
    path = tmp_path / "b.geojson"
    path.write_text(json.dumps(document))
    assert files.collection_faults(spark, str(path)).first().fault == fault


@pytest.mark.parametrize("size", [7, 64, 501, 10**6])
def test_features_do_not_depend_on_splits(size):
    """Every way to cut a file gives the same features: strings with brackets, escapes, members before and after."""
    import random

    from headwater.sources import geojson

    pick = random.Random(size)
    for trial in range(20):
        names = ["".join(pick.choice('ab{}[]",\\:é\n ') for _ in range(pick.randrange(12))) for _ in range(pick.randrange(1, 9))]
        features = [{"type": "Feature", "properties": {"n": name, '"features":[{': [{"x": [name]}]}, "geometry": None} for name in names]
        members = [("type", "FeatureCollection"), ("crs", {"a": {"features": [{"type": "Feature"}]}, "list": [{}, [{}]]}), ("bbox", [1, 2]), ("features", features), ("rest", [{"b": [{}]}])]
        pick.shuffle(members)
        path = f"/tmp/headwater-split-{size}.geojson"
        with open(path, "w", encoding="utf-8") as out:
            out.write(json.dumps(dict(members), indent=pick.choice([None, 1]), ensure_ascii=pick.random() < 0.5))
        total = len(open(path, "rb").read())
        maps = [(path, at, min(at + size, total), geojson._map(path, at, min(at + size, total))) for at in range(0, total, size)]
        plan, types = geojson._split_plan(maps)
        found, position = [], 0
        for file, begin, stop, inside, depth, first in plan:
            assert first == position
            own = [text for _, text in geojson._features(file, begin, stop, inside, depth)]
            found, position = found + own, position + len(own)
        assert [json.loads(t) for t in found] == features and types == [(path, True)]


def test_one_file_is_many_partitions(spark, tmp_path):
    path = tmp_path / "c.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [feature(i) for i in range(500)]}))
    rows = files.read_features(spark, str(path), PROPERTIES, split_bytes=4096)
    assert rows.rdd.getNumPartitions() > 10
    assert [r[0] for r in rows.orderBy("position").select("properties.TopazID").collect()] == list(range(500))
    odd = tmp_path / "d.geojson"
    odd.write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{}}, 7 ,null]}')
    assert files.collection_faults(spark, str(odd)).first().fault == "feature"


def shapes(spark):
    df = spark.createDataFrame(
        [(run, i, f'n"{i}' if i % 2 else None, None if i == 3 else json.dumps([[[[x + i / 3, y] for x, y in SQUARE[0]]]])) for run in ("a;;1", "b") for i in range(6)],
        "run string, k int, label string, coordinates string",
    )
    return df.select("run", "k", "label", G.multipolygon(F.lit("MultiPolygon"), F.col("coordinates")).alias("geometry"))


def test_feature_lines(spark, tmp_path):
    files.write_feature_lines(shapes(spark), str(tmp_path / "lines"), "k", ["label"], "geometry")
    lines = [json.loads(line) for name in glob.glob(f"{tmp_path}/lines/part-*") for line in open(name, encoding="utf-8")]
    assert len(lines) == 12 and all(f["type"] == "Feature" for f in lines)
    one = next(f for f in lines if f["id"] == 1)
    assert one["properties"] == {"label": 'n"1'} and one["geometry"]["coordinates"][0][0][1] == [1.333333, 0.0]
    assert next(f for f in lines if f["id"] == 3)["geometry"] is None and next(f for f in lines if f["id"] == 2)["properties"] == {"label": None}


def test_run_collections(spark, tmp_path):
    files.write_run_collections(shapes(spark), str(tmp_path / "runs"), "run", ["k"], "k", ["label"], "geometry")
    folders = sorted(glob.glob(f"{tmp_path}/runs/run=*"))
    assert len(folders) == 2
    for folder in folders:
        text = "".join(open(name, encoding="utf-8").read() for name in sorted(glob.glob(f"{folder}/part-*")))
        document = json.loads(text)
        assert document["type"] == "FeatureCollection" and [f["id"] for f in document["features"]] == list(range(6))


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", all'), (2, None)], "k int, text string")
    files.write_csv(df.coalesce(1), str(tmp_path / "csv"))
    raw = open(glob.glob(f"{tmp_path}/csv/part-*")[0]).read()
    assert raw.splitlines()[0] == '"k","text"' and '"say ""hi"", all"' in raw
    assert list(csv.reader(raw.splitlines()))[1:] == [["1", 'say "hi", all'], ["2", ""]]


def test_run_attributes(spark, tmp_path):
    df = spark.createDataFrame([("r1", 1, 5, 2.0), ("r2", 2, None, 3.0)], "runid string, topazid int, hillslope_area bigint, slope_scalar double")
    files.write_run_attributes(df, str(tmp_path / "hill"), ingest.HILLSLOPE_FIELDS)
    back = spark.read.parquet(str(tmp_path / "hill"))
    assert set(back.columns) == {"TopazID", "area", "slope_scalar", "runid"} and back.where("runid = 'r1'").first().area == 5
    again = ingest.typed_fields(ingest.resolve_column(back, ingest.KEY_SPELLINGS, "topazid"), ingest.HILLSLOPE_FIELDS, ["runid", "topazid"])
    assert sorted(tuple(r) for r in again.select("runid", "topazid", "hillslope_area").collect()) == [("r1", 1, 5), ("r2", 2, None)]


def test_scan_pushes_down(spark, tmp_path):
    path = str(tmp_path / "rap")
    spark.range(100).select(F.col("id").alias("topaz_id"), (F.col("id") % 5 + 2000).cast("int").alias("year"), F.lit(1.0).alias("value"), F.lit("x").alias("wide")).write.parquet(path)
    df = files.scan(spark, path, ["topaz_id", "value"], 2003)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(year,2003)" in plan and "ReadSchema: struct<topaz_id:bigint,year:int,value:double>" in plan
    assert df.count() == 20


def test_scenario_folders(spark, tmp_path):
    for folder in ("", "undisturbed/"):
        spark.createDataFrame([(1, folder or "base")], "wepp_id int, name string").write.parquet(f"{tmp_path}/{folder}loss.parquet")
    opener = parquet_opener(spark, str(tmp_path))
    assert opener("loss.parquet", None).first().name == "base" and opener("loss.parquet", "undisturbed").first().name == "undisturbed/"


def test_load_sources(spark):
    one = spark.createDataFrame([("batch;;b1;;X", 1), ("batch;;b1;;Y", 2)], "runid string, v int")
    two = spark.createDataFrame([("batch;;b2;;X", "w")], "runid string, extra string")
    alone = spark.createDataFrame([("solo",), ("other",)], "runid string")
    assert files.load_sources({"b1": one, "b2": two}, alone).groupBy("source").count().orderBy("source").collect() == [("b1", 2), ("b2", 1), ("standalone", 2)]
    wanted = spark.createDataFrame([("batch;;b1;;Y",), ("solo",), ("batch;;b9;;X",)], "runid string")
    assert sorted(r.runid for r in files.load_sources({"b1": one, "b2": two}, alone, wanted).collect()) == ["batch;;b1;;Y", "solo"]


def test_artifact_files(spark, tmp_path):
    import hashlib

    from headwater.plans.quality import verify_artifacts
    from headwater.sources import blobs

    for name, body in (("good", b"data"), ("page", b" <html>"), ("short", b"x")):
        (tmp_path / name).write_bytes(body)
    stored = blobs.digests(spark, str(tmp_path)).withColumn("path", F.element_at(F.split("path", "/"), -1))
    row = lambda name, body, uri="https://a.test/x", kind="application/json": (name, "metadata", uri, hashlib.sha256(body).hexdigest(), len(body), kind)
    lineage = spark.createDataFrame([
        row("good", b"data"), row("page", b" <html>"), row("short", b"longer"), row("gone", b""),
    ], "path string, role string, uri string, sha256 string, byte_size bigint, media_type string")
    assert {r.path: r.finding for r in verify_artifacts(stored, lineage).collect()} == {
        "good": "verified", "page": "artifact-not-html", "short": "size", "gone": "missing",
    }
