"""Operators against brute force and worked cases, skewed groups among them."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from headwater.functions.canonical import json_line
from headwater.operators import fingerprint as FP
from headwater.operators import identity, ingest, keys, query as Q, ranking, raster, rhessys, scenario, search, vegetation


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def brute_range(values, low, high):
    ordered = sorted(values)
    pick = lambda p: ordered[min(math.floor(len(ordered) * p), len(ordered) - 1)]
    return pick(low), pick(high)


@pytest.mark.parametrize("low,high", [(0.05, 0.95), (0.02, 0.98), (0.0, 1.0), (0.5, 0.51)])
def test_robust_range(spark, low, high):
    rng = random.Random(7)
    data = [("hot", rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e-6), rng.lognormvariate(0, 8), -rng.random()])) for _ in range(4000)]
    data += [("flat", 3.5)] * 50 + [("zero", 0.0), ("zero", -0.0), ("one", -7.25)] + [("ties", float(i % 3)) for i in range(100)]
    df = spark.createDataFrame(data + [("hot", float("nan")), ("hot", None)], "g string, v double")
    got = {r.g: (r.range_min, r.range_max) for r in ranking.robust_range(df, ["g"], "v", low, high).collect()}
    for name in ("hot", "flat", "zero", "one", "ties"):
        assert got[name] == brute_range([v for g, v in data if g == name], low, high), name


def test_robust_range_of_everything(spark):
    data = [float(i) for i in range(1000)]
    df = spark.createDataFrame([(v,) for v in data], "v double")
    row = ranking.robust_range(df, [], "v").first()
    assert (row.n, row.range_min, row.range_max) == (1000, *brute_range(data, 0.05, 0.95))


def test_robust_range_of_close_values(spark, monkeypatch):
    """A group with a third of the rows, all in one histogram cell, and neighbouring doubles."""
    plans, write = [], ranking.checkpoint

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(ranking, "checkpoint", noted)
    rng = random.Random(5)
    close = [1000 + rng.random() for _ in range(3000)]
    near, x = [], 1e300
    for _ in range(500):
        near.append(x)
        x = math.nextafter(x, math.inf)
    tiny = [i * 5e-324 for i in range(1, 300)]
    data = [("close", v) for v in close] + [("near", v) for v in near] + [("tiny", -v) for v in tiny] + [(f"g{i}", rng.gauss(0, 1)) for i in range(60) for _ in range(40)]
    df = spark.createDataFrame(data, "g string, v double")
    out = ranking.robust_range(df, ["g"], "v", 0.02, 0.98)
    got = {r.g: (r.n, r.range_min, r.range_max) for r in out.collect()}
    for name in ("close", "near", "tiny", "g7"):
        mine = [v for g, v in data if g == name]
        assert got[name] == (len(mine), *brute_range(mine, 0.02, 0.98)), name
    # No window is ordered by values, and what is shuffled first is counts.
    assert 2 <= len(plans) <= 1 + ranking.PASSES
    for plan in plans:
        lines = plan.splitlines()
        assert "Window" in plan and not any("_v#" in line for line in lines if "Window" in line)
        deepest = max((line for line in lines if " Exchange " in line), key=lambda line: line.index("Exchange"))
        below = lines[lines.index(deepest) + 1]
        assert "HashAggregate" in below and "partial_count" in below


def test_number_rows(spark):
    names = [f"run-{i:04d}" for i in random.Random(1).sample(range(5000), 900)]
    df = spark.createDataFrame([(n,) for n in names], "runid string").repartition(7)
    got = dict(rows(ranking.number_rows(df, "runid")))
    assert got == {n: i for i, n in enumerate(sorted(names), start=1)}
    children = spark.range(1, 3001).withColumnRenamed("id", "series")
    dealt = ranking.assign_round_robin(df, "runid", children, "series").groupBy("runid").count()
    assert dealt.agg(F.count("count"), F.min("count"), F.max("count")).first()[:] == (900, 3, 4)


def test_strictly_increasing(spark):
    rng = random.Random(3)
    data, expected = [], {}
    for group in range(6):
        at, key, previous, breaks, nulls = 0, 0, None, 0, 0
        for _ in range(200 if group else 2000):
            at += rng.randint(1, 40)
            key += rng.choice([1, 2, 3]) if rng.random() > 0.05 else rng.choice([0, -2])
            value = None if rng.random() < 0.03 else key
            data.append((group, at, value))
            if value is None:
                nulls += 1
            else:
                breaks += previous is not None and value <= previous
                previous = value
        expected[group] = (nulls, breaks)
    df = spark.createDataFrame(data, "g int, at long, k long").repartition(5)
    for span in (16, 65_536):
        got = {r.g: (r.null_keys, r.breaks) for r in keys.strictly_increasing(df, "g", "at", "k", span).collect()}
        assert got == expected


def test_sequence_digest(spark):
    data = [(g, k, f"text {k * g}") for g, n in ((1, 5), (2, 37), (3, 400)) for k in range(n)]
    df = spark.createDataFrame(data, "g int, k long, t string").repartition(6)
    line = json_line({"k": F.col("k").cast("string"), "t": F.col("t")})
    header = '{"fingerprint_version":"1","subject":"demo"}\n'

    def brute(rows):
        hashes = [hashlib.sha256(f'{k}\n{{"k":"{k}","t":"{t}"}}\n'.encode()).hexdigest() for k, t in rows]
        figures = [len(rows), *[sum(int(h[at : at + 15], 16) for h in hashes) for at in (0, 15, 30, 45)]]
        return hashlib.sha256((header + "".join(f"{n}\n" for n in figures)).encode()).hexdigest()

    got = {r.g: (r.rows, r.digest) for r in FP.sequence_digest(df, ["g"], ["k"], line, "demo").collect()}
    for group in (1, 2, 3):
        mine = [(k, t) for g, k, t in data if g == group]
        assert got[group] == (len(mine), brute(mine))
    total = FP.sequence_digest(df.where("g = 2"), [], ["k"], line, "demo").first()
    assert (total.rows, total.digest) == got[2]
    # Two texts change places: same lines but for their keys, another digest.
    swapped = df.withColumn("t", F.when(F.col("k") == 1, "text 4").when(F.col("k") == 2, "text 2").otherwise(F.col("t")))
    assert FP.sequence_digest(swapped.where("g = 2"), [], ["k"], line, "demo").first().digest != got[2][1]
    none = FP.sequence_digest(df.where("g = 9"), [], ["k"], line, "demo").select("digest", FP.empty_digest("demo").alias("empty")).first()
    assert none.digest == none.empty == brute([])


def test_table_fingerprint_ignores_order(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).alias("v"), F.when(F.col("id") > 50, "x").alias("n"))
    one = FP.table_fingerprint(df, "t").first()
    two = FP.table_fingerprint(df.orderBy(F.desc("id")).repartition(3), "t").first()
    three = FP.table_fingerprint(df.withColumn("v", F.when(F.col("id") == 3, 99).otherwise(F.col("v"))), "t").first()
    assert one == two and one.fingerprint != three.fingerprint
    assert FP.table_fingerprint(df.limit(0), "t").first().fingerprint == hashlib.md5(b"0:0").hexdigest()


def test_filters():
    assert Q.band_filter(5) == {"column": "rap.band", "operator": "=", "value": 5}
    assert Q.band_filter([0, 5, 6, 9])["value"] == [5, 6]
    with pytest.raises(ValueError):
        Q.band_filter([0, 7])
    with pytest.raises(ValueError):
        Q.hillslope_filter(-1)
    assert Q.year_filter(999) == [] and Q.year_filter(None) == [] and Q.year_filter(2020.5) == []
    assert [f["value"] for y in (1900, 2100) for f in Q.year_filter(y)] == [1900, 2100]


def test_query_spec(spark):
    tables = {
        "loss": spark.createDataFrame([(2, 1.5), (1, 2.5), (3, 0.5)], "wepp_id int, `Runoff Volume` double"),
    }
    spec = {
        "datasets": [{"alias": "loss", "path": "loss"}], "columns": ["loss.wepp_id AS wepp_id", "loss.`Runoff Volume` AS runoff"],
        "filters": [{"column": "loss.wepp_id", "operator": "IN", "value": [1, 2]}], "order_by": ["loss.wepp_id"], "limit": 5,
    }
    assert [tuple(r) for r in Q.run_query(spec, lambda p, s: tables[p]).collect()] == [(1, 2.5), (2, 1.5)]


def test_requests(spark):
    documents = [
        {"kind": "choropleth", "scenario": "S1", "variable": "flow", "spatial_scale": "patch", "year": 2000},
        {"kind": "choropleth", "scenario": "S1", "variable": "flow", "spatial_scale": "patch", "year": None},
        {"kind": "time-series", "scenario": "S1", "variable": "flow", "spatial_scale": "hillslope", "year": True},
        {"kind": "map", "scenario": "S1", "variable": "flow", "spatial_scale": "patch", "year": 2000}, {"kind": "choropleth"}, "text",
        {"kind": "time-series", "scenario": "S1", "variable": "flow", "spatial_scale": "hillslope", "year": 3001},
        {"kind": "time-series", "scenario": "S1", "variable": "flow", "spatial_scale": "hillslope", "year": None},
    ]
    df = spark.createDataFrame(
        [{"request_id": i, **Q.parse_request(d)} for i, d in enumerate(documents)],
        "request_id int, kind string, scenario string, variable string, spatial_scale string, year string, fields array<string>",
    )
    catalogue = spark.createDataFrame(
        [("p", "S1", "patch", ["flow", "et"], 1990, 2010), ("b", "S1", "basin", ["flow"], 1990, 2010), ("b2", "S1", "basin", ["flow"], 1990, 2010)],
        "dataset_key string, scenario string, role string, variables array<string>, first_year int, last_year int",
    )
    got = {r.request_id: (r.violation, r.dataset_key) for r in Q.resolve_requests(Q.check_requests(df), catalogue).collect()}
    assert [got[i] for i in range(8)] == [
        (None, "p"), ("year-required", None), ("year", None), ("kind", None), ("shape", None), ("shape", None), ("year", None), ("dataset", None),
    ]


def test_cover(spark):
    rap = spark.createDataFrame(
        [(1, 2000, 5, 10.0), (2, 2000, 5, 30.0), (1, 2000, 6, 4.0), (1, 2001, 6, 8.0), (9, 2000, 5, 99.0), (1, 2000, 1, 50.0)],
        "topaz_id int, year int, band int, value double",
    )
    hill = spark.createDataFrame([(1, 11, 1.0), (2, 11, 3.0)], "topaz_id int, wepp_id int, area double")
    assert rows(vegetation.cover_by_year(rap, hill)) == [(2000, 25.0, 4.0, 29.0), (2001, 0.0, 8.0, 8.0)]
    assert rows(vegetation.choropleth(rap, hill, [5, 6], 2000)) == [(11, 29.0, 25.0, 4.0)]
    assert rows(vegetation.choropleth(rap, hill, 6)) == [(11, 6.0)]
    series = vegetation.one_hillslope_series(rap, 1).collect()
    assert len(series) == 38 and (series[14].year, series[14].shrub, series[14].tree, series[14].coverage) == (2000, 10, 4, 14)
    assert sum(r.coverage for r in series) == 22


def test_chart_fill(spark):
    df = spark.createDataFrame([(1, 2000, 0, 1.0), (1, 2000, 1, 2.0), (1, 1980, 2, 3.0)], "k int, year int, pos int, coverage double").select(
        "*", F.lit(None).cast("double").alias("shrub"), F.col("coverage").alias("tree"))
    every = {r.year: r.coverage for r in vegetation.chart_fill(df, ["k"], "pos").collect()}
    assert len(every) == 39 and every[2000] == 2.0 and every[1980] == 3.0 and every[1990] == 0.0
    assert rows(vegetation.chart_fill(df, ["k"], "pos", 2000)) == [(1, 2000, 1.0, 0.0, 1.0)]
    assert rows(vegetation.chart_fill(df, ["k"], "pos", 2005)) == [(1, 2005, 0.0, 0.0, 0.0)]


def test_rhessys_mean(spark):
    df = spark.createDataFrame(
        [(2000, 1, 1, 2.0), (2000, 2, 1, 4.0), (2001, 1, 2, 8.0), (2000, 1, None, 5.0), (2000, 3, 1, float("nan")), (2000, 3, 3, float("nan"))],
        "year int, month int, hillID int, flow double",
    )
    assert rows(rhessys.choropleth(df, "hillID", "flow", 2000)) == [(1, 3.0)]
    monthly = {(r.year, r.month): (r.value, r.label) for r in rhessys.time_series(df, "flow").collect()}
    assert monthly[(2000, 1)] == (3.5, "2000-01") and monthly[(2000, 3)][0] is None
    assert [(r.year, r.month, r.label) for r in rhessys.time_series(df, "flow", yearly=True, year=2001).collect()] == [(2001, 0, "2001")]


def test_scenario_summary(spark):
    area, flow, loss = (scenario.SUMMARY_KEYS[k] for k in ("area", "discharge", "hillslope_loss"))
    df = spark.createDataFrame([
        ("wildfire", area, "100", 0), ("wildfire", flow, "not-a-number", 1), ("wildfire", flow, "5000", 2), ("wildfire", loss, "50", 3), ("wildfire", loss, "NaN", 4),
        ("thinning_40_75", flow, "5", 5), ("empty", area, "NaN", 6), ("flat", area, "0", 7), ("flat", loss, "3", 8),
    ], "scenario string, key string, value string, pos int")
    got = {r.scenario: r for r in scenario.summary(df, "pos").collect()}
    assert set(got) == {"wildfire", "thinning_40_75", "flat"}
    assert (got["wildfire"].water_discharge, got["wildfire"].hillslope_soil_loss, got["wildfire"].hillslope_soil_loss_tonnes) == (5.0, 0.5, 50.0)
    assert got["thinning_40_75"].label == "Thinning 40-75" and got["thinning_40_75"].water_discharge is None
    assert got["flat"].hillslope_soil_loss is None and got["flat"].hillslope_soil_loss_tonnes == 3.0
    assert scenario.scenario_folder("wildfire") is None and scenario.scenario_folder("undisturbed") == "undisturbed"


def test_search(spark):
    index = spark.createDataFrame([
        ("run-1", "1701", "Mill Creek", "Walla Walla"), ("run-2", "1702", "Creek Mill", "mill creek"), ("mill creek", "1", "Zed", None),
        ("run-4", "9", "Mill Creek North", ""), ("run-5", "9", "Old mill creek", ""), ("run-6", "9", "Other", "creek by the mill"), ("run-7", "9", "None", None),
    ], "id string, huc string, name string, source_name string")
    got = [(r.id, r.match_field, r.score) for r in search.ranked_search(index, "  MILL Creek ").collect()]
    assert got == [
        ("mill creek", "id", 0), ("run-2", "source_name", 1), ("run-1", "name", 1), ("run-4", "name", 2), ("run-5", "name", 3), ("run-6", "source_name", 4),
    ]
    assert search.ranked_search(index, "   ").count() == 0


def test_harmonise_and_types(spark):
    df = spark.createDataFrame([("a", None, "x"), (None, "b", "y")], "PWS_Name_2 string, PWS_Name string, name string")
    got = ingest.harmonise(df, {"pws_name": ["PWS_Name_2", "PWS_Name"], "srcname": ["SrcName", "name"], "state": ["State"]})
    assert rows(got.fillna("-")) == [("a", "x", "-"), ("b", "y", "-")]
    raw = spark.createDataFrame([("1.9", "2"), ("x", "inf"), (None, None)], "area string, slope_scalar string")
    fields = [f for f in ingest.HILLSLOPE_FIELDS if f[0] in ("hillslope_area", "slope_scalar")]
    tolerant = ingest.typed_fields(raw, fields, []).select("hillslope_area", "slope_scalar").collect()
    assert [tuple(r) for r in tolerant] == [(1, 2.0), (None, math.inf), (None, None)]
    strict = ingest.typed_fields(raw, fields, [], strict=True).collect()
    assert [sorted(r.rejected) for r in strict] == [[], ["hillslope_area", "slope_scalar"], []]
    assert ingest.resolve_column(spark.range(1).withColumnRenamed("id", "TOPAZID"), ingest.KEY_SPELLINGS, "topazid").columns == ["topazid"]
    with pytest.raises(ValueError):
        ingest.resolve_column(spark.range(1), ingest.KEY_SPELLINGS, "topazid")


def test_merge_polygons_keeps_order(spark):
    piece = lambda n: [[{"x": float(n), "y": 0.0}]]
    df = spark.createDataFrame(
        [(1, 2, "later", [piece(2)]), (1, 1, "first", [piece(1)]), (2, 3, "only", [piece(3)])],
        "topazid int, pos int, name string, geometry array<array<array<struct<x:double,y:double>>>>",
    )
    got = {r.topazid: r for r in ingest.merge_polygons(df, ["topazid"], "pos").collect()}
    assert [p[0][0].x for p in got[1].geometry] == [1.0, 2.0] and got[1].name == "first" and got[2].merged_features == 1
    strict = ingest.merge_polygons(df, ["topazid"], "pos", strict=True)
    assert rows(strict.select("topazid", "repeated_key")) == [(1, True), (1, True), (2, False)]


def test_burn_palette(spark):
    legacy = {r.class_value: (r.label, r.hex) for r in raster.burn_palette(spark).collect()}
    assert legacy == {130: ("Unburned", "#00734A"), 131: ("Low", "#4DE600"), 132: ("Moderate", "#FFFF00"), 133: ("High", "#FF0000")}
    assert [r.hex for r in raster.burn_palette(spark, "shift").orderBy("pixel").collect()] == ["#009E73", "#56B4E9", "#F0E442", "#CC79A7"]


def test_flat_rasters(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", 5.0), ("c", 0.0), ("m", -2.0), ("m", 1.0)], "raster_id string, value double")
    change = F.col("raster_id") != "a"
    ranges = raster.value_ranges(df, ["raster_id"], change)
    got = {(r.raster_id, r.value): r.level for r in raster.rescale(df, ranges, ["raster_id"]).collect()}
    assert got[("a", 5.0)] == 0.0 and got[("c", 0.0)] == pytest.approx(127.5) and got[("m", -2.0)] == 0.0
    assert got[("m", 1.0)] == pytest.approx(255 * 0.75)


def test_alias_resolution(spark):
    aliases = spark.createDataFrame([("old", "i1", False), ("new", "i1", True), ("gone", "i2", False)], "runid string, identity_id string, is_current boolean")
    identities = spark.createDataFrame([("i1", "active"), ("i2", "retired")], "identity_id string, status string")
    watersheds = spark.createDataFrame([("new", "i1"), ("plain", None)], "runid string, logical_id string")
    requests = spark.createDataFrame([("old",), ("new",), ("gone",), ("plain",), ("none",), ("old",)], "runid string")
    got = {r.runid: (r.requests, r.watershed, r.status) for r in identity.resolve_runs(requests, aliases, identities, watersheds).collect()}
    assert got == {
        "old": (2, "new", "found"), "new": (1, "new", "found"), "gone": (1, None, "gone"), "plain": (1, "plain", "found"), "none": (1, None, "not found"),
    }


def test_join_large_parents(spark):
    """Hot keys are repeated, others and missing ones are joined once."""
    children = [(1, i) for i in range(500)] + [(i % 40 + 2, 1000 + i) for i in range(300)] + [(None, 9000), (99, 9001)]
    parents = [(i, f"p{i}") for i in range(1, 60)] + [(None, "none")]
    left, right = spark.createDataFrame(children, "k int, c int"), spark.createDataFrame(parents, "k int, name string")
    plain = sorted(map(str, left.join(right, "k", "left").collect()))
    joined = keys.join_large_parents(left, right, ["k"], ["c"])
    assert sorted(map(str, joined.select("k", "c", "name").collect())) == plain
    assert keys.join_large_parents(left.limit(0), right, ["k"], ["c"]).count() == 0
    plain = keys.join_large_parents(left.where("k > 1"), right, ["k"], ["c"], "inner")
    assert plain.count() == 300


def test_large_parents_are_not_broadcast(spark):
    children = spark.createDataFrame([("hot", i) for i in range(400)] + [(None, i) for i in range(40)] + [(f"k{i}", i) for i in range(9)], "k string, n int")
    parents = spark.createDataFrame([("hot", 1), ("k1", 2), (None, 3), ("x", 4)], "k string, p int")
    joined = keys.join_large_parents(children, parents, ["k"], ["n"])
    plan = joined._jdf.queryExecution().optimizedPlan().toString() + joined._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [k" in plan and "strategy=merge" in plan
    got = {(r.k, r.p): 0 for r in joined.collect()}
    assert joined.count() == 449 and {k for k in got if k[1]} == {("hot", 1), ("k1", 2)}
    assert keys.join_large_parents(children, parents, ["k"], ["n"], "inner").count() == 401


def test_propagated_identities_hold_no_broadcast_of_parents(spark):
    children = spark.range(1000).selectExpr("cast(id % 7 as string) watershed_id", "'own' logical_id", "id weppid")
    watersheds = spark.range(3).selectExpr("cast(id as string) runid", "concat('w-', id) logical_id")
    found = identity.propagate_identity(children, watersheds)
    assert found._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin [watershed_id") == 1
    assert {(r.watershed_id, r.logical_id) for r in found.collect()} == {(str(i), f"w-{i}" if i < 3 else "own") for i in range(7)}


def test_years_of_the_spine_are_not_grouped(spark):
    rap = spark.createDataFrame([(1, 1990, 5, 2.0), (1, 1990, 6, 3.0), (2, 1950, 5, 1.0), (None, 2023, 6, 4.0), (3, 1990, 1, 9.0)], "topaz_id int, year int, band int, value double")
    series = vegetation.hillslope_series(rap)
    plan = series._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Union")]  # nothing groups the blank years
    rows = {(r.topaz_id, r.year): (r.shrub, r.tree, r.coverage) for r in series.collect()}
    assert len(rows) == series.count() == 3 * 38 and rows[(1, 1990)] == (2.0, 3.0, 5.0) and rows[(None, 2023)] == (0.0, 4.0, 4.0)
    assert sum(v[2] for v in rows.values()) == 9.0


def test_map_styles_keep_hillslopes_and_years_without_values(spark, tmp_path):
    from headwater.catalog import QUERIES

    spark.sql("SELECT 1L l_partkey, timestamp_ntz'1999-05-05' l_shipdate, 'A' l_returnflag, 3.0D l_quantity UNION ALL SELECT 9L, timestamp_ntz'2005-05-05', 'N', 1.0D").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("SELECT 1L p_partkey, 11 p_size, 2.0D p_retailprice UNION ALL SELECT 2L, 12, 1.0D").write.parquet(f"{tmp_path}/part.parquet")
    got = {(r.wepp_id, r.year): r for r in QUERIES["choropleth_style"](spark, str(tmp_path)).collect()}
    assert set(got) == {(w, y) for w in (11, 12) for y in [*range(1994, 2002), 2005]}
    assert got[(11, 1999)].value == 3.0 and got[(12, 1999)].value is None and (got[(12, 1994)].range_min, got[(12, 1994)].range_max) == (0.0, 1.0)
