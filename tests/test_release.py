"""Release planning, applying and checking; identity changes; document digests."""

import json

import pytest
from pyspark.sql import functions as F

from headwater.operators import identity, keys, subjects
from headwater.plans import operations, release

FIELDS = (
    "watershed_key string, collection string, runid string, run_fingerprint string, metadata_fingerprint string, geometry_fingerprint string,"
    "subcatchment_fingerprint string, channel_fingerprint string, hillslope_fingerprint string, soil_fingerprint string, landuse_fingerprint string,"
    "capability_fingerprint string, actual_watersheds int, actual_subcatchments int, actual_channels int"
)


def state(key, run=None, fp="f", meta="m", geom="g", cap=None, subs=4, chans=2):
    return (key, "c", run or f"run-{key}", fp, meta, geom, "s", "c", "h", "so", "l", cap, 1, subs, chans)


def states(spark, *items):
    return spark.createDataFrame(list(items), FIELDS)


def by_key(df):
    return {r.watershed_key: r for r in df.collect()}


@pytest.fixture(scope="module")
def pair(spark):
    base = states(spark, state("alpha"), state("beta", cap="k1"), state("same"), state("old", cap="k"))
    target = states(
        spark, state("alpha", fp="f2", meta="m2"), state("beta", run="run-beta-2", fp="f3", geom="g2", cap="k2"), state("gamma"),
        state("same"),
    )
    return base, target


def test_forward_plan(pair):
    plan = by_key(release.plan_forward(*pair))
    assert {k: r.operation for k, r in plan.items()} == {"alpha": "change", "beta": "change", "gamma": "add", "same": "retain", "old": "remove"}
    assert plan["alpha"].change_channels == ["metadata"] and plan["beta"].change_channels == ["identity", "geometry", "capability"]
    assert plan["gamma"].change_channels == ["identity", "metadata", "geometry", "children"] and plan["old"].change_channels[-1] == "capability"
    assert (plan["gamma"].delta_watersheds, plan["old"].delta_subcatchments, plan["same"].delta_channels) == (1, -4, 0)
    assert not any(r.disagrees for r in plan.values())


def test_unexplained_fingerprints(spark):
    plan = by_key(release.plan_forward(states(spark, state("a"), state("b")), states(spark, state("a", fp="x"), state("b", meta="m2"))))
    assert plan["a"].change_channels == ["identity"] and not plan["a"].disagrees
    assert plan["b"].disagrees


def test_inverse_is_the_mirror(pair):
    plan = release.plan_forward(*pair)
    inverse = release.plan_inverse(plan)
    assert by_key(release.plan_inverse(inverse)) == by_key(plan)
    assert all(r.broken == 0 for r in release.inverse_violations(plan, inverse).collect())
    back = by_key(release.plan_forward(pair[1], pair[0]))
    assert {k: (r.operation, r.change_channels, r.delta_channels) for k, r in by_key(inverse).items()} == {
        k: (r.operation, r.change_channels, r.delta_channels) for k, r in back.items()
    }


def test_removal_guard(spark):
    base = states(spark, *[state(f"k{i:03d}") for i in range(100)])
    keep = lambda n: base.where(F.col("watershed_key") >= f"k{n:03d}")
    allowed = lambda n, ok=False: release.plan_totals(release.plan_forward(base, keep(n)), ok).first().allowed
    assert allowed(5) and not allowed(6) and allowed(50, True)
    small = states(spark, *[state(f"k{i}") for i in range(10)])
    assert not release.plan_totals(release.plan_forward(small, small.where("watershed_key > 'k1'"))).first().allowed
    assert release.plan_totals(release.plan_empty_build(small)).first().delta_subcatchments == 40


def test_apply_then_replan(spark, pair):
    base, target = pair
    plan = release.plan_forward(base, target)
    serving = base.select("watershed_key", "runid", "metadata_fingerprint", "geometry_fingerprint")
    new = by_key(release.apply_to_watersheds(serving, target, plan, ["metadata_fingerprint"], ["geometry_fingerprint"]))
    assert set(new) == {"alpha", "beta", "gamma", "same"}
    assert new["beta"].runid == "run-beta-2" and new["alpha"].metadata_fingerprint == "m2"
    # The rewritten table is what the target describes, so a second plan has nothing to do.
    after = release.apply_to_watersheds(serving, target, plan, ["metadata_fingerprint"], ["geometry_fingerprint"])
    fields = ["runid", "metadata_fingerprint", "geometry_fingerprint"]
    assert {r.status for r in release.ledger_check(after, target, "watershed_key", fields).collect()} == {"equal"}

    children = spark.createDataFrame([(k, f"run-{k}", i) for k in ("alpha", "beta", "old") for i in (1, 2)], "watershed_key string, watershed_id string, topazid int")
    staged = spark.createDataFrame([("gamma", "run-gamma", 7), ("alpha", "run-alpha", 9)], children.schema)
    got = sorted(tuple(r) for r in release.apply_to_children(children, staged, plan).collect())
    assert got == [("alpha", "run-alpha", 1), ("alpha", "run-alpha", 2), ("beta", "run-beta-2", 1), ("beta", "run-beta-2", 2), ("gamma", "run-gamma", 7)]

    identities = spark.createDataFrame([("alpha", "active"), ("old", "active"), ("other", "retired")], "watershed_key string, status string")
    assert {r.watershed_key: r.status for r in release.apply_to_identities(identities, plan).collect()} == {"alpha": "active", "old": "retired", "other": "retired"}
    aliases = spark.createDataFrame([("run-beta", "beta", True), ("run-old", "old", True), ("x", "other", True)], "runid string, identity_id string, is_current boolean")
    current = {r.runid: r.is_current for r in release.apply_to_aliases(aliases, plan).collect()}
    assert (current["run-beta"], current["run-beta-2"], current["run-old"], current["x"], current["run-gamma"]) == (False, True, False, True, True)


def test_child_merge(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(2, "b"), (3, "x"), (4, "d")], "k int, v string")
    merged = release.merge_children(old, new, ["k"], ["v"])
    assert sorted(tuple(r) for r in merged.collect()) == [
        (1, "a", "deleted", False), (2, "b", "updated", False), (3, "x", "updated", True), (4, "d", "created", False),
    ]
    assert tuple(release.merge_counts(merged).first()) == (1, 2, 1, 1)


def test_version_folders(spark, tmp_path):
    df = spark.range(3)
    release.write_version({"watersheds": df}, str(tmp_path), "2026-07-17.1")
    release.activate(spark, str(tmp_path), "2026-07-17.1", "0" * 64)
    pointer = spark.read.parquet(f"{tmp_path}/active").first()
    assert spark.read.parquet(f"{tmp_path}/release={pointer.release_id}/watersheds").count() == 3


def test_derived_values(spark):
    df = spark.createDataFrame([(1, {"a": "x", "n": "4"}), (2, {"zz": "1", "b": "y"})], "k int, attributes map<string,string>")
    got = [tuple(r) for r in release.derived_values(df, "attributes", {"a": "string", "n": "int"}).orderBy("k").collect()]
    assert got == [(1, "x", 4, []), (2, None, None, ["b", "zz"])]


# --- identity changes ----------------------------------------------------------------------

SIDE = (
    "struct<watershed_keys:array<string>,collection_keys:array<string>,runids:array<string>,display_names:array<string>,aliases:array<string>,"
    "tombstones:array<string>,metadata_fingerprint:string,geometry_fingerprint:string,child_fingerprint:string>"
)


def side(keys=("w",), runs=("r",), names=("W",), aliases=(), tombs=(), meta="m", geom="g", child="c", colls=("col",)):
    return (list(keys), list(colls), list(runs), list(names), list(aliases), list(tombs), meta, geom, child)


NOTHING = side((), (), (), colls=(), meta="none", geom="none", child="none")
CASES = [
    ("retained", side(), side(), False, None, ("accept", "retained")),
    ("renamed", side(), side(names=("W2",), meta="m2"), False, None, ("accept", "renamed")),
    ("replaced", side(), side(runs=("r2",), aliases=("r",), meta="m2", geom="g2", child="c2"), True, None, ("accept", "replaced")),
    ("moved", side(), side(colls=("other",), runs=("r2",), aliases=("r",)), True, None, ("accept", "moved")),
    ("split", side(), side(("w-a", "w-b"), ("a", "b"), ("A", "B"), ("r",), ("w",), "x", "y", "z"), True, None, ("accept", "split")),
    ("merged", side(("a", "b"), ("ra", "rb"), ("A", "B")), side(("w",), ("r",), ("W",), ("ra", "rb"), ("a", "b")), True, None, ("accept", "merged")),
    ("metadata_only", side(), side(meta="m2"), False, None, ("accept", "metadata_only")),
    ("geometry_only", side(), side(geom="g2"), False, None, ("accept", "geometry_only")),
    ("removed", side(), side((), (), (), ("r",), ("w",), "none", "none", "none", ()), True, None, ("accept", "removed")),
    ("unresolved", side(), side(runs=("r9",), meta="m2"), False, "ambiguous-identity", ("reject", "ambiguous-identity")),
    ("unresolved", side(), side(meta="m2"), False, "metadata-authority-conflict", ("reject", "metadata-authority-conflict")),
    ("unresolved", side((), (), (), tombs=("w",), colls=()), side(tombs=("w",)), False, "tombstoned-key-reuse", ("reject", "tombstoned-key-reuse")),
    ("replaced", side(), side(runs=("r2",), aliases=("r",)), False, None, ("invalid", "rule")),
    ("split", side(), side(("w", "w-b"), tombs=("w",)), True, None, ("invalid", "rule")),
    ("retained", side(keys=("Bad Key",)), side(keys=("Bad Key",)), False, None, ("invalid", "state")),
    ("retained", side(runs=("r", "r")), side(runs=("r", "r")), False, None, ("invalid", "state")),
    ("geometry_only", side(), side(geom="g2", child="c2"), False, None, ("invalid", "rule")),
    ("unresolved", side(), side(), False, "ambiguous-identity", ("invalid", "conflict")),
]


def test_identity_changes(spark):
    data = [(i, kind, before, after, reviewed, code) for i, (kind, before, after, reviewed, code, _) in enumerate(CASES)]
    df = spark.createDataFrame(data, f"i int, kind string, before {SIDE}, after {SIDE}, reviewed boolean, conflict_code string")
    got = {r.i: (r.decision, r.code) for r in identity.classify_changes(df).collect()}
    assert got == {i: case[-1] for i, case in enumerate(CASES)}


# --- document digests ------------------------------------------------------------------------

# Fixed values, in full: five documents and the digests their canonical subjects must have.
DOCUMENTS = {"artifact": {"uri": "https://artifacts.example.test/releases/example/artifact.json",
              "sha256": "1111111111111111111111111111111111111111111111111111111111111111",
              "bytes": 128,
              "media_type": "application/json",
              "verified": True},
 "run": {"collection_key": "example-collection",
         "watershed_key": "example-north",
         "runid": "illustrative/north",
         "display_name": "Example North",
         "aliases": ["legacy/example-north", "old/example-north"],
         "artifact_fingerprints": {"metadata": "1010101010101010101010101010101010101010101010101010101010101010",
                                   "boundary": "1111111111111111111111111111111111111111111111111111111111111111",
                                   "subcatchments": "1212121212121212121212121212121212121212121212121212121212121212",
                                   "channels": "1313131313131313131313131313131313131313131313131313131313131313",
                                   "hillslopes": "1414141414141414141414141414141414141414141414141414141414141414",
                                   "soils": "1515151515151515151515151515151515151515151515151515151515151515",
                                   "landuse": "1616161616161616161616161616161616161616161616161616161616161616"},
         "transformation_lineage_fingerprint": "1717171717171717171717171717171717171717171717171717171717171717",
         "rhessys_index_fingerprint": "1818181818181818181818181818181818181818181818181818181818181818",
         "expected": {"watersheds": 1, "subcatchments": 4, "channels": 3, "bounds": [-117.2, 46.1, -116.8, 46.4]},
         "capability_fingerprint": "4962ff8964a66b17870c798d97608393aa523572512eb8d82f4f18720197ad75"},
 "capability": {"schema_version": 1,
                "collection_key": "example-collection",
                "watershed_key": "example-north",
                "runid": "illustrative/north",
                "mode": "both",
                "durable_base_uri": "https://artifacts.example.test/rhessys/example-north/",
                "geometry_revision": "8888888888888888888888888888888888888888888888888888888888888888",
                "scenarios": [{"key": "burned", "variables": ["streamflow"]}],
                "spatial_inputs": [{"role": "worldfile",
                                    "artifact": {"uri": "https://artifacts.example.test/rhessys/example-north/worldfile.txt",
                                                 "sha256": "9999999999999999999999999999999999999999999999999999999999999999",
                                                 "bytes": 256,
                                                 "media_type": "text/plain",
                                                 "verified": True},
                                    "required_for_activation": True}],
                "parquets": [{"role": "basin",
                              "artifact": {"uri": "https://artifacts.example.test/rhessys/example-north/basin.parquet",
                                           "sha256": "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
                                           "bytes": 8192,
                                           "media_type": "application/vnd.apache.parquet",
                                           "verified": True},
                              "spatial_id_field": "basin_id",
                              "columns": [{"name": "basin_id", "physical_type": "INT64"},
                                          {"name": "year", "physical_type": "INT32"},
                                          {"name": "streamflow", "physical_type": "DOUBLE"}],
                              "variables": [{"name": "streamflow", "units": "mm"}],
                              "year_range": [1980, 2020],
                              "required_for_activation": True}],
                "geotiffs": [{"artifact": {"uri": "https://artifacts.example.test/rhessys/example-north/burned-precip.tif",
                                           "sha256": "bbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbb",
                                           "bytes": 16384,
                                           "media_type": "image/tiff",
                                           "verified": True},
                              "scenario": "burned",
                              "variable": "streamflow",
                              "crs": "EPSG:4326",
                              "bounds": [-117.2, 46.1, -116.8, 46.4],
                              "dimensions": [512, 512],
                              "bands": 1,
                              "nodata": -9999,
                              "required_for_activation": False}]},
 "watershed-domain": {"runs": [{"collection_key": "example-collection",
                                "watershed_key": "example-south",
                                "runid": "illustrative/south",
                                "run_fingerprint": "9191919191919191919191919191919191919191919191919191919191919191",
                                "capability_fingerprint": None},
                               {"collection_key": "example-collection",
                                "watershed_key": "example-north",
                                "runid": "illustrative/north",
                                "run_fingerprint": "325146e772f8c2f5ed0ae749b5fa40c9d8ead914376b0bac71335f7626376184",
                                "capability_fingerprint": "4962ff8964a66b17870c798d97608393aa523572512eb8d82f4f18720197ad75"}]},
 "release": {"schema_version": 1,
             "release_id": "2026-07-17.1",
             "created_at": "2026-07-17T16:05:00Z",
             "compatibility": {"schema_version": 1,
                               "data_contract": 1,
                               "identity_contract": 1,
                               "artifact_contract": 1,
                               "supported_migrations": {"minimum": "watershed.0001_initial", "maximum": "watershed.0006_watershed_utility_metadata"},
                               "materializer": {"image_digest": "sha256:2222222222222222222222222222222222222222222222222222222222222222",
                                                "git_commit": "3333333333333333333333333333333333333333"},
                               "toolchain": {"postgres": "16.3", "postgis": "3.4.2", "gdal": "3.8.5"}},
             "collections": [{"collection_key": "example-collection",
                              "display_name": "Illustrative Collection",
                              "source": {"kind": "batch",
                                         "source_revision": "illustrative-2026-07-17",
                                         "authentication": {"secret_ref": "EXAMPLE_RELEASE_TOKEN"}},
                              "member_index": {"uri": "https://artifacts.example.test/releases/2026-07-17.1/example-collection.json",
                                               "sha256": "3030303030303030303030303030303030303030303030303030303030303030",
                                               "bytes": 4096,
                                               "media_type": "application/json",
                                               "verified": True},
                              "expected_member_count": 2,
                              "watershed_keys": ["example-north", "example-south"]}],
             "expected_removals": [{"watershed_key": "retired-example",
                                    "reason": "Illustrative exact removal proving wildcard-free syntax.",
                                    "aliases": ["legacy/retired-example"]}],
             "lineage": [{"event_key": "retire-old-example",
                          "kind": "removal",
                          "predecessors": ["retired-example"],
                          "successors": [],
                          "reviewed": True}]}}
GOLDEN = {
    "artifact": "bd6c0af1d71b05e2edaf8d7f01cd8b7d76b2bfaff44d22c028942c6995d1828a",
    "run": "325146e772f8c2f5ed0ae749b5fa40c9d8ead914376b0bac71335f7626376184",
    "capability": "4962ff8964a66b17870c798d97608393aa523572512eb8d82f4f18720197ad75",
    "watershed-domain": "10b66efdb137a15607f5fd3e87bfa95e4366b32b8efc98b8696b3a516031f7fd",
    "release": "d0329e66195abce8c56ed050dea1cc9e4809ac42025fcdebb4496711ea777f59",
}


def reordered(value):
    """Lists turned round, except where their order carries meaning."""
    if isinstance(value, dict):
        return {k: v if k in ("bounds", "year_range", "dimensions") else reordered(v) for k, v in reversed(list(value.items()))}
    return [reordered(v) for v in reversed(value)] if isinstance(value, list) else value


@pytest.mark.parametrize("subject", sorted(GOLDEN))
def test_golden_digests(spark, subject):
    plain = DOCUMENTS[subject]
    changed = json.loads(json.dumps(plain).replace("example-north", "example-nord").replace('"bytes": 128', '"bytes": 129'))
    moved = reordered(json.loads(json.dumps(plain).replace("https://artifacts.example.test/releases", "https://mirror.example.test")))
    df = spark.createDataFrame([(json.dumps(d),) for d in (plain, moved, changed)], "body string")
    one, two, three = [r.fingerprint for r in subjects.subject_fingerprints(df, subject).collect()]
    assert one == two == GOLDEN[subject] and three != one


# --- reports ---------------------------------------------------------------------------------


def test_snapshot_retention(spark):
    df = spark.createDataFrame([("r1", "a", 1), ("r1", "b", 2), ("r2", "c", 1), (None, "d", 9)], "release_id string, snapshot_id string, time int")
    kept = spark.createDataFrame([("r1",), ("r9",)], "release_id string")
    got = {(r.release_id, r.snapshot_id): r.decision for r in operations.snapshot_retention(df, kept).collect()}
    assert got == {("r1", "b"): "keep", ("r1", "a"): "forget", ("r2", "c"): "forget", ("r9", None): "missing"}


def test_integrity_preflight(spark):
    parents = spark.createDataFrame([("r1", "i1"), ("r2", "i2")], "runid string, logical_id string")
    sub = spark.createDataFrame([("r1", "i1", 1), ("r1", "i1", 1), ("r2", "i1", 2), ("r2", None, 3)], "watershed_id string, logical_id string, topazid int")
    chan = spark.createDataFrame([("r1", "i1", 1, 1, 1)], "watershed_id string, logical_id string, topazid int, weppid int, order int")
    collections = spark.createDataFrame([("ok-1",), ("Not Ok",)], "key string")
    identities = spark.createDataFrame([("k-1", "active"), (None, "retired"), ("k_2", "lost")], "watershed_key string, status string")
    got = {r.code: r["count"] for r in keys.integrity_preflight(parents, sub, chan, collections, identities).collect() if r["count"]}
    assert got == {
        "subcatchment_run_key": 1, "subcatchment_logical_key": 1, "subcatchment_logical_mismatch": 1, "collection_key_format": 1,
        "watershed_key_format": 1, "watershed_identity_status": 1,
    }
    assert keys.identity_mismatches(sub, "watershed_id", parents, "runid", "logical_id").first()[0] == 2
