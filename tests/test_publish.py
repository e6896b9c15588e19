"""Applying a plan to all tables, the audit of what came out, and the pointer."""

import pytest
from pyspark.sql import functions as F

from headwater.functions import geometry as G
from headwater.functions.canonical import json_line
from headwater.operators import fingerprint as FP
from headwater.plans import publish, release

RING = "array<array<array<struct<x:double,y:double>>>>"


def shape(derived=None):
    line = lambda *names: json_line({n: F.col(n).cast("string") for n in names})
    return publish.Shape(
        metadata=["name"], geometry=["geometry"], metadata_line=line("name"), geometry_line=F.to_json("geometry"),
        children={
            "subcatchments": publish.Lines(["topazid"], line("topazid", "area")), "channels": publish.Lines(["topazid"], line("topazid")),
            "capabilities": publish.Lines(["type"], line("type", "rows")),
        },
        derived=derived or {},
    )


def square(size, points=1):
    side = [(size * i / points, 0.0) for i in range(points)]
    ring = [*side, (size, 0.0), (size, size), (0.0, size), (0.0, 0.0)]
    return [[[{"x": float(x), "y": float(y)} for x, y in ring]]]


def tables(spark, release_id, runs):
    """``runs``: key -> (run, name, size of the square, areas of subcatchments, channels, capability types)."""
    def frame(rows, fields):
        return spark.createDataFrame(rows, fields)

    return {
        "watersheds": frame([(k, r[0], r[1], square(r[2])) for k, r in runs.items()], f"watershed_key string, runid string, name string, geometry {RING}"),
        "subcatchments": frame([(k, r[0], i, float(a)) for k, r in runs.items() for i, a in enumerate(r[3])], "watershed_key string, watershed_id string, topazid long, area double"),
        "channels": frame([(k, r[0], c) for k, r in runs.items() for c in r[4]], "watershed_key string, watershed_id string, topazid long"),
        "capabilities": frame([(release_id, k, r[0], c, 1) for k, r in runs.items() for c in r[5]], "release_id string, watershed_key string, runid string, type string, rows long"),
        "identities": frame([(k, "active") for k in ("a", "b", "c", "d", "e")], "watershed_key string, status string"),
        "aliases": frame([(r[0], k, True) for k, r in runs.items()], "runid string, identity_id string, is_current boolean"),
    }


OLD = {"a": ("ra", "A", 1, [1, 2], [1], ["x"]), "b": ("rb", "B", 2, [3], [], []), "c": ("rc", "C", 3, [4], [2, 3], ["x", "y"]), "d": ("rd", "D", 1, [], [], [])}
# a is renamed and gets other children, b other geometry, c goes, d stays, e comes.
NEW = {"a": ("ra2", "A", 1, [1, 5, 6], [1], ["x", "z"]), "b": ("rb", "B", 4, [3], [], []), "d": ("rd", "D", 1, [], [], []), "e": ("re", "E", 1, [7], [9], [])}


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=str)


@pytest.fixture(scope="module")
def both(spark):
    old, new = tables(spark, "old", OLD), tables(spark, "new", NEW)
    before, after = publish.run_states(old, shape()).cache(), publish.run_states(new, shape()).cache()
    return old, new, before, after, release.plan_forward(before, after).cache()


def test_plan_apply_and_inverse(both):
    old, new, before, after, plan = both
    assert rows(plan, "watershed_key", "operation") == [("a", "change"), ("b", "change"), ("c", "remove"), ("d", "retain"), ("e", "add")]
    made = publish.applied(old, new, plan, "new", shape())
    for name in ("watersheds", "subcatchments", "channels"):
        assert rows(made[name].select(*new[name].columns)) == rows(new[name])
    assert rows(publish.of_release(made, "new")["capabilities"]) == rows(new["capabilities"])
    assert rows(made["identities"]) == [("a", "active"), ("b", "active"), ("c", "retired"), ("d", "active"), ("e", "active")]
    assert rows(made["aliases"].where("is_current"), "runid") == [("ra2",), ("rb",), ("rd",), ("re",)]
    assert publish.audit(made, after, shape(), "new").isEmpty()
    back = publish.applied(made, old, release.plan_inverse(plan), "old", shape())
    for name in ("watersheds", "subcatchments", "channels"):
        assert rows(back[name].select(*old[name].columns)) == rows(old[name])
    assert publish.audit(back, before, shape(), "old").isEmpty()


def test_incremental_domain_digest(both):
    old, new, before, after, plan = both
    kept = publish.run_sums(before)
    total = FP.combined_sums([(kept, 1)], [])
    # Only the watersheds that the plan touches are read from staging.
    read = {k: v if k not in publish.KINDS and k != "watersheds" else v.where("watershed_key <> 'd'") for k, v in new.items()}
    moved = publish.moved_domain(total, kept, plan, read, shape()).collect()
    assert moved == publish.domain_digest(publish.run_sums(after)).collect() != publish.domain_digest(kept).collect()
    back = publish.moved_domain(FP.combined_sums([(publish.run_sums(after), 1)], []), publish.run_sums(after), release.plan_inverse(plan), old, shape())
    assert back.collect() == publish.domain_digest(kept).collect()


def test_conflicts(spark, both):
    old, new, _, _, plan = both
    assert release.apply_conflicts(old["watersheds"], new["watersheds"], plan).isEmpty()
    drifted = spark.createDataFrame([("a", "other"), ("b", "rb"), ("b", "rb"), ("e", "re"), ("z", "rz")], "watershed_key string, runid string")
    staged = spark.createDataFrame([("a", "ra2"), ("b", "wrong"), ("e", "re")], "watershed_key string, runid string")
    assert rows(release.apply_conflicts(drifted, staged, plan)) == sorted([
        ("a", "drifted", "ra", "other"), ("b", "repeated", "rb", "rb"), ("b", "staged-run", "rb", "wrong"), ("c", "absent", "rc", None), ("d", "absent", "rd", None),
        ("d", "unstaged", "rd", None), ("e", "present", None, "re"), ("z", "unplanned", None, "rz"),
    ], key=str)


def test_publication(spark, both, tmp_path):
    old, new, _, after, plan = both
    root = str(tmp_path)
    assert publish.active_release(spark, root) is None
    publish.start(spark, root, "old", old)
    serving = publish.read_version(spark, root, "old", old)
    moved = {**serving, "watersheds": serving["watersheds"].withColumn("runid", F.concat("runid", F.lit("x")))}
    refused = publish.publish(spark, root, "new", moved, new, plan, after, shape())
    assert {r.rule for r in refused.collect()} == {"drifted"} and publish.active_release(spark, root) == "old"
    assert not (tmp_path / "release=new").exists()

    wrong = after.withColumn("run_fingerprint", F.when(F.col("watershed_key") == "b", "bad").otherwise(F.col("run_fingerprint"))).where("watershed_key <> 'e'")
    found = publish.publish(spark, root, "new", serving, new, plan, wrong, shape())
    assert sorted((r.stage, r.watershed_key or "", r.rule) for r in found.collect()) == [("audit", "", "domain"), ("audit", "b", "run_fingerprint"), ("audit", "e", "unlisted")]
    assert publish.active_release(spark, root) == "old"

    assert publish.publish(spark, root, "new", serving, new, plan, after, shape()).isEmpty()
    assert publish.active_release(spark, root) == "new"
    with pytest.raises(ValueError):
        publish.publish(spark, root, "new", serving, new, plan, after, shape())


def test_derived_boundary(spark, both):
    old, new, _, _, plan = both
    thin = {"simplified": G.simplifier(0.2)}
    marked = old["watersheds"].withColumn("simplified", F.lit(None).cast(RING))
    wide = new["watersheds"].withColumn("geometry", F.when(F.col("watershed_key") != "a", F.lit(None)).otherwise(F.col("geometry")))
    staged = wide.select("watershed_key", "runid", "name", F.coalesce("geometry", F.from_json(F.lit(str(square(4, 8)).replace("'", '"')), RING)).alias("geometry"))
    made = release.apply_to_watersheds(marked, staged, plan, ["name"], ["geometry"], thin)
    found = {r.watershed_key: r for r in made.collect()}
    assert found["a"].simplified is None and found["d"].simplified is None  # geometry not taken: as it was
    assert len(found["b"].geometry[0][0]) == 12 and len(found["b"].simplified[0][0]) == 5 == len(found["e"].simplified[0][0])
