"""Document, configuration, attribute-map and geometry-merge queries."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from headwater.catalog.integrity import union_sql
from headwater.catalog.rasters import CHILD_SQL, COVERED_SQL, catchment_children, catchments, parcel
from headwater.catalog.registry import query
from headwater.catalog.releases import PLAN, STATES, plan
from headwater.functions import geometry as G
from headwater.functions.canonical import attribute_map
from headwater.functions.text import secret_keys_in_json
from headwater.operators import identity, ingest, projections, subjects
from headwater.plans import quality, release
from headwater.session import shared_folder
from headwater.sources import files


@query(
    """SELECT 's-' || l_suppkey AS runid, l_orderkey AS topazid, count(*)::INTEGER AS polygons, count(*) AS merged_features, round(sum(l_quantity / 1000 * l_linenumber / 100), 8) AS area,
  min_by(l_returnflag, l_partkey * 10 + l_linenumber) AS flag FROM lineitem GROUP BY l_suppkey, l_orderkey"""
)
def polygon_merge(t):
    features = t.lineitem.select(
        F.concat(F.lit("s-"), F.col("l_suppkey").cast("string")).alias("runid"), F.col("l_orderkey").alias("topazid"),
        (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("position"), F.col("l_returnflag").alias("flag"),
        parcel(F.lit(-120.0), F.lit(40.0), F.col("l_quantity") / 1000.0, F.col("l_linenumber") / 100.0).alias("geometry"),
    )
    merged = ingest.merge_polygons(features, ["runid", "topazid"], "position")
    return merged.select(
        "runid", "topazid", F.size("geometry").alias("polygons"), "merged_features",
        F.round(G.area(F.col("geometry")), 8).alias("area"), "flag",
    )


@query(
    """WITH b AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P')
SELECT 'c-' || o_custkey AS runid, count(*)::INTEGER AS polygons FROM b GROUP BY o_custkey"""
)
def boundary_merge(t):
    features = t.orders.select(
        F.concat(F.lit("c-"), F.col("o_custkey").cast("string")).alias("runid"), F.col("o_orderkey").alias("position"),
        F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "F", 1).alias("Watershed"),
        parcel(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("geometry"),
    )
    merged = ingest.merge_boundary(features, "runid", "position")
    return merged.select("runid", F.size("geometry").alias("polygons"))


@query(
    f"""WITH p AS (SELECT s_suppkey AS k, s_nationkey AS n, s_acctbal AS bal, s_acctbal > 9900 AS away, s_acctbal > 9800 AND s_acctbal <= 9900 AS flat,
    s_acctbal > 9700 AND s_acctbal <= 9800 AS renamed, s_acctbal > 9600 AND s_acctbal <= 9700 AS unreviewed,
    CASE WHEN s_acctbal > 9800 AND s_acctbal <= 9900 THEN 0 ELSE (s_nationkey + 1) / 10.0::DOUBLE END AS w, (s_nationkey + 1) / 20.0::DOUBLE AS h FROM supplier),
c AS (SELECT l_suppkey AS k, l_quantity AS q, l_orderkey, l_linenumber, {CHILD_SQL}, l_quantity / 1000 * l_linenumber / 100 AS a, l_returnflag = 'R' AS chan FROM lineitem),
j AS (SELECT c.*, NOT away AND NOT flat AND NOT renamed AND {COVERED_SQL} AS ok FROM c JOIN p USING (k)),
a AS (SELECT p.*, w * h * CASE WHEN n % 2 = 0 THEN 0.9375 ELSE 0.75 END AS pa, CASE WHEN renamed THEN 0 ELSE COALESCE((SELECT sum(a) FROM c WHERE c.k = p.k AND NOT chan), 0) END AS ca FROM p),
s AS (SELECT k, l_orderkey * 10 + l_linenumber AS topaz, CASE WHEN k % 10 = 3 AND q = 50 THEN -(l_orderkey * 10 + l_linenumber) ELSE l_orderkey * 10 + l_linenumber END AS lost FROM c WHERE NOT chan),
e AS (SELECT k, name, sum(g) AS g, sum(s) AS s FROM (SELECT k, 'whole' AS name, topaz, 1 AS s, 1 AS g FROM s UNION ALL SELECT k, 'lost', topaz, 1, 0 FROM s UNION ALL SELECT k, 'lost', lost, 0, 1 FROM s) GROUP BY k, name, topaz),
r AS (""" + union_sql({
        "reviewed-bounds-membership": "(SELECT 2 * count(*) FROM p WHERE unreviewed)",
        "release-expected-counts": "(SELECT (count(*) > 0)::BIGINT FROM lineitem)",
        "release-counts-exact": "(SELECT (count(*) > 0)::BIGINT FROM p WHERE bal < 0)",
        "run-watershed-count": "(SELECT count(*) FROM p WHERE renamed)",
        "run-counts-exact": "(SELECT count(*) FILTER (WHERE bal < 0) + 2 * count(*) FILTER (WHERE renamed) FROM p)",
        "watershed-geometry-valid": "(SELECT count(*) FROM p WHERE away)",
        "watershed-bounds-reviewed": "(SELECT sum(CASE WHEN renamed OR unreviewed THEN 2 WHEN n >= 20 OR away OR flat THEN 1 ELSE 0 END)::BIGINT FROM p)",
        "subcatchment-geometry-valid": "(SELECT count(*) FROM j WHERE NOT chan AND NOT ok)",
        "channel-geometry-valid": "(SELECT count(*) FROM j WHERE chan AND NOT ok)",
        "watershed-area-positive": "(SELECT count(*) FROM p WHERE flat)",
        "subcatchment-area-ratio": "(SELECT count(*) FROM a WHERE flat OR NOT (ca / NULLIF(pa, 0) BETWEEN 0.01 AND 2.0))",
        "parquet-joins-exact": "(SELECT sum(n)::BIGINT FROM (SELECT CASE name WHEN 'whole' THEN 2 ELSE 1 END * (max(g) > 1 OR min(g) = 0 OR min(s) = 0)::INTEGER AS n FROM e GROUP BY k, name))",
    }) + ") SELECT code, count AS failed, CASE WHEN count = 0 THEN 'passed' ELSE 'failed' END AS status FROM r"
)
def staged_checks(t):
    """A release with wrong figures, watersheds moved away, without width or under another run, and lost attributes."""
    balance, run = F.col("s_acctbal"), lambda number: F.concat(F.lit("s-"), number.cast("string"))
    between = lambda low: (balance > low) & (balance <= low + 100)
    width = F.when(between(9800), 0.0).otherwise((F.col("s_nationkey") + 1) / 10.0)
    parents = catchments(t, F.when(balance > 9900, -200.0).otherwise(F.lit(-120.0)), width).select(
        F.when(between(9700), F.concat(F.lit("x-"), F.col("s_suppkey").cast("string"))).otherwise(run(F.col("s_suppkey"))).alias("runid"), "geometry")
    children = catchment_children(t, run(F.col("l_suppkey")))
    counted = t.lineitem.groupBy("l_suppkey").agg(
        F.count_if(F.col("l_returnflag") != "R").alias("_s"), F.count_if(F.col("l_returnflag") == "R").alias("_c")
    )
    # The ledger of suppliers in debt is off by one subcatchment.
    ledger = t.supplier.join(counted, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(
        run(F.col("s_suppkey")).alias("runid"),
        (F.coalesce("_s", F.lit(0)) + F.when(balance < 0, 1).otherwise(F.lit(0))).alias("actual_subcatchments"),
        F.coalesce("_c", F.lit(0)).alias("actual_channels"), F.lit(None).cast("string").alias("capability_fingerprint"),
    )
    reviewed = t.supplier.select(
        F.when(between(9600), F.concat(F.lit("y-"), F.col("s_suppkey").cast("string"))).otherwise(run(F.col("s_suppkey"))).alias("runid"),
        F.lit(-120.0).alias("minx"), F.lit(40.0).alias("miny"),
        (F.lit(-120.0) + F.least(F.col("s_nationkey") + 1, F.lit(20)) / 10.0).alias("maxx"),
        (F.lit(40.0) + F.least(F.col("s_nationkey") + 1, F.lit(20)) / 20.0).alias("maxy"),
    )
    header = t.lineitem.agg(F.count(F.lit(1)).alias("n")).select(
        *[F.col("n").alias(f"actual_{c}") for c in release.COUNTS], (F.col("n") + 1).alias("expected_subcatchments"),
        F.col("n").alias("expected_watersheds"), F.col("n").alias("expected_channels"),
    )
    subcatchments = children.where("l_returnflag <> 'R'")
    lost = F.when((F.col("l_suppkey") % 10 == 3) & (F.col("l_quantity") == 50), -F.col("topazid")).otherwise(F.col("topazid"))
    given = subcatchments.select("runid", "topazid")
    return quality.staged_release_checks(
        {
            "watersheds": parents, "subcatchments": subcatchments.select("runid", "topazid", "geometry"),
            "channels": children.where("l_returnflag = 'R'").select("runid", "geometry"), "capabilities": parents.limit(0).select("runid"),
        },
        ledger, reviewed, header, {"hillslopes": given, "soils": subcatchments.select("runid", lost.alias("topazid")), "landuse": given},
    )


def sound_configuration() -> dict:
    """A capability configuration that breaks no rule, with many assets."""
    revision, scenarios, variables = "a" * 64, ["s1", "s2", "s3"], ["flow", "load"]
    asset = lambda name: {"uri": f"https://a.test/base/{name}", "sha256": "b" * 64, "bytes": 10, "media_type": "x"}
    named = lambda v: {"id": v, "label": v.title(), "units": "mm"}
    roles = {"hillslope": ["flow"], "patch": ["load"], "basin": variables}
    return {
        "schema_version": 1, "enabled": True, "access_policy": "public", "index_uri": "https://a.test/base/index.json", "index_sha256": "c" * 64,
        "geometry_revision": revision,
        "scenarios": [{"id": s, "label": "@@", "description": "d", "is_change": False, "variables": list(variables), "year_range": [1980, 2020], "geometry_revision": revision} for s in scenarios],
        "variables": [named(v) for v in variables],
        "spatial_inputs": [{"filename": f"{i}.tif", "title": "F", "artifact": asset(f"{i}.tif"), "geometry_revision": revision, "render": {
            "type": "continuous", "min": 0.0, "max": 1.0, "unique_values": None, "group": None, "reversed": False}} for i in range(5)],
        "geotiffs": [{"scenario": s, "variable": v, "artifact": asset(f"{s}-{v}"), "value_range": {"min": 0.0, "max": 2.0}, "geometry_revision": revision} for s in scenarios for v in variables],
        "parquets": [{"dataset_key": f"{s}-{r}", "scenario": s, "role": r, "artifact": asset(f"{s}-{r}"), "spatial_id_field": "id", "variables": [named(v) for v in roles[r]],
                      "year_range": [1980, 2020], "geometry_revision": revision} for s in scenarios for r in roles],
        "geometries": [{"scale": g, "scenarios": list(scenarios), "artifact": asset(g), "source_crs": "EPSG:26910", "geometry_revision": revision} for g in ("hillslope", "patch")],
    }


def _put(*path):
    """A change of one value, the last of ``path``, at the place that the others name."""
    def change(c):
        *way, last, value = path
        for step in way:
            c = c[step]
        c[last] = value

    return change


def _again(name, **other):
    return lambda c: c[name].append({**c[name][0], **other})


OTHER_REVISION, ELSEWHERE = "d" * 64, "https://b.test/index.json"
# The rules in the order in which they are tried, each with a change that breaks it and none before it.
BROKEN = {
    "unreadable": None, "secret-key": _put("api-key", "x"), "schema-version": _put("schema_version", 2), "enabled-flag": _put("enabled", None),
    "access-policy": _put("access_policy", "secret-club"), "index": _put("index_sha256", "e" * 64), "geometry-revision": _put("geometry_revision", "short"),
    "index-location": _put("index_uri", ELSEWHERE), "variable-ids": _put("variables", []), "scenario-ids": _put("scenarios", 1, "id", "s1"),
    "scenario-variables": _put("scenarios", 0, "variables", ["flow", "flow"]), "scenario-years": _put("scenarios", 2, "year_range", [2020, 1980]),
    "scenario-revision": _put("scenarios", 1, "geometry_revision", OTHER_REVISION), "variable-metadata": _put("scenarios", 0, "variables", ["flow", "load", "silt"]),
    "spatial-files": _put("spatial_inputs", 4, "filename", "0.tif"), "spatial-render": _put("spatial_inputs", 3, "render", "type", "paint"),
    "spatial-revision": _put("spatial_inputs", 2, "geometry_revision", OTHER_REVISION), "geotiff-declared": _put("geotiffs", 0, "scenario", "s9"),
    "geotiff-pairs": _again("geotiffs"), "geotiff-range": _put("geotiffs", 5, "value_range", {"min": 3.0, "max": 2.0}),
    "geotiff-revision": _put("geotiffs", 1, "geometry_revision", OTHER_REVISION), "parquet-role": _put("parquets", 0, "role", "ocean"),
    "parquet-declared": _put("parquets", 1, "scenario", "s9"), "parquet-years": _put("parquets", 8, "year_range", [1700, 1800]),
    "parquet-keys": _put("parquets", 1, "dataset_key", "s1-hillslope"), "parquet-overlap": _again("parquets", dataset_key="more"),
    "parquet-revision": _put("parquets", 2, "geometry_revision", OTHER_REVISION), "geometry-scale": _put("geometries", 1, "scale", "basin"),
    "geometry-declared": _put("geometries", 0, "scenarios", ["s1", "s2", "s3", "s9"]), "geometry-crs": _put("geometries", 0, "source_crs", "EPSG:1"),
    "geometry-overlap": _again("geometries"), "geometry-asset-revision": _put("geometries", 1, "geometry_revision", OTHER_REVISION),
    "artifact-location": _put("parquets", 0, "artifact", "uri", "https://a.test/else/p"), "dynamic-assets": _put("spatial_inputs", []),
    "dynamic-geometry": _put("geometries", 1, "scenarios", ["s1", "s2"]), "precomputed-coverage": lambda c: c["geotiffs"].pop(),
}


def configurations() -> list[str]:
    """A sound configuration as JSON text, and one that breaks each rule."""
    texts = [json.dumps(sound_configuration())]
    for change in BROKEN.values():
        one = sound_configuration()
        if change is None:
            texts.append("not json @@")
            continue
        change(one)
        texts.append(json.dumps(one))
    return texts


@query(
    f"""SELECT event_id, list_extract([NULL, {', '.join(f"'{code}'" for code in BROKEN)}], (user_id % {len(BROKEN) + 1} + 1)::INTEGER) AS violation FROM events"""
)
def capability_rules(t):
    """A capability per event; 500 labels make the configurations of one kind differ."""
    kind = (F.col("user_id") % (len(BROKEN) + 1)).cast("int")
    away = kind == 1 + list(BROKEN).index("index-location")
    text = F.get(F.array(*[F.lit(c) for c in configurations()]), kind)
    rows = t.events.select(
        "event_id", F.lit("both").alias("mode"), F.when(away, ELSEWHERE).otherwise(F.lit("https://a.test/base/index.json")).alias("index_uri"),
        F.lit("c" * 64).alias("index_sha256"), F.lit("https://a.test/base/").alias("durable_base_uri"),
        F.replace(text, F.lit("@@"), (F.col("user_id") % 500).cast("string")).alias("configuration"),
    )
    return quality.capability_violations(rows).select("event_id", "violation")


@query(
    r"""SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'api_key' WHEN role = 'system' THEN 'password,token' ELSE '' END AS secret_keys FROM conversations"""
)
def secret_scan(t):
    body = F.to_json(F.struct(
        F.col("role"), F.struct(F.col("text").alias("text"), F.lit("token: \"secret\": x").alias("note")).alias("nested"),
        F.when(F.col("role") == "user", "k").alias("Api-Key"),
        F.when(F.col("role") == "system", F.array(F.struct(F.lit(1).alias("PASSWORD"), F.lit(2).alias("token")))).alias("list"),
    ))
    return t.conversations.select("conv_id", "turn", F.array_join(secret_keys_in_json(body), ",").alias("secret_keys"))


@query(
    r"""SELECT conv_id, turn, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS secret_keys, CASE WHEN role = 'user' THEN 2 ELSE 0 END AS unsafe_addresses FROM conversations"""
)
def document_content(t):
    address = F.when(F.col("role") == "user", "https://u:p@host.test/x").otherwise(F.lit("https://host.test/x"))
    body = F.to_json(F.struct(
        F.col("text"), address.alias("uri"), F.lit("ref").alias("secret_ref"), F.when(F.col("role") == "user", "p").alias("password"),
        F.when(F.col("role") == "user", "http://host.test/").otherwise(F.lit("https://host.test/ok")).alias("other"),
    ))
    documents = t.conversations.select(F.struct("conv_id", "turn").alias("document_id"), body.alias("body"))
    return quality.unsafe_content(documents).select("document_id.conv_id", "document_id.turn", "secret_keys", "unsafe_addresses")


@query(
    """SELECT p_partkey AS key, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 2 = 0 THEN 'n-' || p_size ELSE p_name END AS srcname,
  p_retailprice AS area_km2, CASE WHEN p_size % 2 = 0 THEN p_size ELSE NULL END::INTEGER AS utilities, CASE WHEN p_size > 40 THEN 'color' ELSE '' END AS unknown FROM part"""
)
def derived_values(t):
    old = attribute_map({
        "srcname": F.when(F.col("p_size") % 3 != 0, F.col("p_name")), "area_km2": F.col("p_retailprice"),
        "color": F.when(F.col("p_size") > 40, F.col("p_brand")),
    })
    new = attribute_map({
        "srcname": F.when((F.col("p_size") % 3 != 0) & (F.col("p_size") % 2 == 0), F.concat(F.lit("n-"), F.col("p_size").cast("string"))),
        "utilities": F.when(F.col("p_size") % 2 == 0, F.col("p_size")),
    })
    staged = t.part.select(F.col("p_partkey").alias("key"), old.alias("base"), new.alias("staged"))
    allowed = {"srcname": "string", "area_km2": "double", "utilities": "int"}
    values = release.derived_values(staged, "staged", allowed, defaults="base")
    return values.withColumn("unknown", F.array_join("unknown", ","))


@query(
    """SELECT doc_id, sha256('{"content":{"bytes":"' || n_chars || '","media_type":"text/' || lang || '","sha256":"' || md5(text) || '"},"fingerprint_version":"1","subject":"artifact"}' || chr(10)) AS fingerprint FROM documents"""
)
def subject_digest(t):
    body = F.to_json(F.struct(
        F.concat(F.lit("text/"), "lang").alias("media_type"), F.lit("ignored").alias("uri"), F.col("n_chars").alias("bytes"), F.md5("text").alias("sha256")
    ))
    return subjects.subject_fingerprints(t.documents.select("doc_id", body.alias("body")), "artifact").select("doc_id", "fingerprint")


@query(
    """WITH p AS (SELECT user_id AS document_id, event_type || '-' || (event_id % 12) AS role, event_id % 10 AS k FROM events),
b AS (SELECT document_id, CASE WHEN k = 0 THEN 'duplicate-parquet-column' WHEN k = 1 THEN 'missing-parquet-column' WHEN k = 2 THEN 'invalid-year-range' END AS rule FROM p)
SELECT document_id, rule, count(*) AS broken FROM b WHERE rule IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT document_id, 'duplicate-parquet-role', sum(c - 1)::BIGINT FROM (SELECT document_id, role, count(*) AS c FROM p GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1"""
)
def index_rules(t):
    kind = F.col("event_id") % 10
    names = lambda *values: F.array(*[F.lit(v) for v in values])
    parquets = t.events.select(
        F.col("user_id").alias("document_id"), F.concat_ws("-", "event_type", (F.col("event_id") % 12).cast("string")).alias("role"),
        F.lit("id").alias("spatial_id_field"),
        F.when(kind == 0, names("id", "year", "flow", "flow")).when(kind == 1, names("id", "flow")).otherwise(names("flow", "year", "id")).alias("columns"),
        names("flow").alias("variables"), F.when(kind == 2, 2021).otherwise(F.lit(1990)).alias("first_year"), F.lit(2020).alias("last_year"),
    )
    return quality.index_violations(parquets)


@query(
    """WITH d AS (SELECT o_custkey AS document_id, o_orderpriority AS field FROM orders), i AS (SELECT o_custkey AS document_id, md5(CASE WHEN o_orderpriority = '5-LOW' THEN o_orderstatus ELSE o_orderstatus || '-other' END) AS s FROM orders)
SELECT document_id, 'duplicate-field-decision' AS rule, sum(c - 1)::BIGINT AS broken FROM (SELECT document_id, field, count(*) AS c FROM d GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1
UNION ALL SELECT c_custkey, 'output-reuses-input', 1 FROM customer WHERE EXISTS (SELECT 1 FROM i WHERE i.document_id = c_custkey AND i.s = md5('P'))"""
)
def lineage_rules(t):
    decisions = t.orders.select(F.col("o_custkey").alias("document_id"), F.col("o_orderpriority").alias("field"))
    content = F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_orderstatus")).otherwise(F.concat("o_orderstatus", F.lit("-other")))
    inputs = t.orders.select(F.col("o_custkey").alias("document_id"), F.md5(content).alias("sha256"))
    outputs = t.customer.select(F.col("c_custkey").alias("document_id"), F.md5(F.lit("P")).alias("sha256"))
    return quality.lineage_violations(decisions, inputs, outputs)


@query(
    """SELECT s.watershed_id, s.weppid, COALESCE(w.logical_id, s.logical_id) AS logical_id FROM subcatchments s LEFT JOIN watersheds w ON w.runid = s.watershed_id""",
    "subcatchments watersheds",
)
def identity_propagation(t):
    return identity.propagate_identity(t.subcatchments, t.watersheds).select("watershed_id", "weppid", "logical_id")


@query(
    PLAN + """ SELECT i.identity_id AS watershed_key, CASE WHEN p.operation = 'remove' THEN 'retired' WHEN p.operation IS NOT NULL THEN 'active' ELSE i.status END AS status
FROM identities i LEFT JOIN plan p ON p.watershed_key = i.identity_id""",
    STATES + " identities",
)
def applied_identities(t):
    rows = t.identities.select(F.col("identity_id").alias("watershed_key"), "status")
    return release.apply_to_identities(rows, plan(t))


@query(
    PLAN + """, old AS (SELECT a.runid, a.identity_id, CASE WHEN p.operation IS NULL THEN is_current ELSE COALESCE(a.runid = p.after_runid, FALSE) END AS is_current
  FROM aliases a LEFT JOIN plan p ON p.watershed_key = a.identity_id),
new AS (SELECT after_runid AS runid, watershed_key AS identity_id, TRUE AS is_current FROM plan WHERE operation <> 'remove')
SELECT * FROM old WHERE runid NOT IN (SELECT runid FROM new) UNION ALL SELECT * FROM new""",
    STATES + " aliases",
)
def applied_aliases(t):
    return release.apply_to_aliases(t.aliases, plan(t))


@query(
    PLAN + " " + union_sql({
        "inverse-action-key": "0::BIGINT", "inverse-operation": "(SELECT count(*) FROM plan WHERE operation IN ('add', 'remove') AND delta_subcatchments > 5)",
        "inverse-before": "0::BIGINT", "inverse-after": "0::BIGINT", "inverse-channels": "0::BIGINT", "inverse-delta": "(SELECT count(*) FROM plan WHERE delta_channels = -1)",
    }, "rule").replace("AS count", "AS broken"),
    STATES,
)
def inverse_rules(t):
    forward = plan(t)
    # An inverse with two faults: some operations not mirrored, some deltas not negated.
    faulty = release.plan_inverse(forward).withColumn(
        "operation",
        F.when((F.col("operation") == "remove") & (F.col("delta_subcatchments") < -5), "add").otherwise(F.col("operation")),
    ).withColumn("delta_channels", F.when(F.col("delta_channels") == 1, -1).otherwise(F.col("delta_channels")))
    return release.inverse_violations(forward, faulty)


@query(
    """SELECT 'subcatchment:' || watershed_id || ':' || topazid AS stable_id, topazid, weppid, NULL::DOUBLE AS slope_scalar, NULL::DOUBLE AS length, NULL::DOUBLE AS width, NULL::DOUBLE AS aspect,
  area AS hillslope_area, texture AS simple_texture FROM subcatchments""",
    "subcatchments",
)
def public_subcatchments(t):
    blank = [F.lit(None).cast("double").alias(c) for c in ("slope_scalar", "length", "width", "aspect")]
    rows = t.subcatchments.select(
        "watershed_id", "topazid", "weppid", *blank, F.col("area").alias("hillslope_area"), F.col("texture").alias("simple_texture")
    )
    return projections.subcatchment_rows(rows, F.col("watershed_id"))


@query(
    """SELECT c_custkey AS key, c_name AS id, c_mktsegment AS pws_name, NULL::DOUBLE AS shape_area, c_acctbal AS utilities FROM customer"""
)
def public_watersheds(t):
    blank = [F.lit(None).cast("string").alias(c) for c in projections.WATERSHED_PROPERTIES if c not in ("pws_name", "shape_area", "huc10_utility_count")]
    rows = t.customer.select(
        F.col("c_name").alias("runid"), F.col("c_mktsegment").alias("pws_name"), F.lit(None).cast("double").alias("shape_area"),
        F.col("c_acctbal").alias("huc10_utility_count"), F.col("c_custkey").alias("geom"), F.col("c_nationkey").alias("simplified_geom"), *blank,
    )
    return projections.watershed_rows(rows).select(
        F.col("geometry").alias("key"), "id", "pws_name", "shape_area", F.col("huc10_utility_count").alias("utilities")
    )


@query(
    """WITH f AS (SELECT c_nationkey AS nation, c_custkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS position FROM customer)
SELECT 'nation=' || nation AS folder, count(*) AS features, sum(position)::BIGINT AS positions, sum(k)::BIGINT AS keys, sum(position * k)::BIGINT AS in_order, NULL::VARCHAR AS fault FROM f GROUP BY nation"""
)
def split_features(t):
    """Customers written as one collection per nation, read again in splits of 64 KB."""
    root = shared_folder(t.spark)
    point = lambda: parcel(F.col("c_acctbal") / 100.0, F.lit(40.0), F.lit(1.0), F.lit(1.0))
    rows = t.customer.select("c_nationkey", F.col("c_custkey").alias("k"), F.concat(F.lit('{"[\\'), "c_name").alias("name"), point().alias("geometry"))
    files.write_run_collections(rows, f"{root}/parts", "c_nationkey", ["k"], "k", ["k", "name"], "geometry")
    # The parts of a run, read in name order, are its document; here they are made one file each.
    lines = t.spark.read.text(f"{root}/parts").select(
        F.col("c_nationkey").alias("nation"), "value",
        F.when(F.col("value").startswith('{"type"'), -1).when(F.col("value") == "]}", F.lit(2**62)).otherwise(F.regexp_extract("value", r'"id":(\d+)', 1).try_cast("long")).alias("k"),
    )
    lines.repartition("nation").sortWithinPartitions("nation", "k").select("nation", "value").write.partitionBy("nation").option("compression", "none").text(f"{root}/documents")
    kind = T.StructType([T.StructField("k", T.LongType()), T.StructField("name", T.StringType())])
    folder = F.regexp_extract("file", "(nation=[0-9]+)", 1).alias("folder")
    read = files.read_features(t.spark, f"{root}/documents", kind, split_bytes=1 << 16)
    counted = read.groupBy(folder).agg(
        F.count_if(F.col("properties.name").startswith('{"[\\')).alias("features"), F.sum("position").alias("positions"), F.sum("properties.k").alias("keys"),
        F.sum(F.col("position") * F.col("properties.k")).alias("in_order"),
    )
    faults = files.collection_faults(t.spark, f"{root}/documents", split_bytes=1 << 16).select(folder, "fault")
    return counted.join(faults, "folder")
