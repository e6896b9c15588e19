"""Data-quality reports over staged releases, ledgers, documents and capabilities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.functions import geometry as G
from headwater.functions.numbers import bounds_close, within_world
from headwater.functions.text import SHA256_HEX, is_public_https, looks_like_html, matches, redact, secret_keys_in_json
from headwater.operators.containment import covered_children
from headwater.operators.ingest import attribute_coverage

# Media type expected of each artifact role; everything else is JSON.
MEDIA_TYPES = {
    "boundary": "application/geo+json", "subcatchments": "application/geo+json",
    "channels": "application/geo+json", "hillslopes": "application/vnd.apache.parquet",
    "soils": "application/vnd.apache.parquet", "landuse": "application/vnd.apache.parquet",
}
COUNTS = ["watersheds", "subcatchments", "channels"]


def release_totals(run_states: DataFrame, releases: DataFrame) -> DataFrame:
    """AGG-16: sums of run-state counts against the ledger of each release; no rows count as 0."""
    sums = run_states.groupBy("release_id").agg(*[F.sum(f"actual_{c}").alias(f"_{c}") for c in COUNTS])
    joined = releases.join(sums, "release_id", "left")
    total = lambda c: F.coalesce(F.col(f"_{c}"), F.lit(0)).cast("bigint")
    equal = reduce(lambda a, b: a & b, [total(c) == F.col(f"actual_{c}") for c in COUNTS])
    return joined.select("release_id", *[total(c).alias(c) for c in COUNTS], equal.alias("equal"))


def child_counts(
    ledger: DataFrame, watersheds: DataFrame, subcatchments: DataFrame, channels: DataFrame, capabilities: DataFrame
) -> DataFrame:
    """AGG-17: per run the counted rows of each kind against the ledger.

    The kinds are counted in one grouping of tagged keys, combined before the shuffle.
    """
    kinds = {"watersheds": watersheds, "subcatchments": subcatchments, "channels": channels, "capabilities": capabilities}
    tagged = reduce(
        DataFrame.unionByName, [df.select("runid", F.lit(k).alias("_kind")) for k, df in kinds.items()]
    )
    counted = tagged.groupBy("runid").agg(*[F.count_if(F.col("_kind") == k).alias(f"_{k}") for k in kinds])
    wanted = ledger.select(
        "runid", F.lit(1).alias("_listed"), F.lit(1).alias("expected_watersheds"),
        F.col("actual_subcatchments").alias("expected_subcatchments"),
        F.col("actual_channels").alias("expected_channels"),
        F.col("capability_fingerprint").isNotNull().cast("int").alias("expected_capabilities"),
    )
    joined = counted.join(wanted, "runid", "full_outer")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("bigint")
    exact = F.col("_listed").isNotNull()
    for kind in kinds:
        exact = exact & (zero(f"_{kind}") == zero(f"expected_{kind}"))
    return joined.select("runid", *[zero(f"_{k}").alias(k) for k in kinds], exact.alias("exact"))


def area_ratio(children: DataFrame, parents: DataFrame, low: float = 0.01, high: float = 2.0) -> DataFrame:
    """AGG-26: summed child area over parent area per run; the parent's area must be positive.

    ``children`` and ``parents`` carry runid and area.
    """
    summed = children.groupBy("runid").agg(F.sum("area").alias("child_area"))
    joined = parents.select("runid", F.col("area").alias("parent_area")).join(summed, "runid", "left")
    child = F.coalesce("child_area", F.lit(0.0))
    ratio = child / F.nullif(F.col("parent_area"), F.lit(0.0))
    return joined.select(
        "runid", child.alias("child_area"), "parent_area",
        F.when(F.col("parent_area") > 0, ratio).alias("ratio"),
        F.coalesce((F.col("parent_area") > 0) & ratio.between(low, high), F.lit(False)).alias("reasonable"),
    )


def staged_release_checks(
    staged: dict[str, DataFrame], ledger: DataFrame, reviewed: DataFrame, header: DataFrame, attributes: dict[str, DataFrame], tolerance: float = 0.001
) -> DataFrame:
    """DQ-01: rows failing each check of a staged release.

    ``staged``: watersheds, subcatchments (with topazid), channels (runid and geometry) and capabilities
    (runid); one watershed per run is looked at. ``ledger``: the run states. ``reviewed``: runid and reviewed
    bounds. ``header``: one row of expected_<count> and actual_<count>. ``attributes``: tables of runid and
    topazid that must cover the subcatchments exactly.
    """
    # Box and area of a parent are computed once, before anything meets it.
    geometry = F.col("geometry")
    parents = staged["watersheds"].select(
        "runid", G.bbox(geometry).alias("_box"), G.area(geometry).alias("area"), G.valid_coordinates(G.points(geometry)).alias("_sound"),
    )
    in_world = lambda b: F.coalesce(within_world(b["minx"], b["miny"], b["maxx"], b["maxy"]), F.lit(False))

    counts = child_counts(
        ledger, *[staged[k].select("runid") for k in ("watersheds", "subcatchments", "channels", "capabilities")]
    )
    # Staged and listed totals of each kind meet as tagged rows of a few figures.
    listed = ledger.agg(
        F.count(F.lit(1)).alias("watersheds"), F.sum("actual_subcatchments").alias("subcatchments"), F.sum("actual_channels").alias("channels"),
        F.count("capability_fingerprint").alias("capabilities"),
    )
    kinds = ["watersheds", "subcatchments", "channels", "capabilities"]
    stacked = lambda df, sign: df.select(F.expr(f"stack({len(kinds)}, {', '.join(f'{k!r}, {sign} * coalesce({k}, 0)' for k in kinds)}) AS (kind, n)"))
    totals = stacked(counts.agg(*[F.sum(k).alias(k) for k in kinds]), 1).unionByName(stacked(listed, -1)).groupBy("kind").agg(F.sum("n").alias("n"))
    membership = ledger.select("runid", F.lit(1).alias("_l")).join(reviewed.select("runid", F.lit(1).alias("_r")), "runid", "full_outer")
    bounds = parents.join(reviewed, "runid", "full_outer")
    sides = ["minx", "miny", "maxx", "maxy"]
    close = F.coalesce(
        bounds_close([F.col("_box")[s] for s in sides], [F.col(s) for s in sides], tolerance), F.lit(False)
    )
    differ = [(F.col(f"expected_{c}") != F.col(f"actual_{c}")).cast("bigint") for c in COUNTS]
    fails = {
        "reviewed-bounds-membership": membership.agg(F.count_if(F.col("_l").isNull() | F.col("_r").isNull()).alias("failed")),
        "release-expected-counts": header.agg(F.sum(reduce(lambda a, b: a + b, differ)).alias("failed")),
        "release-counts-exact": totals.agg(F.count_if(F.col("n") != 0).alias("failed")),
        "run-watershed-count": counts.join(ledger.select("runid"), "runid", "left_semi").agg(F.count_if(F.col("watersheds") != 1).alias("failed")),
        "run-counts-exact": counts.agg(F.count_if(~F.col("exact")).alias("failed")),
        "watershed-geometry-valid": parents.agg(F.count_if(~(F.col("_sound") & in_world(F.col("_box")))).alias("failed")),
        "watershed-bounds-reviewed": bounds.agg(F.count_if(~close).alias("failed")),
    }
    for kind, code in (("subcatchments", "subcatchment-geometry-valid"), ("channels", "channel-geometry-valid")):
        children = covered_children(staged["watersheds"].select("runid", "geometry"), staged[kind].select("runid", "geometry"))
        fails[code] = children.agg(F.count_if(~F.col("covered")).alias("failed"))
    areas = area_ratio(
        staged["subcatchments"].select("runid", G.area(geometry).alias("area")), parents.select("runid", "area")
    )
    fails["watershed-area-positive"] = areas.agg(F.count_if(~(F.col("parent_area") > 0)).alias("failed"))
    fails["subcatchment-area-ratio"] = areas.agg(F.count_if(~F.col("reasonable")).alias("failed"))
    inexact = [
        attribute_coverage(staged["subcatchments"], table).where(~F.col("exact")).select(F.lit(name).alias("table"), "runid")
        for name, table in attributes.items()
    ]
    fails["parquet-joins-exact"] = reduce(DataFrame.unionByName, inexact).agg(F.count(F.lit(1)).alias("failed"))
    return reduce(
        DataFrame.unionByName,
        [df.select(F.lit(c).alias("code"), "failed", F.when(F.col("failed") == 0, "passed").otherwise(F.lit("failed")).alias("status")) for c, df in fails.items()],
    )


def validation_report(checks: DataFrame, subjects: DataFrame) -> DataFrame:
    """DQ-02: per report its number of checks, failures, repeated codes, time order and summary.

    ``checks``: report_id, code, status. ``subjects``: report_id, started_at, completed_at,
    summary. Checks are combined per code first; codes come from a short fixed vocabulary.
    """
    coded = checks.groupBy("report_id", "code").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("status") == "failed").alias("_failed")
    )
    per = coded.groupBy("report_id").agg(
        F.sum("_n").alias("checks"), F.sum("_failed").alias("failures"), F.count_if(F.col("_n") > 1).alias("repeated_codes"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("_failed") > 0, F.col("code")))), ",").alias("failed_codes"),
    )
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).alias(name)
    return subjects.join(per, "report_id", "left").select(
        "report_id", zero("checks"), zero("failures"), zero("repeated_codes"),
        F.coalesce("failed_codes", F.lit("")).alias("failed_codes"),
        F.when(F.coalesce("failures", F.lit(0)) > 0, "failed").otherwise(F.lit("passed")).alias("status"),
        (F.col("started_at") <= F.col("completed_at")).alias("times_ordered"), redact(F.col("summary"), 512).alias("summary"),
    )


def manifest_index(manifests: DataFrame, members: DataFrame) -> DataFrame:
    """JN-17: per collection whether manifest and member index list the same keys at the same places.

    Both sides carry collection, position and watershed_key; ``members`` one index
    per collection. Keys meet on (collection, position): no list of a collection is built.
    """
    left = manifests.select("collection", "position", F.col("watershed_key").alias("_manifest"))
    right = members.select("collection", "position", F.col("watershed_key").alias("_index"))
    joined = left.join(right, ["collection", "position"], "full_outer")
    per = joined.groupBy("collection").agg(
        F.count("_manifest").alias("manifest_members"), F.count("_index").alias("index_members"),
        F.count_if(~F.col("_manifest").eqNullSafe(F.col("_index"))).alias("misplaced"),
    )
    return per.withColumn(
        "finding",
        F.when(F.col("manifest_members") == 0, "release-index-collection")
        .when(F.col("manifest_members") != F.col("index_members"), "release-index-count")
        .when(F.col("misplaced") > 0, "release-index-membership").otherwise(F.lit("consistent")),
    )


def fingerprint_links(runs: DataFrame, capabilities: DataFrame, domain: DataFrame) -> DataFrame:
    """JN-20: the run's capability digest against the capability subject, and exactly one domain
    row per run identity with equal digests. Key: collection, watershed_key, runid."""
    key = ["collection", "watershed_key", "runid"]
    counted = domain.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_rows"), F.min("run_fingerprint").alias("_run"),
        F.min("capability_fingerprint").alias("_capability"),
    )
    joined = runs.join(
        capabilities.select(*key, F.col("fingerprint").alias("_subject")), key, "left"
    ).join(counted, key, "left")
    return joined.select(
        *key,
        F.when(~F.col("capability_fingerprint").eqNullSafe(F.col("_subject")), "run-capability-link")
        .when(F.coalesce("_rows", F.lit(0)) != 1, "domain-run-link")
        .when(
            ~F.col("run_fingerprint").eqNullSafe(F.col("_run")) | ~F.col("capability_fingerprint").eqNullSafe(F.col("_capability")),
            "domain-fingerprint-link",
        ).otherwise(F.lit("linked")).alias("finding"),
    )


def compare_fingerprints(left: DataFrame, right: DataFrame) -> DataFrame:
    """DQ-08: table fingerprints of two copies, table by table."""
    one = left.select("table_name", F.col("rows").alias("left_rows"), F.col("fingerprint").alias("_l"))
    two = right.select("table_name", F.col("rows").alias("right_rows"), F.col("fingerprint").alias("_r"))
    return one.join(two, "table_name", "full_outer").select(
        "table_name", "left_rows", "right_rows",
        F.when(F.col("_l").isNull(), "missing left").when(F.col("_r").isNull(), "missing right")
        .when((F.col("_l") == F.col("_r")) & (F.col("left_rows") == F.col("right_rows")), "equal")
        .otherwise(F.lit("differs")).alias("finding"),
    )


def compare_schemas(left: DataFrame, right: DataFrame) -> list[tuple[str, str | None, str | None]]:
    """DQ-08: columns whose type differs or that one copy lacks."""
    one = {f.name: f.dataType.simpleString() for f in left.schema}
    two = {f.name: f.dataType.simpleString() for f in right.schema}
    return [(n, one.get(n), two.get(n)) for n in sorted(one.keys() | two.keys()) if one.get(n) != two.get(n)]


def verify_artifacts(files: DataFrame, lineage: DataFrame) -> DataFrame:
    """DQ-06: stored files against their lineage rows: presence, size, digest, type, content.

    ``files``: path, length, sha256 and the first bytes (head), as ``sources.blobs.digests`` gives them for files
    of any size, with the join column ``path`` as in the lineage. ``lineage``: path, role, uri, sha256,
    byte_size, media_type. No content travels.
    """
    digested = files.select(
        "path", F.col("length").alias("_size"), F.col("sha256").alias("_sha"),
        looks_like_html(F.decode(F.substring("head", 1, 1024), "ISO-8859-1")).alias("_html"),
    )
    joined = lineage.join(digested, "path", "left")
    expected = F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv]), F.col("role")),
        F.lit("application/json"),
    )
    return joined.select(
        "path", "role",
        F.when(F.col("_sha").isNull(), "missing").when(~is_public_https(F.col("uri")), "artifact-uri-safe")
        .when(F.col("media_type") != expected, "media-type").when(F.col("_size") != F.col("byte_size"), "size")
        .when(F.col("_sha") != F.col("sha256"), "sha256").when(F.col("_html"), "artifact-not-html")
        .otherwise(F.lit("verified")).alias("finding"),
    )


# --- capabilities ------------------------------------------------------------------------

ARTIFACT = "struct<uri:string,sha256:string,bytes:bigint,media_type:string>"
CAPABILITY = f"""
struct<
  schema_version:int, enabled:boolean, access_policy:string, index_uri:string, index_sha256:string,
  geometry_revision:string,
  scenarios:array<struct<id:string,label:string,description:string,is_change:boolean,variables:array<string>,
    year_range:array<int>,geometry_revision:string>>,
  variables:array<struct<id:string,label:string,units:string>>,
  spatial_inputs:array<struct<filename:string,title:string,artifact:{ARTIFACT},
    render:struct<type:string,min:double,max:double,unique_values:array<double>,`group`:string,reversed:boolean>,
    geometry_revision:string>>,
  geotiffs:array<struct<scenario:string,variable:string,artifact:{ARTIFACT},value_range:struct<min:double,max:double>,
    geometry_revision:string>>,
  parquets:array<struct<dataset_key:string,scenario:string,role:string,artifact:{ARTIFACT},spatial_id_field:string,
    variables:array<struct<id:string,label:string,units:string>>,year_range:array<int>,geometry_revision:string>>,
  geometries:array<struct<scale:string,scenarios:array<string>,artifact:{ARTIFACT},source_crs:string,
    geometry_revision:string>>
>"""


def _repeats(values: Column) -> Column:
    return F.size(values) != F.size(F.array_distinct(values))


def _pairs(outer: Column, one: str, many: str, inner: str | None = None) -> Column:
    """Flat list of ``<one> <member of many>`` texts over an array of structs."""
    def of(item: Column) -> Column:
        name = item[one]
        return F.transform(item[many], lambda m: F.concat_ws(" ", name, m[inner] if inner else m))

    return F.flatten(F.transform(outer, of))


def capability_violations(capabilities: DataFrame) -> DataFrame:
    """DQ-07: ``capabilities`` with the first configuration rule each breaks, or null, as ``violation``.

    ``capabilities``: mode, index_uri, index_sha256, durable_base_uri and configuration (JSON text).
    Rules are evaluated once per distinct configuration, which many runs share: texts combine before they
    are shuffled, and the findings meet the capabilities again by a digest. Rules about the capability's own
    address, place and mode take what they need of a configuration from its findings.
    """
    digest = [F.xxhash64("configuration").alias("_h1"), F.xxhash64(F.lit(7), "configuration").alias("_h2")]
    parsed = capabilities.select("configuration").distinct().withColumn("_c", F.from_json("configuration", CAPABILITY))
    c = lambda name: F.col(f"_c.{name}")
    ids = lambda name, field: F.transform(c(name), lambda i: i[field])
    every = lambda name, rule: F.coalesce(F.forall(c(name), rule), F.lit(False))
    revision = c("geometry_revision")
    same_revision = lambda name: every(name, lambda i: i["geometry_revision"] == revision)
    stored = lambda name: every(
        name, lambda i: is_public_https(i["artifact"]["uri"]) & matches(i["artifact"]["sha256"], SHA256_HEX) & (i["artifact"]["bytes"] > 0),
    )
    assets = ("spatial_inputs", "geotiffs", "parquets", "geometries")
    years = lambda y: (F.size(y) == 2) & (F.get(y, 0) <= F.get(y, 1)) & F.get(y, 0).between(1800, 3000) & (F.get(y, 1) <= 3000)
    # Lists that several rules read are built once, as columns.
    parsed = parsed.withColumns({
        "_scenario_ids": ids("scenarios", "id"),
        "_declared": _pairs(c("scenarios"), "id", "variables"),
        "_geotiffs": F.transform(c("geotiffs"), lambda g: F.concat_ws(" ", g["scenario"], g["variable"])),
        "_places": _pairs(c("geometries"), "scale", "scenarios"),
    })
    scenario_ids, declared, geotiff_pairs, geometry_places = (
        F.col(name) for name in ("_scenario_ids", "_declared", "_geotiffs", "_places")
    )
    parquet_pairs = _pairs(c("parquets"), "scenario", "variables", "id")
    parquet_places = F.flatten(F.transform(
        c("parquets"),
        lambda p: F.transform(p["variables"], lambda v: F.concat_ws(" ", p["scenario"], p["role"], v["id"])),
    ))
    needed_geometry = F.transform(
        F.filter(c("parquets"), lambda p: p["role"].isin("hillslope", "patch")),
        lambda p: F.concat_ws(" ", p["role"], p["scenario"]),
    )
    beyond = lambda inner, outer: F.size(F.array_except(inner, outer)) > 0
    render_ok = lambda s: (
        s["render"]["type"].isin("continuous", "categorical", "stream")
        & F.coalesce(s["render"]["min"] <= s["render"]["max"], s["render"]["type"] != "continuous")
        & ((s["render"]["type"] != "categorical") | s["render"]["unique_values"].isNotNull())
        & F.coalesce((F.size(s["render"]["unique_values"]).between(1, 1024)) & ~_repeats(s["render"]["unique_values"]), F.lit(True))
    )
    rules = [
        ("unreadable", F.col("_c").isNull() | c("scenarios").isNull() | c("variables").isNull() | c("spatial_inputs").isNull()
         | c("geotiffs").isNull() | c("parquets").isNull() | c("geometries").isNull()),
        ("secret-key", F.size(secret_keys_in_json(F.col("configuration"))) > 0),
        ("schema-version", ~c("schema_version").eqNullSafe(F.lit(1))),
        ("enabled-flag", c("enabled").isNull()),
        ("access-policy", ~F.coalesce(c("access_policy").isin("public", "disabled"), F.lit(False))),
        ("index", F.lit(False)),
        ("geometry-revision", ~matches(revision, SHA256_HEX)),
        ("index-location", F.lit(False)),
        ("variable-ids", (F.size(c("variables")) == 0) | _repeats(ids("variables", "id"))),
        ("scenario-ids", (F.size(c("scenarios")) == 0) | _repeats(scenario_ids)),
        ("scenario-variables", ~every("scenarios", lambda s: (F.size(s["variables"]) > 0) & ~_repeats(s["variables"]))),
        ("scenario-years", ~every("scenarios", lambda s: years(s["year_range"]))),
        ("scenario-revision", ~same_revision("scenarios")),
        ("variable-metadata", beyond(F.flatten(ids("scenarios", "variables")), ids("variables", "id"))),
        ("spatial-files", _repeats(ids("spatial_inputs", "filename"))),
        ("spatial-render", ~every("spatial_inputs", render_ok)),
        ("spatial-revision", ~same_revision("spatial_inputs")),
        ("geotiff-declared", beyond(geotiff_pairs, declared)),
        ("geotiff-pairs", _repeats(geotiff_pairs)),
        ("geotiff-range", ~every("geotiffs", lambda g: F.coalesce(g["value_range"]["min"] <= g["value_range"]["max"], g["value_range"].isNull()))),
        ("geotiff-revision", ~same_revision("geotiffs")),
        ("parquet-role", ~every("parquets", lambda p: p["role"].isin("basin", "hillslope", "patch"))),
        ("parquet-declared", beyond(ids("parquets", "scenario"), scenario_ids) | beyond(parquet_pairs, declared)),
        ("parquet-years", ~every("parquets", lambda p: years(p["year_range"]))),
        ("parquet-keys", _repeats(ids("parquets", "dataset_key"))),
        ("parquet-overlap", _repeats(parquet_places)),
        ("parquet-revision", ~same_revision("parquets")),
        ("geometry-scale", ~every("geometries", lambda g: g["scale"].isin("hillslope", "patch") & (F.size(g["scenarios"]) > 0))),
        ("geometry-declared", beyond(F.flatten(ids("geometries", "scenarios")), scenario_ids)),
        ("geometry-crs", ~every("geometries", lambda g: g["source_crs"].rlike("^EPSG:[0-9]{4,6}$"))),
        ("geometry-overlap", _repeats(geometry_places)),
        ("geometry-asset-revision", ~same_revision("geometries")),
        ("artifact-location", ~reduce(lambda a, b: a & b, [stored(name) for name in assets])),
        ("dynamic-assets", (F.size(c("spatial_inputs")) == 0) | (F.size(c("parquets")) == 0) | (F.size(c("geometries")) == 0)),
        ("dynamic-geometry", beyond(needed_geometry, geometry_places)),
        ("precomputed-coverage", beyond(declared, geotiff_pairs) | beyond(geotiff_pairs, declared)),
    ]
    place = {code: i for i, (code, _) in enumerate(rules)}
    # Rules of one mode only, and the first of the others that is broken, by its place.
    by_mode = {code: broken for code, broken in rules if code.startswith(("dynamic-", "precomputed-"))}
    general = F.coalesce(*[F.when(F.coalesce(broken, F.lit(True)), F.lit(place[code])) for code, broken in rules if code not in by_mode], F.lit(len(rules)))
    addresses = F.flatten(F.array(*[F.transform(c(name), lambda i: i["artifact"]["uri"]) for name in assets]))
    found = parsed.select(
        *digest, general.alias("_general"), *[F.coalesce(broken, F.lit(True)).alias(f"_{code}") for code, broken in by_mode.items()],
        c("index_uri").alias("_index_uri"), c("index_sha256").alias("_index_sha"),
        # Texts that begin alike are neighbours in order: if the least and the greatest begin with a place, all do.
        F.array_min(addresses).alias("_least"), F.array_max(addresses).alias("_greatest"),
    )
    base = F.concat(F.regexp_replace("durable_base_uri", "/+$", ""), F.lit("/"))
    dynamic, precomputed = F.col("mode").isin("dynamic", "both"), F.col("mode").isin("precomputed", "both")
    own = {
        "index": ~F.col("_index_uri").eqNullSafe(F.col("index_uri")) | ~F.col("_index_sha").eqNullSafe(F.col("index_sha256")),
        "index-location": ~F.col("index_uri").startswith(base),
        "artifact-location": F.col("_least").isNotNull() & ~(F.col("_least").startswith(base) & F.col("_greatest").startswith(base)),
        "dynamic-assets": dynamic & F.col("_dynamic-assets"), "dynamic-geometry": dynamic & F.col("_dynamic-geometry"),
        "precomputed-coverage": precomputed & F.col("_precomputed-coverage"),
    }
    first = F.least(F.col("_general"), *[F.when(F.coalesce(broken, F.lit(True)), place[code]).otherwise(len(rules)) for code, broken in own.items()])
    names = F.array(*[F.lit(code) for code, _ in rules])
    joined = capabilities.withColumns({"_h1": digest[0], "_h2": digest[1]}).join(found, ["_h1", "_h2"], "left")
    return joined.select(*[F.col(f"`{name}`") for name in capabilities.columns], F.get(names, F.coalesce(first, F.lit(0))).alias("violation"))




def resolve_capabilities(capabilities: DataFrame, active: DataFrame, runs: DataFrame, kind: str) -> DataFrame:
    """FLT-07 and FLT-08: what each run may use under the active release.

    ``capabilities``: release_id, runid, capability_type, mode, enabled, access_policy,
    violation. ``active`` is the one-row pointer. A run without a row has none, a row with a
    violation is invalid, and only enabled public ones are available.
    """
    visible = capabilities.join(active.select("release_id"), "release_id").where(
        F.col("capability_type") == kind
    )
    joined = runs.select("runid").join(visible, "runid", "left")
    source = (
        F.when(F.col("capability_type").isNull(), "none").when(F.col("violation").isNotNull(), "invalid")
        .otherwise(F.lit("materialized"))
    )
    available = F.coalesce((source == "materialized") & F.col("enabled") & (F.col("access_policy") == "public"), F.lit(False))
    return joined.select(
        "runid", source.alias("source"), available.alias("available"),
        (available & F.col("mode").isin("dynamic", "both")).alias("supports_dynamic"),
        (available & F.col("mode").isin("precomputed", "both")).alias("supports_precomputed"),
    )


def release_status(releases: DataFrame, run_states: DataFrame, active: DataFrame) -> DataFrame:
    """AGG-28: every release with its counts, its runs with a capability, and the active mark."""
    held = run_states.groupBy("release_id").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("capability_fingerprint").isNotNull()).alias("capabilities")
    )
    pointer = active.select("release_id", F.lit(True).alias("_active"))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).alias(name)
    return releases.join(held, "release_id", "left").join(pointer, "release_id", "left").select(
        "release_id", *[F.col(f"actual_{c}").alias(c) for c in COUNTS], zero("runs"), zero("capabilities"),
        F.coalesce("_active", F.lit(False)).alias("active"),
    )


# --- release documents ---------------------------------------------------------------------


def _count_rule(df: DataFrame, keys: list[str], code: str) -> DataFrame:
    """Documents with repeated keys; repeats are counted per key, then per document."""
    repeated = df.groupBy("document_id", *keys).count().where(F.col("count") > 1)
    return repeated.groupBy("document_id").agg(F.sum(F.col("count") - 1).alias("broken")).withColumn("rule", F.lit(code))


def manifest_violations(collections: DataFrame, members: DataFrame, removals: DataFrame, lineage: DataFrame) -> DataFrame:
    """DQ-04 for release manifests given as rows: document_id with collection_key,
    expected_member_count; watershed_key; and event_key."""
    counts = members.groupBy("document_id", "collection_key").count()
    wrong = collections.join(counts, ["document_id", "collection_key"], "left").where(
        F.col("expected_member_count") != F.coalesce("count", F.lit(0))
    ).groupBy("document_id").agg(F.count(F.lit(1)).alias("broken")).withColumn("rule", F.lit("member-count-mismatch"))
    overlap = removals.join(members, ["document_id", "watershed_key"], "left_semi").groupBy("document_id").agg(
        F.count(F.lit(1)).alias("broken")
    ).withColumn("rule", F.lit("target-overlapping-removal"))
    parts = [
        _count_rule(collections, ["collection_key"], "duplicate-collection-key"), wrong,
        _count_rule(members, ["watershed_key"], "duplicate-watershed-key"),
        _count_rule(removals, ["watershed_key"], "duplicate-removal-key"), overlap,
        _count_rule(lineage, ["event_key"], "duplicate-lineage-event"),
    ]
    return reduce(DataFrame.unionByName, parts).select("document_id", "rule", "broken")


def lineage_violations(decisions: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """DQ-04 for transformation lineage: repeated field decisions, and an output among the inputs."""
    reused = outputs.join(inputs, ["document_id", "sha256"], "left_semi").groupBy("document_id").agg(
        F.count(F.lit(1)).alias("broken")
    ).withColumn("rule", F.lit("output-reuses-input"))
    return _count_rule(decisions, ["field"], "duplicate-field-decision").unionByName(reused).select(
        "document_id", "rule", "broken"
    )


def index_violations(parquets: DataFrame) -> DataFrame:
    """DQ-04 for capability indexes: role, spatial_id_field, columns, variables, first and last year.

    The columns of one file are a short list inside its row.
    """
    needed = F.array_append(F.array_append(F.col("variables"), F.col("spatial_id_field")), F.lit("year"))
    rule = (
        F.when(_repeats(F.col("columns")), "duplicate-parquet-column")
        .when(F.size(F.array_except(needed, "columns")) > 0, "missing-parquet-column")
        .when(F.col("first_year") > F.col("last_year"), "invalid-year-range")
    )
    bad = parquets.withColumn("rule", rule).where(F.col("rule").isNotNull())
    return _count_rule(parquets, ["role"], "duplicate-parquet-role").unionByName(
        bad.groupBy("document_id", "rule").agg(F.count(F.lit(1)).alias("broken"))
    ).select("document_id", "rule", "broken")


def unsafe_content(documents: DataFrame) -> DataFrame:
    """DQ-04: secret-bearing keys and web addresses with user info, query or fragment in a
    document's JSON text (``document_id``, ``body``)."""
    addresses = F.regexp_extract_all("body", F.lit(r'"(https?://[^"\\]*)"'), F.lit(1))
    unsafe = F.filter(addresses, lambda a: ~is_public_https(a))
    return documents.select(
        "document_id",
        F.size(F.filter(secret_keys_in_json(F.col("body")), lambda k: k != "secret_ref")).alias("secret_keys"),
        F.size(unsafe).alias("unsafe_addresses"),
    )
