"""Stable identities: current run, resolution of run ids, audits, switches, change classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.functions.text import STABLE_KEY, matches
from headwater.operators import keys as K


def with_current_runid(watersheds: DataFrame, aliases: DataFrame, identity: str = "logical_id") -> DataFrame:
    """JN-10: the current alias of the identity, else the watershed's own run id."""
    current = aliases.where("is_current").groupBy(F.col("identity_id").alias(identity)).agg(
        F.min("runid").alias("_current")
    )
    return watersheds.join(current, identity, "left").withColumn(
        "current_runid", F.coalesce("_current", "runid")
    ).drop("_current")


def resolve_runs(
    requests: DataFrame, aliases: DataFrame, identities: DataFrame, watersheds: DataFrame
) -> DataFrame:
    """JN-11: what each requested run id stands for: found, gone (retired) or not found.

    An alias leads to its identity and on to the identity's watershed; without an alias the
    id may be that of a watershed itself. Repeated requests are combined before the joins.
    """
    asked = requests.groupBy("runid").agg(F.count(F.lit(1)).alias("requests"))
    by_alias = aliases.select("runid", "identity_id")
    by_identity = identities.select("identity_id", "status")
    of_identity = watersheds.where(F.col("logical_id").isNotNull()).groupBy(
        F.col("logical_id").alias("identity_id")
    ).agg(F.min("runid").alias("_by_identity"))
    direct = watersheds.select("runid", F.col("runid").alias("_direct"))
    states = by_identity.join(of_identity, "identity_id", "full_outer")
    joined = K.join_large_parents(asked.join(by_alias, "runid", "left"), states, ["identity_id"], ["runid"]).join(direct, "runid", "left")
    known = F.col("identity_id").isNotNull()
    retired = known & (F.col("status") == "retired")
    found = F.when(known & ~retired, F.col("_by_identity")).when(~known, F.col("_direct"))
    return joined.select(
        "runid", "requests", found.alias("watershed"),
        F.when(retired, "gone").when(found.isNotNull(), "found").otherwise(F.lit("not found")).alias("status"),
    )


def identity_report(
    watersheds: DataFrame, subcatchments: DataFrame, channels: DataFrame,
    identities: DataFrame, aliases: DataFrame,
) -> DataFrame:
    """AGG-15: eight violation counts and six totals, one row each, with the overall status.

    Every table is read once, watersheds twice: as parents and grouped by identity.
    """
    current = aliases.groupBy("identity_id").agg(
        F.count_distinct(F.when(F.col("is_current"), F.col("runid"))).alias("_aliases"), F.count(F.lit(1)).alias("_alias_rows")
    )
    serving = watersheds.groupBy(F.col("logical_id").alias("identity_id")).agg(
        F.count_distinct("runid").alias("_watersheds"), F.count(F.lit(1)).alias("_watershed_rows")
    )
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    # Rows of no identity, or of one that is not listed, count in the totals too; null keys never meet.
    states = (
        identities.select("identity_id", "status", "watershed_key", F.lit(True).alias("_listed"))
        .join(current, "identity_id", "full_outer").join(serving, "identity_id", "full_outer")
    )
    listed = F.col("_listed").isNotNull()
    active, retired = listed & (F.col("status") == "active"), listed & (F.col("status") == "retired")
    rows = lambda name: F.coalesce(F.sum(name), F.lit(0))
    own = states.agg(
        F.coalesce(F.sum(F.when(F.col("identity_id").isNull(), F.col("_watershed_rows"))), F.lit(0)).alias("missing"),
        F.count_if(active & (zero("_watersheds") != 1)).alias("watersheds"), F.count_if(active & (zero("_aliases") != 1)).alias("aliases"),
        F.count_if(retired & (zero("_aliases") != 0)).alias("retired"), F.count_if(listed).alias("identities"),
        F.count_if(listed & F.col("watershed_key").isNotNull()).alias("assigned"), rows("_watershed_rows").alias("watershed_rows"), rows("_alias_rows").alias("alias_rows"),
    )
    children = {"subcatchment": subcatchments, "channel": channels}
    links = K.of_children(
        K.link_report(children, "watershed_id", watersheds, "runid", "logical_id"), list(children), ["rows", "missing", "audit"]
    )
    violations = K.stacked(own, {
        "watersheds_without_logical_identity": F.col("missing"),
        "active_identities_without_one_watershed": F.col("watersheds"),
        "active_identities_without_one_current_alias": F.col("aliases"),
        "retired_identities_with_current_alias": F.col("retired"),
    }).unionByName(K.stacked(links, {
        "subcatchments_without_logical_identity": F.col("subcatchment_missing"),
        "channels_without_logical_identity": F.col("channel_missing"),
        "subcatchment_identity_mismatches": F.col("subcatchment_audit"),
        "channel_identity_mismatches": F.col("channel_audit"),
    })).withColumn("section", F.lit("violation"))
    counts = K.stacked(own, {
        "watersheds": F.col("watershed_rows"), "identities": F.col("identities"), "assigned_watershed_keys": F.col("assigned"), "run_aliases": F.col("alias_rows"),
    }).unionByName(K.stacked(links, {"subcatchments": F.col("subcatchment_rows"), "channels": F.col("channel_rows")})).withColumn("section", F.lit("total"))
    return violations.unionByName(counts).select(
        "section", "code", "count",
        F.when(F.col("section") == "total", "info").when(F.col("count") == 0, "passed")
        .otherwise(F.lit("failed")).alias("status"),
    )


def audit_report(tables: dict[str, tuple[DataFrame, list[str], list[str] | None]], parents: DataFrame) -> DataFrame:
    """DQ-03: per table its rows, repeated business and logical keys and orphans.

    ``tables`` maps a name to (rows, business key, logical key or None); rows of child tables
    carry ``watershed_id``. An empty set of tables gets a warning instead of a clean bill. A table is read once for
    its keys, the child tables once more, together, for their parents.
    """
    reports = []
    for name, (df, business, logical) in tables.items():
        keysets = {"business": business, **({"logical": logical} if logical else {}), "all": []}
        found = K.key_repeats(df, keysets, {"logical"})
        codes = {
            "row_count": F.col("all_count"), "duplicate_business_key_groups": F.col("business_groups"), "duplicate_business_key_rows": F.col("business_rows"),
            **({"duplicate_logical_key_groups": F.col("logical_groups")} if logical else {}),
        }
        reports.append(K.stacked(found, codes).withColumn("table", F.lit(name)))
    children = {name: df.select("watershed_id", F.lit(None).cast("string").alias("_none")) for name, (df, _, _) in tables.items() if "watershed_id" in df.columns}
    if children:
        links = K.of_children(
            K.link_report(children, "watershed_id", parents.withColumn("_none", F.lit(None).cast("string")), "runid", "_none"), list(children), ["orphans"]
        )
        orphans = K.stacked(links, {name: F.col(f"{name}_orphans") for name in children})
        reports.append(orphans.select(F.lit("orphan_rows").alias("code"), "count", F.col("code").alias("table")))
    report = reports[0]
    for other in reports[1:]:
        report = report.unionByName(other)
    bad = F.col("code").isin("duplicate_business_key_groups", "duplicate_logical_key_groups", "orphan_rows")
    return report.select(
        "table", "code", "count",
        F.when(bad & (F.col("count") > 0), "violation")
        .when((F.col("code") == "row_count") & (F.col("count") == 0), "warning")
        .otherwise(F.lit("ok")).alias("finding"),
    )


def switch_aliases(aliases: DataFrame, switches: DataFrame) -> DataFrame:
    """REL-08: make each switched run the current alias of its identity.

    ``switches``: identity_id, runid. A run bound to another identity is a conflict: its row
    and the identity's aliases stay as they were. Returns the new alias table with ``action``.
    """
    bound = aliases.select("runid", F.col("identity_id").alias("_bound"), F.col("is_current").alias("_was"))
    checked = switches.join(bound, "runid", "left").withColumn(
        "_conflict", F.col("_bound").isNotNull() & (F.col("_bound") != F.col("identity_id"))
    )
    valid = checked.where(~F.col("_conflict"))
    moved = valid.select("identity_id", F.col("runid").alias("_new"))
    kept = K.join_large_parents(aliases, moved, ["identity_id"], ["runid"]).select(
        "runid", "identity_id",
        F.when(F.col("_new").isNull(), F.col("is_current")).otherwise(F.col("runid") == F.col("_new")).alias("is_current"),
        F.when(F.col("_new").isNull(), F.lit("kept"))
        .when(F.col("runid") == F.col("_new"), F.when(F.col("is_current"), "unchanged").otherwise(F.lit("activated")))
        .when(F.col("is_current"), "cleared").otherwise(F.lit("kept")).alias("action"),
    )
    created = valid.where(F.col("_bound").isNull()).select(
        "runid", "identity_id", F.lit(True).alias("is_current"), F.lit("created").alias("action")
    )
    conflicts = checked.where("_conflict").select(
        "runid", "identity_id", F.lit(False).alias("is_current"), F.lit("conflict").alias("action")
    )
    return kept.unionByName(created).unionByName(conflicts)


def check_assignments(
    assignments: DataFrame, watersheds: DataFrame, identities: DataFrame, aliases: DataFrame
) -> DataFrame:
    """REL-09: the first rule each reviewed assignment breaks, or ``accepted``.

    ``assignments``: runid, watershed_key, collection. ``identities``: identity_id,
    watershed_key, collection, unique by key. Repeats are found by counting, not by a window
    over one key.
    """
    per_run = assignments.groupBy("runid").agg(F.count(F.lit(1)).alias("_runs"))
    per_key = assignments.groupBy("watershed_key").agg(F.count(F.lit(1)).alias("_keys"))
    known = identities.select(
        "watershed_key", F.col("identity_id").alias("_identity"), F.col("collection").alias("_collection")
    )
    serving = watersheds.select("runid", F.lit(True).alias("_serving"), F.col("logical_id").alias("_logical"))
    bound = aliases.select("runid", F.col("identity_id").alias("_bound"))
    joined = (
        assignments.join(per_run, "runid").join(per_key, "watershed_key").join(known, "watershed_key", "left")
        .join(serving, "runid", "left").join(bound, "runid", "left")
    )
    differs = lambda name: F.col(name).isNotNull() & ~F.col(name).eqNullSafe(F.col("_identity"))
    return joined.select(
        "runid", "watershed_key",
        F.when(F.col("_runs") > 1, "duplicate-runid")
        .when(F.col("_keys") > 1, "duplicate-key")
        .when(~matches(F.col("watershed_key"), STABLE_KEY), "key-format")
        .when(F.col("_serving").isNull(), "unknown-run")
        .when(F.col("_identity").isNotNull() & ~F.col("_collection").eqNullSafe(F.col("collection")), "identity-conflict")
        .when(F.col("_logical").isNotNull() & differs("_logical"), "identity-conflict")
        .when(differs("_bound"), "alias-conflict")
        .otherwise(F.lit("accepted")).alias("outcome"),
        F.coalesce("_identity", F.concat(F.lit("new:"), "watershed_key")).alias("identity_id"),
    )


def propagate_identity(children: DataFrame, watersheds: DataFrame) -> DataFrame:
    """REL-09: children take the identity of their watershed."""
    parent = watersheds.select(F.col("runid").alias("watershed_id"), F.col("logical_id").alias("_parent"))
    return K.join_large_parents(children, parent, ["watershed_id"], children.columns).withColumn(
        "logical_id", F.coalesce("_parent", "logical_id")
    ).drop("_parent")


def classify_changes(changes: DataFrame) -> DataFrame:
    """DQ-05: accept or reject each declared identity change, with its class or broken rule.

    ``before`` and ``after`` are structs of six arrays (watershed_keys, collection_keys,
    runids, display_names, aliases, tombstones) and three fingerprints; ``kind``,
    ``reviewed`` and ``conflict_code`` are plain columns.
    """
    b = lambda name: F.col(f"before.{name}")
    a = lambda name: F.col(f"after.{name}")
    same = lambda name: b(name) == a(name)
    within = lambda inner, outer: F.size(F.array_except(inner, outer)) == 0
    disjoint = lambda x, y: F.size(F.array_intersect(x, y)) == 0
    same_identity = same("watershed_keys") & same("collection_keys") & same("runids")
    lists = ("watershed_keys", "collection_keys", "runids", "display_names", "aliases", "tombstones")
    prints = ("metadata_fingerprint", "geometry_fingerprint", "child_fingerprint")
    reviewed = F.col("reviewed")
    tombstoned = within(b("watershed_keys"), a("tombstones"))
    fresh_keys = disjoint(b("watershed_keys"), a("watershed_keys"))

    def sound(side: Column) -> Column:
        ok = F.lit(True)
        for name in lists:
            ok = ok & (F.size(side[name]) == F.size(F.array_distinct(side[name])))
        for name in ("watershed_keys", "collection_keys", "tombstones"):
            ok = ok & F.forall(side[name], lambda k: k.rlike(STABLE_KEY) & (F.length(k) <= 96))
        for name in prints:
            ok = ok & (F.coalesce(side[name], F.lit("")) != "")
        return ok

    changed_only = lambda moved: same_identity & ~same(moved) & _others_same(same, prints, moved)
    rules = {
        "retained": F.col("before") == F.col("after"),
        "renamed": changed_only("metadata_fingerprint") & ~same("display_names"),
        "replaced": same("watershed_keys") & same("collection_keys") & ~same("runids")
        & within(b("runids"), a("aliases")) & reviewed,
        "moved": same("watershed_keys") & ~same("collection_keys") & reviewed,
        "split": (F.size(b("watershed_keys")) == 1) & (F.size(a("watershed_keys")) >= 2) & fresh_keys
        & tombstoned & reviewed,
        "merged": (F.size(b("watershed_keys")) >= 2) & (F.size(a("watershed_keys")) == 1) & fresh_keys
        & tombstoned & reviewed,
        "metadata_only": changed_only("metadata_fingerprint"),
        "geometry_only": changed_only("geometry_fingerprint"),
        "removed": (F.size(b("watershed_keys")) >= 1) & (F.size(a("watershed_keys")) == 0) & tombstoned & reviewed,
    }
    code = F.col("conflict_code")
    conflict_holds = (
        F.when(code == "ambiguous-identity", ~reviewed & ~same("runids"))
        .when(code == "metadata-authority-conflict", same_identity & ~same("metadata_fingerprint"))
        .when(code == "tombstoned-key-reuse", ~disjoint(a("watershed_keys"), b("tombstones")))
        .otherwise(F.lit(False))
    )
    kind = F.col("kind")
    rule_holds = F.lit(False)
    for name, rule in rules.items():
        rule_holds = F.when(kind == name, rule).otherwise(rule_holds)
    states_ok = sound(F.col("before")) & sound(F.col("after"))
    decision = (
        F.when(~states_ok, F.struct(F.lit("invalid").alias("decision"), F.lit("state").alias("code")))
        .when(
            kind == "unresolved",
            F.when(conflict_holds, F.struct(F.lit("reject").alias("decision"), code.alias("code")))
            .otherwise(F.struct(F.lit("invalid").alias("decision"), F.lit("conflict").alias("code"))),
        )
        .when(
            code.isNull() & rule_holds,
            F.struct(F.lit("accept").alias("decision"), kind.alias("code")),
        )
        .otherwise(F.struct(F.lit("invalid").alias("decision"), F.lit("rule").alias("code")))
    )
    return changes.withColumn("_d", decision).withColumn("decision", F.col("_d.decision")).withColumn(
        "code", F.col("_d.code")
    ).drop("_d")


def _others_same(same, prints: tuple[str, ...], moved: str) -> Column:
    ok = F.lit(True)
    for name in prints:
        if name != moved:
            ok = ok & same(name)
    return ok
