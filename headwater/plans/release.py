"""Release plans as DataFrames: classify, guard, invert, check, merge, apply, verify.

Run states carry one row per watershed key: collection, runid, run_fingerprint, the part
fingerprints and the three actual counts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.functions.canonical import merge_attributes
from headwater.operators.ingest import upsert
from headwater.operators.keys import join_large_parents, strictly_increasing

# Change channels in canonical order, and the removal thresholds.
CHANNELS = ["identity", "metadata", "geometry", "children", "capability"]
MAX_REMOVALS = 5
MAX_REMOVAL_RATIO = 0.10

COUNTS = ["watersheds", "subcatchments", "channels"]
CHILD_FIELDS = [
    "subcatchment_fingerprint", "channel_fingerprint", "hillslope_fingerprint", "soil_fingerprint",
    "landuse_fingerprint", "actual_subcatchments", "actual_channels",
]
STATE_FIELDS = ["runid", "run_fingerprint", "capability_fingerprint"]
_ALL = [
    "collection", *STATE_FIELDS, "metadata_fingerprint", "geometry_fingerprint", *CHILD_FIELDS,
    "actual_watersheds",
]


def _side(states: DataFrame, prefix: str) -> DataFrame:
    return states.select(
        "watershed_key", F.lit(True).alias(f"_{prefix}"), *[F.col(f).alias(f"_{prefix}_{f}") for f in _ALL]
    )


def _differs(*fields: str) -> Column:
    return reduce(
        lambda a, b: a | b, [~F.col(f"_before_{f}").eqNullSafe(F.col(f"_after_{f}")) for f in fields]
    )


def plan_forward(base: DataFrame, target: DataFrame) -> DataFrame:
    """REL-01 and JN-08: one action per watershed key of either release.

    Keys are unique on both sides, so the full outer join spreads evenly. ``disagrees``
    marks rows where a classified change and the run fingerprints contradict each other.
    """
    joined = _side(base, "before").join(_side(target, "after"), "watershed_key", "full_outer")
    had, has = F.col("_before").isNotNull(), F.col("_after").isNotNull()
    fingerprint_moved = _differs("run_fingerprint")
    one_sided = ~had | ~has
    capability = F.coalesce("_after_capability_fingerprint", "_before_capability_fingerprint").isNotNull()
    flags = {
        "identity": one_sided | _differs("collection", "runid"),
        "metadata": one_sided | _differs("metadata_fingerprint"),
        "geometry": one_sided | _differs("geometry_fingerprint"),
        "children": one_sided | _differs(*CHILD_FIELDS),
        "capability": F.when(one_sided, capability).otherwise(_differs("capability_fingerprint")),
    }
    found = F.array_compact(F.array(*[F.when(flags[c], F.lit(c)) for c in CHANNELS]))
    # A moved run fingerprint that no part explains is put down to identity.
    channels = F.when(fingerprint_moved & (F.size(found) == 0), F.array(F.lit("identity"))).otherwise(found)
    count = lambda side, name: F.coalesce(F.col(f"_{side}_actual_{name}"), F.lit(0))
    return joined.withColumn("change_channels", channels).select(
        "watershed_key",
        F.when(~had, "add").when(~has, "remove").when(F.size("change_channels") > 0, "change")
        .otherwise(F.lit("retain")).alias("operation"),
        *[F.col(f"_before_{f}").alias(f"before_{f}") for f in STATE_FIELDS],
        *[F.col(f"_after_{f}").alias(f"after_{f}") for f in STATE_FIELDS],
        "change_channels",
        *[(count("after", n) - count("before", n)).cast("bigint").alias(f"delta_{n}") for n in COUNTS],
        (had & has & ((F.size("change_channels") > 0) != fingerprint_moved)).alias("disagrees"),
    )


def plan_empty_build(target: DataFrame) -> DataFrame:
    """REL-03: everything is added."""
    return plan_forward(target.limit(0), target)


def plan_inverse(plan: DataFrame) -> DataFrame:
    """REL-04: the exact mirror: sides swapped, add and remove exchanged, deltas negated."""
    mirrored = F.when(F.col("operation") == "add", "remove").when(
        F.col("operation") == "remove", "add"
    ).otherwise(F.col("operation"))
    return plan.select(
        "watershed_key", mirrored.alias("operation"),
        *[F.col(f"after_{f}").alias(f"before_{f}") for f in STATE_FIELDS],
        *[F.col(f"before_{f}").alias(f"after_{f}") for f in STATE_FIELDS],
        "change_channels", *[(-F.col(f"delta_{n}")).alias(f"delta_{n}") for n in COUNTS], "disagrees",
    )


def plan_totals(plan: DataFrame, authorised: bool = False) -> DataFrame:
    """AGG-18 and REL-02: one row of action counts, row deltas and the removal guard."""
    n = lambda operation: F.count_if(F.col("operation") == operation)
    base_size = n("remove") + n("change") + n("retain")
    ratio = F.coalesce(n("remove") / F.nullif(base_size.cast("double"), F.lit(0.0)), F.lit(0.0))
    allowed = F.lit(authorised) | ((n("remove") <= MAX_REMOVALS) & (ratio <= MAX_REMOVAL_RATIO))
    return plan.agg(
        *[n(o).alias(f"actions_{o}") for o in ("add", "change", "remove", "retain")],
        *[F.coalesce(F.sum(f"delta_{c}"), F.lit(0)).alias(f"delta_{c}") for c in COUNTS],
        ratio.alias("removal_ratio"), allowed.alias("allowed"), F.count_if("disagrees").alias("disagreements"),
    )


def plan_violations(plans: DataFrame, headers: DataFrame, kind: str = "forward") -> DataFrame:
    """REL-05: the rules each plan breaks, with how many actions break them.

    ``plans``: plan_id, position and the action columns. ``headers``: plan_id, base, target
    and expected_<count>; base and target are state texts, ``EMPTY`` for an empty base.
    """
    same_state = reduce(
        lambda a, b: a & b, [F.col(f"before_{f}").eqNullSafe(F.col(f"after_{f}")) for f in STATE_FIELDS]
    )
    still = reduce(lambda a, b: a & b, [F.col(f"delta_{c}") == 0 for c in COUNTS])
    ordered = F.filter(
        F.array(*[F.lit(c) for c in CHANNELS]), lambda c: F.array_contains(F.col("change_channels"), c)
    )
    operation = F.col("operation")
    row_rules = {
        "channel-order": F.col("change_channels") != ordered,
        "retain-state": (operation == "retain") & ~same_state,
        "retain-delta": (operation == "retain") & ~still,
        "change-state": (operation == "change") & same_state,
        "empty-operation": F.lit(kind == "empty-build") & (operation != "add"),
    }
    # Extra members of repeated keys, counted per key so that no list of keys is built.
    repeats = plans.groupBy("plan_id", "watershed_key").count().groupBy("plan_id").agg(
        F.sum(F.col("count") - 1).alias("broken")
    ).select("plan_id", F.lit("action-identity").alias("rule"), "broken")
    unordered = strictly_increasing(plans, "plan_id", "position", "watershed_key").select(
        "plan_id", F.lit("action-order").alias("rule"), F.col("breaks").alias("broken")
    )
    summed = plans.groupBy("plan_id").agg(
        *[F.count_if(rule).alias(name) for name, rule in row_rules.items()],
        *[F.sum(f"delta_{c}").alias(f"_sum_{c}") for c in COUNTS],
    )
    joined = headers.join(summed, "plan_id", "left")
    totals_differ = reduce(
        lambda a, b: a | b,
        [F.coalesce(F.col(f"_sum_{c}"), F.lit(0)) != F.col(f"expected_{c}") for c in COUNTS],
    )
    header_rules = {
        "row-delta-total": totals_differ.cast("bigint"),
        "same-state-plan": (F.col("base") == F.col("target")).cast("bigint"),
        "empty-base": (F.lit(kind == "empty-build") & (F.col("base") != "EMPTY")).cast("bigint"),
        "empty-actions": (F.lit(kind == "empty-build") & F.col(next(iter(row_rules))).isNull()).cast("bigint"),
    }
    checks = {**{name: F.coalesce(F.col(name), F.lit(0)) for name in row_rules}, **header_rules}
    wide = joined.select("plan_id", *[c.alias(name) for name, c in checks.items()])
    pairs = ", ".join(f"'{name}', `{name}`" for name in checks)
    stacked = wide.select("plan_id", F.expr(f"stack({len(checks)}, {pairs}) AS (rule, broken)"))
    return stacked.unionByName(repeats).unionByName(unordered).where(F.col("broken") > 0)


def inverse_violations(forward: DataFrame, inverse: DataFrame) -> DataFrame:
    """REL-05, inverse part: the number of keys breaking each mirror rule."""
    expected = plan_inverse(forward)
    fields = [c for c in expected.columns if c not in ("watershed_key", "disagrees")]
    joined = expected.select("watershed_key", F.lit(1).alias("_e"), *[F.col(f).alias(f"_e_{f}") for f in fields]).join(
        inverse.select("watershed_key", F.lit(1).alias("_i"), *[F.col(f).alias(f"_i_{f}") for f in fields]),
        "watershed_key", "full_outer",
    )
    paired = F.col("_e").isNotNull() & F.col("_i").isNotNull()
    group = lambda prefix: [f for f in fields if f.startswith(prefix)]
    broken = lambda names: F.count_if(
        paired & reduce(lambda a, b: a | b, [~F.col(f"_e_{f}").eqNullSafe(F.col(f"_i_{f}")) for f in names])
    )
    rules = {
        "inverse-action-key": F.count_if(~paired),
        "inverse-operation": broken(["operation"]),
        "inverse-before": broken(group("before_")),
        "inverse-after": broken(group("after_")),
        "inverse-channels": broken(["change_channels"]),
        "inverse-delta": broken(group("delta_")),
    }
    pairs = ", ".join(f"'{name}', `{name}`" for name in rules)
    return joined.agg(*[c.alias(n) for n, c in rules.items()]).select(
        F.expr(f"stack({len(rules)}, {pairs}) AS (rule, broken)")
    )


def merge_children(existing: DataFrame, staged: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """REL-06: existing and staged child rows by key, each with its action.

    Absent from staging: deleted. New: created. In both: updated, changed or not;
    ``really_changed`` tells them apart. The new table is every row not deleted.
    """
    left = existing.select(*key, F.lit(True).alias("_old"), *[F.col(f).alias(f"_o_{f}") for f in fields])
    right = staged.select(*key, F.lit(True).alias("_new"), *[F.col(f).alias(f"_n_{f}") for f in fields])
    joined = left.join(right, key, "full_outer")
    action = F.when(F.col("_new").isNull(), "deleted").when(F.col("_old").isNull(), "created").otherwise(F.lit("updated"))
    changed = reduce(lambda a, b: a | b, [~F.col(f"_o_{f}").eqNullSafe(F.col(f"_n_{f}")) for f in fields])
    return joined.select(
        *key, *[F.when(F.col("_new").isNull(), F.col(f"_o_{f}")).otherwise(F.col(f"_n_{f}")).alias(f) for f in fields],
        action.alias("action"), ((action == "updated") & changed).alias("really_changed"),
    )


def merge_counts(merged: DataFrame, groups: list[str] = []) -> DataFrame:
    n = lambda action: F.count_if(F.col("action") == action).alias(action)
    return merged.groupBy(*groups).agg(
        n("created"), n("updated"), n("deleted"), F.count_if("really_changed").alias("really_changed")
    )


def _actions(plan: DataFrame) -> DataFrame:
    return plan.select("watershed_key", "operation", "change_channels", F.col("after_runid").alias("_runid"))


def apply_to_watersheds(
    watersheds: DataFrame, staged: DataFrame, plan: DataFrame, metadata: list[str], geometry: list[str],
    derived: dict[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """REL-07: the new watershed table. A change rewrites only the channels it lists, and its
    run id; a removal drops the row; an addition takes the staged row whole.

    ``derived`` maps a column, as the simplified boundary, to what makes it from the first geometry column.
    It is made anew where the geometry is taken from staging, and else stays as it was.
    """
    new = staged.select("watershed_key", *[F.col(c).alias(f"_n_{c}") for c in ["runid", *metadata, *geometry]])
    joined = _actions(plan).join(watersheds.withColumn("_here", F.lit(True)), "watershed_key", "left").join(
        new, "watershed_key", "left"
    )
    adding = F.col("operation") == "add"
    takes = lambda channel: adding | (
        (F.col("operation") == "change") & F.array_contains("change_channels", channel)
    )
    pick = lambda c, channel: F.when(takes(channel), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c)
    remade = [
        F.when(takes("geometry"), make(F.when(takes("geometry"), F.col(f"_n_{geometry[0]}")))).otherwise(F.col(c)).alias(c)
        for c, make in (derived or {}).items()
    ]
    return joined.where(F.col("operation") != "remove").select(
        "watershed_key", F.coalesce("_runid", "runid").alias("runid"),
        *[pick(c, "metadata") for c in metadata], *[pick(c, "geometry") for c in geometry], *remade,
    )


def apply_to_children(children: DataFrame, staged: DataFrame, plan: DataFrame, run: str = "watershed_id") -> DataFrame:
    """REL-07: the new child table of one kind.

    Children of removed watersheds go; those of additions and of changes listing
    ``children`` come from staging; the rest stay and follow a renamed run.
    """
    actions = _actions(plan)
    replaced = (F.col("operation") == "add") | (
        (F.col("operation") == "change") & F.array_contains("change_channels", "children")
    )
    # Dealt by all columns of a child: a hot watershed is spread over tasks.
    kept = join_large_parents(children, actions, ["watershed_key"], children.columns, "inner").where((F.col("operation") != "remove") & ~replaced)
    fresh = join_large_parents(
        staged, actions.where(replaced).select("watershed_key", "_runid"), ["watershed_key"], staged.columns, "inner"
    )
    rename = lambda df: df.withColumn(run, F.coalesce("_runid", run)).select(*children.columns)
    return rename(kept).unionByName(rename(fresh))


def apply_to_identities(identities: DataFrame, plan: DataFrame) -> DataFrame:
    """REL-07: removed watersheds retire their identity; every other planned one is active."""
    joined = identities.join(plan.select("watershed_key", "operation"), "watershed_key", "left")
    return joined.withColumn(
        "status",
        F.when(F.col("operation") == "remove", "retired")
        .when(F.col("operation").isNotNull(), "active").otherwise(F.col("status")),
    ).drop("operation")


def apply_to_aliases(aliases: DataFrame, plan: DataFrame) -> DataFrame:
    """REL-07: the target run becomes the current alias; removed identities keep none."""
    moved = _actions(plan).select(F.col("watershed_key").alias("identity_id"), "operation", "_runid")
    joined = join_large_parents(aliases, moved, ["identity_id"], ["runid"]).select(
        "runid", "identity_id",
        F.when(F.col("operation").isNull(), F.col("is_current"))
        .otherwise(F.coalesce(F.col("runid") == F.col("_runid"), F.lit(False))).alias("is_current"),
    )
    wanted = moved.where(F.col("operation") != "remove").select(
        F.col("_runid").alias("runid"), "identity_id", F.lit(True).alias("is_current")
    )
    return upsert(joined, wanted, ["runid"])


def apply_to_capabilities(capabilities: DataFrame, staged: DataFrame, release_id: str) -> DataFrame:
    """REL-07: the capability table with the rows of one release replaced by the staged ones.

    Both tables have release_id; rows of other releases stay as they are.
    """
    others = capabilities.where(~F.col("release_id").eqNullSafe(F.lit(release_id)))
    fresh = staged.withColumn("release_id", F.lit(release_id)).select(*capabilities.columns)
    return others.unionByName(fresh)


def apply_conflicts(watersheds: DataFrame, staged: DataFrame, plan: DataFrame) -> DataFrame:
    """REL-07: where the serving table is not the base that a plan was reviewed for, or staging not its target.

    One row per watershed key and broken rule, with the run expected and the run found:
    ``unplanned`` serving rows, ``repeated`` ones, those ``absent`` or ``drifted`` from the run before,
    ``present`` before they are added; ``unstaged`` watersheds and a ``staged-run`` that is not the plan's.
    """
    one = lambda df, name: df.groupBy("watershed_key").agg(F.count(F.lit(1)).alias(f"_{name}_rows"), F.min("runid").alias(f"_{name}"))
    joined = plan.select("watershed_key", "operation", "before_runid", "after_runid").join(
        one(watersheds, "serving"), "watershed_key", "full_outer"
    ).join(one(staged, "staged"), "watershed_key", "left")
    operation, here, there = F.col("operation"), F.col("_serving_rows").isNotNull(), F.col("_staged_rows").isNotNull()
    before, added, stays = operation != "add", operation == "add", operation != "remove"
    rules = {
        "unplanned": (operation.isNull(), F.lit(None), F.col("_serving")),
        "repeated": (F.col("_serving_rows") > 1, F.col("before_runid"), F.col("_serving")),
        "absent": (before & ~here, F.col("before_runid"), F.lit(None)),
        "drifted": (before & (F.col("_serving") != F.col("before_runid")), F.col("before_runid"), F.col("_serving")),
        "present": (added & here, F.lit(None), F.col("_serving")),
        "unstaged": (stays & ~there, F.col("after_runid"), F.lit(None)),
        "staged-run": (stays & there & (F.col("_staged") != F.col("after_runid")), F.col("after_runid"), F.col("_staged")),
    }
    found = F.array_compact(F.array(*[
        F.when(broken, F.struct(F.lit(rule).alias("rule"), expected.cast("string").alias("expected"), observed.cast("string").alias("observed")))
        for rule, (broken, expected, observed) in rules.items()
    ]))
    return joined.select("watershed_key", F.explode(found).alias("_f")).select("watershed_key", "_f.*")


def merge_result(plan: DataFrame, children: DataFrame, capabilities: DataFrame) -> DataFrame:
    """REL-14: runs per operation, child rows per action and capability rows, one row."""
    runs = plan.groupBy("operation").count().select(F.concat(F.lit("runs_"), "operation").alias("measure"), "count")
    acted = children.groupBy("action").count().select(F.concat(F.lit("children_"), "action").alias("measure"), "count")
    held = capabilities.agg(F.count(F.lit(1)).alias("count")).select(F.lit("capability_rows").alias("measure"), "count")
    return runs.unionByName(acted).unionByName(held)


def ledger_check(observed: DataFrame, ledger: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """REL-11 and REL-13: recomputed fingerprints and counts against the ledger, per key."""
    left = observed.select(key, F.lit(1).alias("_o"), *[F.col(f).alias(f"_o_{f}") for f in fields])
    right = ledger.select(key, F.lit(1).alias("_l"), *[F.col(f).alias(f"_l_{f}") for f in fields])
    joined = left.join(right, key, "full_outer")
    differing = F.array_compact(
        F.array(*[F.when(~F.col(f"_o_{f}").eqNullSafe(F.col(f"_l_{f}")), F.lit(f)) for f in fields])
    )
    status = (
        F.when(F.col("_l").isNull(), "unlisted").when(F.col("_o").isNull(), "absent")
        .when(F.size(differing) > 0, "differs").otherwise(F.lit("equal"))
    )
    return joined.select(
        key, status.alias("status"),
        F.when(F.col("_o").isNotNull() & F.col("_l").isNotNull(), F.array_join(differing, ",")).otherwise(F.lit("")).alias("fields"),
    )


def adopt(observed: DataFrame, baseline: DataFrame, ledger: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """REL-13: the ledger with the adopted runs appended: those equal to the baseline and not
    in the ledger yet."""
    equal = ledger_check(observed, baseline, key, fields).where(F.col("status") == "equal").select(key)
    fresh = baseline.join(equal, key, "left_semi").join(ledger.select(key), key, "left_anti")
    return ledger.unionByName(fresh, allowMissingColumns=True)


def derived_values(staged: DataFrame, attributes: str, allowed: dict[str, str], defaults: str | None = None) -> DataFrame:
    """REL-10: one typed column per allowed name, null unless staged; ``unknown`` lists the rest."""
    given = F.col(attributes) if defaults is None else merge_attributes(F.col(defaults), F.col(attributes))
    names = F.array(*[F.lit(n) for n in sorted(allowed)])
    kept = [c for c in staged.columns if c not in (attributes, defaults)]
    return staged.select(
        *kept,
        *[F.try_element_at(given, F.lit(name)).try_cast(kind).alias(name) for name, kind in allowed.items()],
        F.array_sort(F.array_except(F.map_keys(given), names)).alias("unknown"),
    )


def write_version(tables: dict[str, DataFrame], root: str, release_id: str) -> None:
    """REL-07: write all tables under ``release=<id>``; readers move by the pointer alone."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/release={release_id}/{name}")


def activate(spark, root: str, release_id: str, manifest_sha256: str) -> None:
    """The one-row active pointer, replaced after every table of the release is in place."""
    spark.createDataFrame(
        [("ACTIVE", release_id, manifest_sha256)], "state string, release_id string, manifest_sha256 string"
    ).write.mode("overwrite").parquet(f"{root}/active")
