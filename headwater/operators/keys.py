"""Key and membership checks. Children are always combined per key before they meet a parent,
so a parent with a large share of all children is one row by the time of the join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Parts over which the children of one parent are dealt, so that a hot parent is no single task.
SALTS = 32


def join_parents(children: DataFrame, parents: DataFrame, on: list[str], child: list[str], how: str = "left") -> DataFrame:
    """Children with the columns of their parent, safe where one parent has a large share of all children.

    Children are dealt by a hash of their own key ``child`` over ``SALTS`` parts, and the parents, narrow
    rows, are repeated for each part. ``on`` columns come first, as in a join by name. For few parents, as groups
    are: Spark's size estimate does not see the repeats, and would broadcast many.
    """
    dealt = children.withColumn("_salt", F.pmod(F.xxhash64(*child), F.lit(SALTS)).cast("int"))
    repeated = parents.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(repeated, [*on, "_salt"], how).drop("_salt")


# A key with more than this share of all children is hot. There are fewer than 1000 such keys, whatever the data.
HOT_SHARE = 1000


def join_large_parents(children: DataFrame, parents: DataFrame, on: list[str], child: list[str], how: str = "left") -> DataFrame:
    """As ``join_parents``, for parents of any number: only those of hot keys are repeated.

    Hot keys are found by counting the children per key, combined before the shuffle. Children with a null key, which
    have no parent, are dealt as well. Both sides are sorted and merged: their size on disk says little about
    their size in memory, so neither is ever sent whole through the driver.
    """
    counts = children.groupBy(*on).count()
    total = counts.agg(F.sum("count")).scalar()
    hot = counts.where((F.col("count") > SALTS) & (F.col("count") * HOT_SHARE > total))
    marks = F.broadcast(hot.select(*on, F.lit(True).alias("_hot")))
    spread = F.pmod(F.xxhash64(*child), F.lit(SALTS)).cast("int")
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    dealt = children.join(marks, on, "left").withColumn("_salt", F.when(F.col("_hot") | ~known, spread).otherwise(0)).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    repeated = parents.join(marks, on, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return dealt.join(repeated.hint("merge"), [*on, "_salt"], how).drop("_salt")


def duplicate_summary(df: DataFrame, key: list[str], skip_null_first: bool = False) -> DataFrame:
    """AGG-11: number of key groups with more than one row, and the rows in them."""
    rows = df.where(F.col(key[0]).isNotNull()) if skip_null_first else df
    repeated = rows.groupBy(*key).count().where(F.col("count") > 1)
    return repeated.agg(
        F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows")
    )


def join_key_check(df: DataFrame, key: str, within: list[str] = []) -> DataFrame:
    """AGG-12 and AGG-13: null keys, blank keys, all members of repeated keys, and extra members."""
    counted = df.groupBy(*within, key).count()
    repeated = (F.col("count") > 1) & F.col(key).isNotNull()
    total = lambda when, what: F.coalesce(F.sum(F.when(when, what)), F.lit(0))
    return counted.groupBy(*within).agg(
        total(F.col(key).isNull(), F.col("count")).alias("null_rows"),
        total(F.trim(F.col(key).cast("string")) == "", F.col("count")).alias("blank_rows"),
        total(repeated, F.col("count")).alias("duplicate_rows"),
        total(repeated, F.col("count") - 1).alias("extra_rows"),
    )


def orphan_rows(children: DataFrame, foreign_key: str, parents: DataFrame, key: str) -> DataFrame:
    """JN-09: number of child rows whose parent does not exist."""
    counted = children.groupBy(F.col(foreign_key).alias(key)).count()
    missing = counted.join(parents.select(key), key, "left_anti")
    return missing.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("orphan_rows"))


def identity_mismatches(
    children: DataFrame, foreign_key: str, parents: DataFrame, key: str, identity: str, audit: bool = True
) -> DataFrame:
    """JN-12: child rows whose identity differs from that of their parent.

    The audit form also counts rows where either identity is unknown; the migration form
    skips children without an identity and uses DISTINCT FROM.
    """
    counted = children.groupBy(F.col(foreign_key).alias(key), F.col(identity).alias("_child")).count()
    joined = counted.join(parents.select(key, F.col(identity).alias("_parent")), key, "left" if audit else "inner")
    if audit:
        differs = ~F.coalesce(F.col("_child") == F.col("_parent"), F.lit(False))
    else:
        differs = F.col("_child").isNotNull() & ~F.col("_child").eqNullSafe(F.col("_parent"))
    return joined.where(differs).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("mismatched_rows"))


def compare_membership(left: DataFrame, right: DataFrame, columns: list[str], groups: list[str] = []) -> DataFrame:
    """JN-14 and JN-15: members on one side only, and whether the two sets are equal.

    One shuffle on the members themselves: both sides are tagged and grouped together.
    """
    tagged = left.select(*groups, *columns, F.lit(0).alias("_side")).unionByName(
        right.select(*groups, *columns, F.lit(1).alias("_side"))
    )
    members = tagged.groupBy(*groups, *columns).agg(F.min("_side").alias("_min"), F.max("_side").alias("_max"))
    return members.groupBy(*groups).agg(
        F.count_if(F.col("_max") == 0).alias("left_only"),
        F.count_if(F.col("_min") == 1).alias("right_only"),
        F.count_if(F.col("_min") != F.col("_max")).alias("common"),
    ).withColumn("equal", (F.col("left_only") == 0) & (F.col("right_only") == 0))


def strictly_increasing(df: DataFrame, group: str, position: str, key: str, span: int = 65_536) -> DataFrame:
    """WIN-03: per group the null keys and the places where a key does not exceed the one before.

    Rows are compared inside stretches of ``span`` positions, then the stretches by their
    first and last keys, so a very large group is many bounded windows.
    """
    stretch = F.floor(F.col(position) / span)
    rows = df.select(group, F.col(position).alias("_at"), F.col(key).alias("_key"), stretch.alias("_stretch"))
    inside = Window.partitionBy(group, "_stretch").orderBy("_at")
    keyed = rows.where(F.col("_key").isNotNull()).withColumn("_before", F.lag("_key").over(inside))
    stretches = keyed.groupBy(group, "_stretch").agg(
        F.count_if(F.col("_key") <= F.col("_before")).alias("_breaks"), F.count(F.lit(1)).alias("_rows"),
        F.min_by("_key", "_at").alias("_first"), F.max_by("_key", "_at").alias("_last"),
    )
    along = Window.partitionBy(group).orderBy("_stretch")
    joined = stretches.withColumn("_previous", F.lag("_last").over(along))
    kept = joined.groupBy(group).agg(
        F.sum("_rows").alias("_keyed"),
        (F.sum("_breaks") + F.count_if(F.col("_first") <= F.col("_previous"))).alias("_breaks"),
    )
    totals = rows.groupBy(group).agg(F.count(F.lit(1)).alias("rows"))
    breaks = F.coalesce("_breaks", F.lit(0))
    nulls = F.col("rows") - F.coalesce("_keyed", F.lit(0))
    return totals.join(kept, group, "left").select(
        group, "rows", nulls.alias("null_keys"), breaks.alias("breaks"),
        ((nulls == 0) & (breaks == 0)).alias("increasing"),
    )


def current_conflicts(aliases: DataFrame, identity: str = "identity_id", flag: str = "is_current") -> DataFrame:
    """WIN-05: identities with more than one current alias."""
    return aliases.groupBy(identity).agg(F.count_if(F.col(flag)).alias("current")).where(F.col("current") > 1)


def first_seen(df: DataFrame, name: str, position: str, known: DataFrame, groups: list[str] = []) -> DataFrame:
    """SET-04: distinct known names with the position they were first seen at."""
    return df.groupBy(*groups, name).agg(F.min(position).alias("first_seen")).join(
        known.select(name).distinct(), name, "left_semi"
    )


def removed_keys(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """SET-02: keys of the earlier set that the later one has not."""
    return before.select(*columns).subtract(after.select(*columns))


def union_of_runs(sources: list[DataFrame], key: str = "runid") -> DataFrame:
    """SET-01: all run ids over all sources, once each."""
    return reduce(DataFrame.unionByName, [s.select(key) for s in sources]).distinct()


def one_row_each(reports: dict[str, DataFrame], column: str) -> DataFrame:
    """Union of one-row counts as (code, count) rows."""
    return reduce(
        DataFrame.unionByName,
        [r.select(F.lit(code).alias("code"), F.col(column).cast("long").alias("count")) for code, r in reports.items()],
    )


def count_where(df: DataFrame, condition: Column, name: str = "count") -> DataFrame:
    return df.agg(F.count_if(condition).alias(name))


def stacked(df: DataFrame, codes: dict[str, Column]) -> DataFrame:
    """One row of figures as (code, count) rows."""
    figures = df.select(*[c.cast("long").alias(f"_{i}") for i, c in enumerate(codes.values())])
    pairs = ", ".join(f"{code!r}, _{i}" for i, code in enumerate(codes))
    return figures.select(F.expr(f"stack({len(codes)}, {pairs}) AS (code, count)"))


def key_repeats(df: DataFrame, keysets: dict[str, list[str]], skip_null_first: set[str] = frozenset()) -> DataFrame:
    """AGG-11 for several keys in one scan and one shuffle: one row with <name>_groups and <name>_rows.

    The keys are grouping sets: a row is counted under each of them, combined before the shuffle. Groups of a key in
    ``skip_null_first`` whose first column is null do not count. With an empty key, ``all_count`` has all rows.
    """
    columns = list(dict.fromkeys(c for key in keysets.values() for c in key))
    sets = [[F.col(c) for c in key] for key in keysets.values()]
    counted = df.select(*columns).groupingSets(sets, *[F.col(c) for c in columns]).agg(F.count(F.lit(1)).alias("_n"), F.grouping_id().alias("_set"))
    figures = []
    if [] in keysets.values():  # the empty key counts all rows
        figures.append(F.coalesce(F.sum(F.when(F.col("_set") == 2 ** len(columns) - 1, F.col("_n"))), F.lit(0)).alias("all_count"))
    for name, key in keysets.items():
        number = int("".join("0" if c in key else "1" for c in columns), 2)
        found = (F.col("_set") == number) & (F.col("_n") > 1)
        if name in skip_null_first:
            found = found & F.col(key[0]).isNotNull()
        figures += [F.count_if(found).alias(f"{name}_groups"), F.coalesce(F.sum(F.when(found, F.col("_n"))), F.lit(0)).alias(f"{name}_rows")]
    return counted.agg(*figures)


def link_report(children: dict[str, DataFrame], foreign_key: str, parents: DataFrame, key: str, identity: str) -> DataFrame:
    """JN-09 and JN-12 for several child tables at once: per ``child`` its rows, missing identities, orphans and
    mismatches in both forms. Each child table is read once, combined per (parent, identity); parents are read once.
    """
    sides = [df.select(F.lit(name).alias("child"), F.col(foreign_key).alias(key), F.col(identity).alias("_child")) for name, df in children.items()]
    counted = reduce(DataFrame.unionByName, sides).groupBy("child", key, "_child").count()
    joined = counted.join(parents.select(key, F.col(identity).alias("_parent"), F.lit(True).alias("_found")), key, "left")
    n = lambda when: F.coalesce(F.sum(F.when(when, F.col("count"))), F.lit(0))
    mine, theirs, found = F.col("_child"), F.col("_parent"), F.col("_found").isNotNull()
    return joined.groupBy("child").agg(
        F.sum("count").alias("rows"), n(mine.isNull()).alias("missing"), n(~found).alias("orphans"),
        n(~F.coalesce(mine == theirs, F.lit(False))).alias("audit"), n(found & mine.isNotNull() & ~mine.eqNullSafe(theirs)).alias("migration"),
    )


def of_children(report: DataFrame, children: list[str], figures: list[str]) -> DataFrame:
    """``link_report`` as one row of <child>_<figure>; a child table without rows has zeros."""
    return report.agg(*[
        F.coalesce(F.max(F.when(F.col("child") == c, F.col(f))), F.lit(0)).alias(f"{c}_{f}") for c in children for f in figures
    ])


def integrity_preflight(
    watersheds: DataFrame, subcatchments: DataFrame, channels: DataFrame,
    collections: DataFrame, identities: DataFrame,
) -> DataFrame:
    """AGG-14: the nine integrity counts, one row per check. Child tables are read twice, the others once."""
    from headwater.functions.text import STABLE_KEY

    bad_key = lambda name: F.col(name).isNotNull() & ~F.col(name).rlike(STABLE_KEY)
    tables = {"subcatchment": (subcatchments, ["topazid"]), "channel": (channels, ["topazid", "weppid", "order"])}
    repeats = [
        stacked(
            key_repeats(df, {"run": ["watershed_id", *own], "logical": ["logical_id", *own]}, {"logical"}),
            {f"{name}_run_key": F.col("run_groups"), f"{name}_logical_key": F.col("logical_groups")},
        )
        for name, (df, own) in tables.items()
    ]
    links = of_children(link_report({name: df for name, (df, _) in tables.items()}, "watershed_id", watersheds, "runid", "logical_id"), list(tables), ["migration"])
    named = identities.agg(F.count_if(bad_key("watershed_key")).alias("key"), F.count_if(~F.col("status").isin("active", "retired")).alias("status"))
    return reduce(DataFrame.unionByName, [
        *repeats, stacked(links, {f"{name}_logical_mismatch": F.col(f"{name}_migration") for name in tables}),
        stacked(count_where(collections, bad_key("key")), {"collection_key_format": F.col("count")}),
        stacked(named, {"watershed_key_format": F.col("key"), "watershed_identity_status": F.col("status")}),
    ])
