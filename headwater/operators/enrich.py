"""Enrichment of target watersheds from a second source by utility code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The join key and the fields the source has authority over.
JOIN_KEY = "WWS_Code"
COPY_FIELDS = [
    "PWS_ID", "SrcName", "PWS_Name", "County_Nam", "State", "HUC10_ID", "HUC10_Name", "WWS_Code",
    "SrcType", "Shape_Leng", "Shape_Area", "outlet_lon_lat",
]


def enrich(target: DataFrame, source: DataFrame, fields: list[str], key: str = JOIN_KEY) -> DataFrame:
    """JN-04: target rows with the source's fields; unmatched rows get explicit nulls.

    Everything else of the target, its position column included, is kept. ``conflicts`` lists
    the fields where the target held a value that differs from the incoming one; an incoming
    null conflicts as well.
    """
    incoming = source.select(key, F.lit(True).alias("_hit"), *[F.col(f).alias(f"_{f}") for f in fields])
    joined = target.join(incoming, key, "left")
    matched = F.col("_hit").isNotNull()
    held = lambda f: F.col(f) if f in target.columns else F.lit(None).cast("string")
    conflict = [
        F.when(matched & held(f).isNotNull() & ~held(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fields
    ]
    kept = [c for c in target.columns if c not in fields]
    return joined.select(
        *kept, *[F.when(matched, F.col(f"_{f}")).alias(f) for f in fields],
        matched.alias("matched"), F.array_compact(F.array(*conflict)).alias("conflicts"),
    )


def preserved(target: DataFrame, output: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """JN-05: per column that must not change, the rows where it did; missing and added rows too."""
    left = target.select(F.col(key).alias("_key"), F.lit(1).alias("_before"), *[F.col(f).alias(f"_b_{f}") for f in fields])
    right = output.select(F.col(key).alias("_key"), F.lit(1).alias("_after"), *[F.col(f).alias(f"_a_{f}") for f in fields])
    both = left.join(right, "_key", "full_outer")
    paired = F.col("_before").isNotNull() & F.col("_after").isNotNull()
    changed = {f: F.count_if(paired & ~F.col(f"_b_{f}").eqNullSafe(F.col(f"_a_{f}"))) for f in fields}
    counts = {"missing": F.count_if(F.col("_after").isNull()), "added": F.count_if(F.col("_before").isNull()), **changed}
    summary = both.agg(*[c.alias(name) for name, c in counts.items()])
    pairs = ", ".join(f"'{name}', `{name}`" for name in counts)
    return summary.select(F.expr(f"stack({len(counts)}, {pairs}) AS (check, rows)"))


def _pairs(target: DataFrame, source: DataFrame, key: str, compare: list[str]) -> DataFrame:
    right = source.select(F.col(key), F.lit(1).alias("_source"), *[F.col(c).alias(f"_s_{c}") for c in compare])
    left = target.select(F.col(key), F.lit(1).alias("_target"), *[F.col(c).alias(f"_t_{c}") for c in compare])
    return left.join(right, key, "full_outer")


def enrichment_report(target: DataFrame, source: DataFrame, key: str, runid: str, geometry: str) -> DataFrame:
    """JN-06, JN-07, SET-03 and ENR-01: the eleven named counts of an enrichment.

    Keys are unique on both sides, so the full outer join is one-to-one. A source run id
    that is absent (null) is not counted as a difference.
    """
    joined = _pairs(target, source, key, [runid, geometry])
    both = F.col("_target").isNotNull() & F.col("_source").isNotNull()
    on_target = F.count("_target")
    named: dict[str, Column] = {
        "matched": F.count_if(both),
        "target-unmatched": F.count_if(F.col("_source").isNull()),
        "source-unmatched": F.count_if(F.col("_target").isNull()),
        "duplicate-join-key": on_target - F.count_distinct(F.when(F.col("_target").isNotNull(), F.col(key))),
        "preserved-membership": on_target,
        "preserved-runids": on_target,
        "preserved-geometry": on_target,
        "source-runids-ignored": F.count(f"_s_{runid}"),
        "source-geometry-ignored": F.count("_source"),
        "source-runid-differences": F.count_if(
            both & F.col(f"_s_{runid}").isNotNull() & ~F.col(f"_s_{runid}").eqNullSafe(F.col(f"_t_{runid}"))
        ),
        "source-geometry-differences": F.count_if(
            both & ~F.col(f"_s_{geometry}").eqNullSafe(F.col(f"_t_{geometry}"))
        ),
    }
    summary = joined.agg(*[c.alias(name) for name, c in named.items()])
    pairs = ", ".join(f"'{name}', `{name}`" for name in named)
    return summary.select(F.expr(f"stack({len(named)}, {pairs}) AS (code, count)"))


def field_authorities(target_sha256: str, source_sha256: str, fields: list[str] = COPY_FIELDS) -> list[tuple[str, str, str]]:
    """ENR-01: which side decides each field: run id, geometry and code stay with the target."""
    kept = [(name, "target", target_sha256) for name in ("runid", "geometry", "wws_code")]
    return kept + [(name, "source", source_sha256) for name in fields if name != JOIN_KEY]


def unmatched(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """JN-06: keys only one side has."""
    one = target.select(key).join(source.select(key), key, "left_anti").withColumn("side", F.lit("target"))
    two = source.select(key).join(target.select(key), key, "left_anti").withColumn("side", F.lit("source"))
    return reduce(DataFrame.unionByName, [one, two])
