"""Ingest transforms: tolerant column names, typed fields, attribute joins, polygon merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.functions.numbers import is_finite

# Source names of each watershed field, in order of preference.
WATERSHED_SOURCES = {
    "pws_id": ["PWS_ID"], "srcname": ["SrcName", "name"], "pws_name": ["PWS_Name_2", "PWS_Name"],
    "county_nam": ["County_Nam"], "state": ["State"], "huc10_id": ["HUC10_ID"],
    "huc10_name": ["HUC10_Name"], "wws_code": ["WWS_Code"], "srctype": ["SrcType"],
    "shape_leng": ["Shape_Leng"], "shape_area": ["Shape_Area"], "area_km2": ["area_km2"],
    "owner_type": ["OwnerType"], "pop_group": ["PopGroup"], "treat_type": ["TreatType"],
    "conn_group": ["ConnGroup"], "huc10_pws_names": ["HUC10_PWS_Names"],
    "huc10_owner_types": ["HUC10_OwnerTypes"], "huc10_pop_groups": ["HUC10_PopGroups"],
    "huc10_treat_types": ["HUC10_TreatTypes"], "huc10_utility_count": ["HUC10_UtilityCount"],
    "runid": ["runid"],
}
# Fixed values: (target, source, type) of the attribute tables.
HILLSLOPE_FIELDS = [
    ("slope_scalar", "slope_scalar", "double"), ("length", "length", "double"), ("width", "width", "double"),
    ("direction", "direction", "double"), ("aspect", "aspect", "double"), ("hillslope_area", "area", "bigint"),
    ("elevation", "elevation", "double"), ("centroid_px", "centroid_px", "bigint"),
    ("centroid_py", "centroid_py", "bigint"), ("centroid_lon", "centroid_lon", "double"),
    ("centroid_lat", "centroid_lat", "double"),
]
SOIL_FIELDS = [
    ("mukey", "mukey", "string"), ("soil_fname", "fname", "string"), ("soils_dir", "soils_dir", "string"),
    ("soil_build_date", "build_date", "string"), ("soil_desc", "desc", "string"),
    ("soil_color", "color", "string"), ("soil_area", "area", "double"),
    ("soil_pct_coverage", "pct_coverage", "double"), ("clay", "clay", "double"), ("sand", "sand", "double"),
    ("avke", "avke", "double"), ("bd", "bd", "double"), ("simple_texture", "simple_texture", "string"),
    ("soil_depth", "soil_depth", "double"), ("rock", "rock", "double"),
]
LANDUSE_FIELDS = [
    ("landuse_key", "key", "bigint"), ("landuse_map", "_map", "string"), ("man_fn", "man_fn", "string"),
    ("man_dir", "man_dir", "string"), ("landuse_desc", "desc", "string"), ("landuse_color", "color", "string"),
    ("landuse_area", "area", "double"), ("landuse_pct_coverage", "pct_coverage", "double"),
    ("cancov", "cancov", "double"), ("inrcov", "inrcov", "double"), ("rilcov", "rilcov", "double"),
    ("cancov_override", "cancov_override", "double"), ("inrcov_override", "inrcov_override", "double"),
    ("rilcov_override", "rilcov_override", "double"), ("disturbed_class", "disturbed_class", "string"),
]
# Spellings of the key and result columns, in order of preference.
KEY_SPELLINGS = ["TopazID", "topaz_id", "topazid", "TOPAZID", "Topaz_ID", "topaz_ID"]
RESULT_SPELLINGS = {
    "topaz_id": ["topaz_id", "topazid", "TopazID", "TopazId"],
    "desc": ["desc", "landuse_desc"],
    "color": ["color", "landuse_color"],
    "spatial_id": ["spatialId", "spatialid"],
}


def first_present(df: DataFrame, names: Sequence[str], kind: str = "string") -> Column:
    """First non-null value among the named columns that exist; null if none does."""
    present = [F.col(f"`{name}`") for name in names if name in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast(kind)


def harmonise(
    df: DataFrame, sources: dict[str, list[str]] = WATERSHED_SOURCES, keep: Sequence[str] = (),
    default_name: Column | None = None,
) -> DataFrame:
    """PRJ-01: target fields from their ordered source names; the strict path gives ``srcname``
    the display name where the source has none."""
    fields = {target: first_present(df, names) for target, names in sources.items()}
    if default_name is not None:
        fields["srcname"] = F.coalesce(fields["srcname"], default_name)
    return df.select(*[column.alias(target) for target, column in fields.items()], *keep)


def resolve_column(df: DataFrame, spellings: Sequence[str], name: str) -> DataFrame:
    """PRJ-03: the first spelling present, renamed; missing altogether is an error."""
    # Compared exactly: the spellings differ in case, which column lookup ignores.
    found = next((s for s in spellings if s in df.columns), None)
    if found is None:
        raise ValueError(f"none of the columns {list(spellings)} is present")
    return df.withColumnRenamed(found, name)


def _typed(source: Column, kind: str, strict: bool) -> Column:
    if kind == "string":
        return source.cast("string")
    number = source.try_cast("double")
    finite = F.when(is_finite(number), number)
    if kind == "bigint":
        # Whole numbers given as text keep all their digits; fractions are cut towards zero.
        return F.coalesce(source.cast("string").try_cast("bigint"), finite.try_cast("bigint"))
    return finite if strict else F.when(~F.isnan(number), number)


def typed_fields(
    df: DataFrame, fields: list[tuple[str, str, str]], keys: Sequence[str], strict: bool = False
) -> DataFrame:
    """PRJ-02: typed target columns; null stays null and overwrites.

    The strict form adds ``rejected``: the targets whose source value was given but is not a
    finite value of the type. The tolerant form turns those into null.
    """
    present = [(t, s, k) for t, s, k in fields if s in df.columns]
    columns = [_typed(F.col(f"`{s}`"), k, strict).alias(t) for t, s, k in present]
    missing = [F.lit(None).cast(k).alias(t) for t, s, k in fields if s not in df.columns]
    if strict:
        bad = [
            F.when(F.col(f"`{s}`").isNotNull() & _typed(F.col(f"`{s}`"), k, True).isNull(), F.lit(t))
            for t, s, k in present
        ]
        columns.append(F.array_compact(F.array(*bad)).alias("rejected"))
    return df.select(*keys, *columns, *missing)


def only_requested(df: DataFrame, requested: DataFrame, key: str = "runid") -> DataFrame:
    """FLT-04: rows of the requested runs."""
    return df.join(requested.select(key).distinct(), key, "left_semi")


def boundary_rows(df: DataFrame, flag: str = "Watershed") -> DataFrame:
    """FLT-05: boundary features only: flag 1, null, or no flag column."""
    if flag not in df.columns:
        return df
    return df.where(F.col(flag).isNull() | (F.col(flag).cast("int") == 1))


def attach_attributes(
    subcatchments: DataFrame, tables: dict[str, tuple[DataFrame, list[tuple[str, str, str]]]],
    keys: Sequence[str] = ("runid", "topazid"),
) -> DataFrame:
    """JN-02: left joins of the attribute tables given; ``updated`` marks rows that got a value.

    The tables share one key, so one partitioning serves all joins. Pass narrow
    subcatchments: geometry is better joined back afterwards.
    """
    rows, mapped = subcatchments, []
    for table, fields in tables.values():
        typed = typed_fields(table, fields, keys)
        rows = rows.join(typed, list(keys), "left")
        mapped += [target for target, _, _ in fields]
    updated = F.lit(False)
    for name in mapped:
        updated = updated | F.col(name).isNotNull()
    return rows.withColumn("updated", updated)


def attribute_coverage(staged: DataFrame, attributes: DataFrame, run: str = "runid", key: str = "topazid") -> DataFrame:
    """JN-03: per run how exactly an attribute table covers the staged hillslopes.

    Both sides are tagged and grouped on (run, key): one shuffle, spread over all keys even
    if one run holds a third of them.
    """
    tagged = staged.select(run, key, F.lit(1).alias("_staged"), F.lit(0).alias("_given")).unionByName(
        attributes.select(run, key, F.lit(0).alias("_staged"), F.lit(1).alias("_given"))
    )
    pairs = tagged.groupBy(run, key).agg(F.sum("_staged").alias("_staged"), F.sum("_given").alias("_given"))
    return pairs.groupBy(run).agg(
        F.sum("_staged").alias("staged_rows"), F.sum("_given").alias("attribute_rows"),
        F.count_if((F.col("_staged") > 0) & (F.col("_given") == 0)).alias("staged_only"),
        F.count_if((F.col("_staged") == 0) & (F.col("_given") > 0)).alias("attribute_only"),
        F.count_if(F.col(key).isNull()).alias("null_keys"),
        F.count_if((F.col("_given") > 1)).alias("repeated_keys"),
    ).withColumn(
        "exact",
        (F.col("staged_only") == 0) & (F.col("attribute_only") == 0) & (F.col("null_keys") == 0)
        & (F.col("repeated_keys") == 0) & (F.col("staged_rows") == F.col("attribute_rows")),
    )


def merge_polygons(
    features: DataFrame, keys: Sequence[str], position: str, geometry: str = "geometry", strict: bool = False
) -> DataFrame:
    """AGG-09: features of one key become one multipolygon in input order; attributes come
    from the first. The strict mode keeps one row per feature instead and marks repeats.

    A merged row holds all polygons of its key, as the result demands; the key includes the
    hillslope or channel id, so it is one entity and not a whole run.
    """
    if strict:
        counts = features.groupBy(*keys).agg((F.count(F.lit(1)) > 1).alias("repeated_key"))
        return features.join(counts, list(keys))
    others = [c for c in features.columns if c not in (*keys, geometry, position)]
    placed = F.array_sort(F.collect_list(F.struct(position, geometry)))
    return features.groupBy(*keys).agg(
        F.flatten(F.transform(placed, lambda f: f[geometry])).alias(geometry),
        *[F.min_by(c, position).alias(c) for c in others],
        F.count(F.lit(1)).alias("merged_features"),
    )


def merge_boundary(features: DataFrame, run: str, position: str, geometry: str = "geometry") -> DataFrame:
    """AGG-10: the kept boundary features of each run as one multipolygon row; none gives no row."""
    kept = boundary_rows(features)
    return merge_polygons(kept.select(run, position, geometry), [run], position, geometry)


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``changes`` replace those of ``base`` with the same key; the rest stays."""
    kept = base.join(changes.select(*keys), list(keys), "left_anti")
    return kept.unionByName(changes, allowMissingColumns=True)


def load_statistics(events: DataFrame) -> DataFrame:
    """AGG-29: saved, updated and skipped records per phase and run."""
    amount = lambda outcome: F.coalesce(
        F.sum(F.when(F.col("outcome") == outcome, F.col("records"))), F.lit(0)
    ).alias(outcome)
    return events.groupBy("phase", "runid").agg(amount("saved"), amount("updated"), amount("skipped"))


def load_summary(log: DataFrame) -> DataFrame:
    """AGG-31: items, records, errors and warnings per phase, and the first five error texts.

    ``log``: phase, position, level (item, error, warning), records, message. The five come
    from a bounded rank, not from a list of all errors.
    """
    from headwater.operators.ranking import bounded_first

    totals = log.groupBy("phase").agg(
        F.count_if(F.col("level") == "item").alias("items"),
        F.coalesce(F.sum("records"), F.lit(0)).alias("records"),
        F.count_if(F.col("level") == "error").alias("errors"),
        F.count_if(F.col("level") == "warning").alias("warnings"),
    )
    first = bounded_first(log.where(F.col("level") == "error"), ["phase"], [F.col("position")], 5)
    texts = first.groupBy("phase").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("place", "message"))), lambda m: m["message"]), " | "
        ).alias("first_errors")
    )
    return totals.join(texts, "phase", "left").withColumn("first_errors", F.coalesce("first_errors", F.lit("")))


def member_index(
    runs: DataFrame, features: DataFrame, aliases: DataFrame, artifacts: DataFrame, bounds: DataFrame
) -> DataFrame:
    """AGG-30: one row per run with counts of raw features, bounds, and sizes of its lists.

    ``features``: runid, role. ``artifacts``: runid, role, sha256, one row per role.
    ``bounds``: runid, minx, miny, maxx, maxy, boundary_features. The alias and artifact lists
    are bounded by the aliases of one identity and by the fixed set of roles.
    """
    counts = features.groupBy("runid").agg(
        F.count_if(F.col("role") == "subcatchments").alias("subcatchments"),
        F.count_if(F.col("role") == "channels").alias("channels"),
    )
    named = aliases.groupBy("runid").agg(F.array_join(F.array_sort(F.collect_set("alias")), ",").alias("aliases"))
    listed = artifacts.groupBy("runid").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_set(F.struct("role", "sha256"))), lambda a: F.concat_ws("=", a["role"], a["sha256"])), ","
        ).alias("artifacts")
    )
    rows = runs.join(counts, "runid", "left").join(named, "runid", "left").join(listed, "runid", "left").join(
        bounds, "runid", "left"
    )
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return rows.select(
        "collection", "runid", "display_name", F.coalesce("aliases", F.lit("")).alias("aliases"),
        F.coalesce("artifacts", F.lit("")).alias("artifacts"), zero("subcatchments"), zero("channels"),
        "minx", "miny", "maxx", "maxy",
        (~F.col("standalone") | (F.coalesce("boundary_features", F.lit(0)) == 1)).alias("boundary_ok"),
    )
