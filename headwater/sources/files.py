"""File sources and sinks: Parquet scans, GeoJSON in and out, CSV export, run catalogues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headwater.functions import geometry as G
from headwater.functions.text import normalise_runid
from headwater.operators.ingest import only_requested
from headwater.operators.keys import join_large_parents
from headwater.sources.geojson import SPLIT_BYTES, feature_texts

# File of each role below a run's folder.
ROLE_FILES = {
    "subcatchments": "dem/wbt/subcatchments.WGS.geojson",
    "channels": "dem/wbt/channels.WGS.geojson",
    "hillslopes": "watershed/hillslopes.parquet",
    "soils": "soils/soils.parquet",
    "landuse": "landuse/landuse.parquet",
}

FEATURE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("properties", T.StringType()),
    T.StructField(
        "geometry",
        T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())]),
    ),
])

def scan(spark: SparkSession, path: str, columns: list[str], year: int | None = None) -> DataFrame:
    """SRC-01: only the columns asked for, the year test pushed into the Parquet scan."""
    rows = spark.read.parquet(path)
    rows = rows if year is None else rows.where(F.col("year") == year)
    return rows.select(*columns)


def run_catalogue(runs: DataFrame, root: str, roles: dict[str, str] = ROLE_FILES) -> DataFrame:
    """SRC-04: a path for every run and role. The roles are a fixed short list, so each run
    row is expanded in place and nothing is joined."""
    listed = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(f).alias("file")) for r, f in roles.items()])
    return runs.select("runid", F.explode(listed).alias("_r")).select(
        "runid", F.col("_r.role").alias("role"),
        F.concat(F.lit(f"{root.rstrip('/')}/runs/"), normalise_runid(F.col("runid")), F.lit("/"), F.col("_r.file")).alias("path"),
    )


def discover_runs(master: DataFrame, position: str | None = None) -> DataFrame:
    """SRC-05: normalised run ids of a master table, nulls dropped, input position kept."""
    kept = [position] if position else []
    return master.where(F.col("runid").isNotNull()).select(*kept, normalise_runid(F.col("runid")).alias("runid"))


def load_sources(
    batches: dict[str, DataFrame], standalone: DataFrame | None, requested: DataFrame | None = None
) -> DataFrame:
    """SRC-06: all batches, then the standalone runs, with the source of every row.

    With an explicit list, a run id goes to the batch its middle segment names.
    """
    parts = []
    for name, rows in batches.items():
        if requested is not None:
            segments = F.split(F.col("runid"), ";;")
            rows = only_requested(rows, requested.where((F.size(segments) >= 3) & (F.get(segments, 1) == name)))
        parts.append(rows.withColumn("source", F.lit(name)))
    if standalone is not None:
        rows = standalone if requested is None else only_requested(standalone, requested)
        parts.append(rows.withColumn("source", F.lit("standalone")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_features(spark: SparkSession, path: str, properties: T.StructType, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """SRC-03: one row per feature: properties, geometry kind and coordinates, file, position.

    Files are read in splits (``sources/geojson.py``). Coordinates stay text here, because their depth depends on
    the kind. An element that is no object is a row of nulls.
    """
    texts, _ = feature_texts(spark, path, split_bytes)
    features = texts.select("file", "position", F.from_json("text", FEATURE).alias("_f"))
    return features.select(
        "file", "position", F.from_json("_f.properties", properties).alias("properties"),
        F.col("_f.geometry.type").alias("kind"), F.col("_f.geometry.coordinates").alias("coordinates"),
    )


def collection_faults(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """SRC-03 guards: per file the first rule its collection breaks, or null."""
    texts, types = feature_texts(spark, path, split_bytes)
    parsed = texts.select("file", F.from_json("text", FEATURE).alias("_f"))
    found = parsed.groupBy("file").agg(
        F.bool_and(F.coalesce(F.col("_f.type") == "Feature", F.lit(False))).alias("_features"),
        F.bool_and(F.coalesce(F.ltrim("_f.properties").startswith("{"), F.lit(False))).alias("_properties"),
    )
    named = spark.createDataFrame(types, "file string, _type boolean")
    fault = (
        F.when(~F.col("_type"), "type").when(F.col("_features").isNull(), "no-features")
        .when(~F.col("_features"), "feature").when(~F.col("_properties"), "properties")
    )
    return named.join(found, "file", "left").select("file", fault.alias("fault"))


def feature_text(identifier: Column, properties: list[str], geometry: Column) -> Column:
    """SNK-01: one GeoJSON feature: id, chosen properties with nulls, rounded geometry or null."""
    keep_nulls = {"ignoreNullFields": "false"}
    return F.concat(
        F.lit('{"id":'), F.regexp_extract(F.to_json(F.struct(identifier.alias("v"))), r'^\{"v":(.*)\}$', 1),
        F.lit(',"type":"Feature","properties":'), F.to_json(F.struct(*properties), keep_nulls),
        F.lit(',"geometry":'), F.coalesce(G.geojson(geometry), F.lit("null")), F.lit("}"),
    )


def write_feature_lines(df: DataFrame, path: str, identifier: str, properties: list[str], geometry: str) -> None:
    """SNK-01: a text file set with one feature per line, written in parallel."""
    df.select(feature_text(F.col(identifier), properties, F.col(geometry)).alias("value")).write.text(path)


def write_run_collections(
    df: DataFrame, path: str, run: str, order: list[str], identifier: str, properties: list[str], geometry: str
) -> None:
    """SNK-04: per run a folder whose part files, read in name order, are one FeatureCollection
    sorted by key.

    Rows are range-partitioned by run and key, so a large run becomes several part files and
    no task holds a whole run, neither where rows learn which key comes first nor where they are written.
    Opening and closing lines are rows of their own.
    """
    first = df.groupBy(run).agg(F.min(F.struct(*order)).alias("_first"))
    body = join_large_parents(df, first, [run], order, "inner").select(
        run, F.lit(1).alias("_place"), *order,
        F.concat(
            F.when(F.struct(*order) == F.col("_first"), F.lit("")).otherwise(F.lit(",")),
            feature_text(F.col(identifier), properties, F.col(geometry)),
        ).alias("value"),
    )
    blank = [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in order]
    edges = first.select(run, F.explode(F.array(
        F.struct(F.lit(0).alias("_place"), F.lit('{"type":"FeatureCollection","features":[').alias("value")),
        F.struct(F.lit(2).alias("_place"), F.lit("]}").alias("value")),
    )).alias("_e")).select(run, "_e._place", *blank, "_e.value")
    placed = body.unionByName(edges)
    (
        placed.repartitionByRange(run, "_place", *order).sortWithinPartitions(run, "_place", *order)
        .select(run, "value").write.partitionBy(run).text(path)
    )


def write_csv(df: DataFrame, path: str) -> None:
    """SNK-02: header, every cell quoted, quotes doubled, null as an empty cell."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns]
    df.select(*cells).write.option("header", True).option("quoteAll", True).option("escape", '"').option(
        "emptyValue", ""
    ).csv(path)


def write_run_attributes(df: DataFrame, path: str, fields: list[tuple[str, str, str]], key: str = "topazid") -> None:
    """SNK-03: attributes under their source names and a ``TopazID`` key, one folder per run."""
    renamed = [F.col(target).alias(source) for target, source, _ in fields if target in df.columns]
    df.select("runid", F.col(key).alias("TopazID"), *renamed).sortWithinPartitions("runid", "TopazID").write.partitionBy(
        "runid"
    ).parquet(path)
