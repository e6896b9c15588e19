"""Domain views over the driver's Parquet tables.

Each view is given twice: as a DataFrame, and as the SQL the checks run on the same files.
They only rename, cast and derive columns row by row (identity and release views group once).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "batch;;nasa-roses-2026-sbs;;"


# Given in full, so that opening a table starts no job to read a file footer.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def rap(spark, folder):
    return table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("topaz_id"), F.year("l_shipdate").alias("year"),
        F.when(F.col("l_returnflag") == "A", 5).when(F.col("l_returnflag") == "R", 6).otherwise(1).alias("band"),
        F.col("l_quantity").alias("value"),
    )


def hillslopes(spark, folder):
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("topaz_id"), F.col("p_size").alias("wepp_id"), F.col("p_retailprice").alias("area")
    )


def rhessys(spark, folder):
    return table(spark, folder, "events").select(
        F.col("event_type").alias("scenario"), F.col("user_id").alias("hill_id"), F.year("ts").alias("year"),
        F.month("ts").alias("month"), F.col("value"),
    )


def watersheds(spark, folder):
    key = F.col("c_custkey").cast("string")
    return table(spark, folder, "customer").select(
        F.concat(F.lit(BATCH), key).alias("runid"),
        F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("w-"), key)).alias("logical_id"),
        F.concat(F.lit("c-"), F.col("c_nationkey").cast("string")).alias("collection"),
        F.col("c_name").alias("srcname"), F.lower("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"),
    )


def subcatchments(spark, folder):
    parent = F.col("o_custkey").cast("string")
    neighbour = (F.col("o_custkey") + 1).cast("string")
    return table(spark, folder, "orders").select(
        F.concat(F.lit(BATCH), parent).alias("watershed_id"),
        F.when(F.col("o_orderstatus") == "P", F.lit(None))
        .when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("w-"), neighbour))
        .otherwise(F.concat(F.lit("w-"), parent)).alias("logical_id"),
        F.month("o_orderdate").alias("topazid"), F.col("o_orderkey").alias("weppid"),
        F.col("o_totalprice").alias("area"), F.col("o_orderpriority").alias("texture"),
    )


def channels(spark, folder):
    parent = F.col("l_suppkey").cast("string")
    return table(spark, folder, "lineitem").select(
        F.concat(F.lit(BATCH), parent).alias("watershed_id"),
        F.when(F.col("l_returnflag") != "N", F.concat(F.lit("w-"), parent)).alias("logical_id"),
        F.col("l_orderkey").alias("topazid"), F.col("l_partkey").alias("weppid"), F.col("l_linenumber").alias("order"),
    )


def identities(spark, folder):
    """One identity per watershed; low balances are retired, some keys are badly formed."""
    key = F.col("c_custkey").cast("string")
    return table(spark, folder, "customer").select(
        F.concat(F.lit("w-"), key).alias("identity_id"),
        F.when(F.col("c_acctbal") < 500, F.concat(F.lit("W_"), key)).otherwise(F.concat(F.lit("ws-"), key)).alias("watershed_key"),
        F.concat(F.lit("c-"), F.col("c_nationkey").cast("string")).alias("collection"),
        F.when(F.col("c_acctbal") < -500, "retired").when(F.col("c_acctbal") > 9900, "unknown")
        .otherwise(F.lit("active")).alias("status"),
    )


def aliases(spark, folder):
    """Every order is an alias of its customer; an open order is a current one."""
    parent = F.col("o_custkey").cast("string")
    return table(spark, folder, "orders").select(
        F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("runid"),
        F.concat(F.lit("w-"), parent).alias("identity_id"),
        (F.col("o_orderstatus") == "O").alias("is_current"),
    )


def collections(spark, folder):
    return table(spark, folder, "nation").select(
        F.when(F.col("n_regionkey") == 0, F.col("n_name"))
        .otherwise(F.lower(F.replace("n_name", F.lit("_"), F.lit("-")))).alias("key"),
        F.concat(F.lit("c-"), F.col("n_nationkey").cast("string")).alias("collection"),
    )


def summary_pairs(spark, folder):
    """Key/value rows per scenario: orders summed by priority (scenario) and status (key)."""
    key = (
        F.when(F.col("o_orderstatus") == "F", "Total contributing area to outlet")
        .when(F.col("o_orderstatus") == "O", "Avg. Ann. water discharge from outlet")
        .otherwise(F.lit("Avg. Ann. sediment discharge from outlet"))
    )
    return table(spark, folder, "orders").select(
        F.lower(F.replace("o_orderpriority", F.lit("-"), F.lit("_"))).alias("scenario"), key.alias("key"),
        F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("position"),
    )


def pixels(spark, folder):
    """Embeddings as rasters: label = raster, vector = row, component = column."""
    return table(spark, folder, "embeddings").select(
        F.concat(F.lit("r-"), F.col("label").cast("string")).alias("raster_id"), F.col("vec_id").alias("row"),
        F.posexplode("embedding").alias("col", "_v"),
    ).select(
        "raster_id", "row", "col",
        (F.col("col") * 5.0 - 160.0 + F.pmod("row", F.lit(50)) / 100.0).alias("x"),
        (F.pmod("row", F.lit(140)) * 1.0 - 70.0 + F.col("col") / 100.0).alias("y"),
        F.col("_v").cast("double").alias("value"),
    )


def _run_states(spark, folder, first: int, last: int):
    """Run states of a release: customers with orders in a span of years, parts from sums."""
    orders = table(spark, folder, "orders").where(F.year("o_orderdate").between(first, last))
    built = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("_n"), F.max("o_orderkey").alias("_last"), F.min("o_orderkey").alias("_first"),
        F.max("o_orderstatus").alias("_status"), F.min("o_orderpriority").alias("_priority"),
        F.count_if(F.col("o_orderstatus") == "P").alias("_pending"),
    )
    text = lambda *cols: F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in cols]))
    key = F.col("o_custkey").cast("string")
    return built.select(
        F.concat(F.lit("w-"), key).alias("watershed_key"), F.lit("c").alias("collection"),
        F.concat(F.lit("run-"), key, F.lit("-"), F.col("_status")).alias("runid"),
        text("_n", "_last", "_first", "_status", "_priority", "_pending").alias("run_fingerprint"),
        text("_priority").alias("metadata_fingerprint"), text("_first").alias("geometry_fingerprint"),
        text("_last").alias("subcatchment_fingerprint"), text("_n").alias("channel_fingerprint"),
        F.lit("h").alias("hillslope_fingerprint"), F.lit("s").alias("soil_fingerprint"),
        F.lit("l").alias("landuse_fingerprint"),
        F.when(F.col("_pending") > 0, text("_pending")).alias("capability_fingerprint"),
        F.lit(1).alias("actual_watersheds"), F.col("_n").cast("int").alias("actual_subcatchments"),
        F.col("_pending").cast("int").alias("actual_channels"),
    )


def base_states(spark, folder):
    return _run_states(spark, folder, 1995, 1999)


def target_states(spark, folder):
    return _run_states(spark, folder, 1997, 2001)


def _states_sql(first: int, last: int) -> str:
    return f"""
SELECT 'w-' || o_custkey AS watershed_key, 'c' AS collection, 'run-' || o_custkey || '-' || st AS runid,
  md5(n || ':' || hi || ':' || lo || ':' || st || ':' || pr || ':' || pe) AS run_fingerprint,
  md5(pr) AS metadata_fingerprint, md5(lo::VARCHAR) AS geometry_fingerprint,
  md5(hi::VARCHAR) AS subcatchment_fingerprint, md5(n::VARCHAR) AS channel_fingerprint,
  CASE WHEN pe > 0 THEN md5(pe::VARCHAR) END AS capability_fingerprint,
  1 AS actual_watersheds, n AS actual_subcatchments, pe AS actual_channels
FROM (SELECT o_custkey, count(*) AS n, max(o_orderkey) AS hi, min(o_orderkey) AS lo, max(o_orderstatus) AS st,
        min(o_orderpriority) AS pr, count(*) FILTER (WHERE o_orderstatus = 'P') AS pe
      FROM orders WHERE year(o_orderdate) BETWEEN {first} AND {last} GROUP BY o_custkey)"""


VIEWS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        rap, hillslopes, rhessys, watersheds, subcatchments, channels, identities, aliases, collections,
        summary_pairs, pixels, base_states, target_states,
    )
}

SQL_VIEWS: dict[str, str] = {
    "rap": """
SELECT l_partkey AS topaz_id, year(l_shipdate) AS year,
  CASE l_returnflag WHEN 'A' THEN 5 WHEN 'R' THEN 6 ELSE 1 END AS band, l_quantity AS value FROM lineitem""",
    "hillslopes": "SELECT p_partkey AS topaz_id, p_size AS wepp_id, p_retailprice AS area FROM part",
    "rhessys": """
SELECT event_type AS scenario, user_id AS hill_id, year(ts) AS year, month(ts) AS month, value FROM events""",
    "watersheds": f"""
SELECT '{BATCH}' || c_custkey AS runid, CASE WHEN c_acctbal >= 0 THEN 'w-' || c_custkey END AS logical_id,
  'c-' || c_nationkey AS collection, c_name AS srcname, lower(c_mktsegment) AS segment, c_acctbal AS balance
FROM customer""",
    "subcatchments": f"""
SELECT '{BATCH}' || o_custkey AS watershed_id,
  CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderpriority = '1-URGENT' THEN 'w-' || (o_custkey + 1)
    ELSE 'w-' || o_custkey END AS logical_id,
  month(o_orderdate) AS topazid, o_orderkey AS weppid, o_totalprice AS area, o_orderpriority AS texture FROM orders""",
    "channels": f"""
SELECT '{BATCH}' || l_suppkey AS watershed_id, CASE WHEN l_returnflag <> 'N' THEN 'w-' || l_suppkey END AS logical_id,
  l_orderkey AS topazid, l_partkey AS weppid, l_linenumber AS "order" FROM lineitem""",
    "identities": """
SELECT 'w-' || c_custkey AS identity_id,
  CASE WHEN c_acctbal < 500 THEN 'W_' || c_custkey ELSE 'ws-' || c_custkey END AS watershed_key,
  'c-' || c_nationkey AS collection,
  CASE WHEN c_acctbal < -500 THEN 'retired' WHEN c_acctbal > 9900 THEN 'unknown' ELSE 'active' END AS status
FROM customer""",
    "aliases": """
SELECT 'run-' || o_orderkey AS runid, 'w-' || o_custkey AS identity_id, o_orderstatus = 'O' AS is_current FROM orders""",
    "collections": """
SELECT CASE WHEN n_regionkey = 0 THEN n_name ELSE lower(replace(n_name, '_', '-')) END AS key,
  'c-' || n_nationkey AS collection FROM nation""",
    "summary_pairs": """
SELECT lower(replace(o_orderpriority, '-', '_')) AS scenario,
  CASE o_orderstatus WHEN 'F' THEN 'Total contributing area to outlet'
    WHEN 'O' THEN 'Avg. Ann. water discharge from outlet'
    ELSE 'Avg. Ann. sediment discharge from outlet' END AS key, o_totalprice AS value, o_orderkey AS position
FROM orders""",
    "pixels": """
SELECT raster_id, "row", col, col * 5.0::DOUBLE - 160.0::DOUBLE + ("row" % 50) / 100.0::DOUBLE AS x,
  ("row" % 140) * 1.0::DOUBLE - 70.0::DOUBLE + col / 100.0::DOUBLE AS y, value
FROM (SELECT 'r-' || label AS raster_id, vec_id AS "row", unnest(range(len(embedding)))::INTEGER AS col,
        unnest(embedding)::DOUBLE AS value FROM embeddings)""",
    "base_states": _states_sql(1995, 1999),
    "target_states": _states_sql(1997, 2001),
}


def with_views(names: str, body: str) -> str:
    """SQL with the named views in front."""
    parts = [f"{name} AS ({SQL_VIEWS[name]})" for name in names.split()]
    return f"WITH {', '.join(parts)} {body}"
