"""Queries that write tables in the exchange formats and read them again."""

from __future__ import annotations

from pyspark.sql import functions as F

from headwater.catalog.registry import query
from headwater.functions import geometry as G
from headwater.operators import ingest
from headwater.operators.query import hillslope_filter, parquet_opener, run_query
from headwater.session import shared_folder
from headwater.sources import files


@query(
    """SELECT c_custkey::VARCHAR AS c_custkey, CASE WHEN c_nationkey % 5 = 0 THEN '' ELSE 'say "' || c_name || '", \\' END AS name, c_nationkey::VARCHAR AS c_nationkey,
  CASE WHEN c_nationkey % 7 = 0 THEN 'two' || chr(10) || 'lines' ELSE c_mktsegment END AS segment FROM customer"""
)
def csv_export(t):
    """Quotes, commas, backslashes, line breaks and nulls in cells, by way of CSV files."""
    root = shared_folder(t.spark)
    rows = t.customer.select(
        "c_custkey", F.when(F.col("c_nationkey") % 5 != 0, F.concat(F.lit('say "'), "c_name", F.lit('", \\'))).alias("name"), "c_nationkey",
        F.when(F.col("c_nationkey") % 7 == 0, "two\nlines").otherwise(F.col("c_mktsegment")).alias("segment"),
    )
    files.write_csv(rows, f"{root}/csv")
    read = t.spark.read.schema("c_custkey string, name string, c_nationkey string, segment string").option("header", True).option("escape", '"').option("multiLine", True)
    return read.csv(f"{root}/csv").fillna("", ["name"])


@query(
    """SELECT 's-' || (p_size % 10) AS runid, p_partkey AS topazid, floor(p_retailprice)::BIGINT AS hillslope_area, CASE WHEN p_size > 25 THEN p_retailprice / 7 END AS slope_scalar FROM part"""
)
def attribute_export(t):
    """Attributes written per run under their source names, and read as any attribute table is."""
    root = shared_folder(t.spark)
    rows = t.part.select(
        F.concat(F.lit("s-"), (F.col("p_size") % 10).cast("string")).alias("runid"), F.col("p_partkey").alias("topazid"),
        F.floor("p_retailprice").cast("bigint").alias("hillslope_area"), F.when(F.col("p_size") > 25, F.col("p_retailprice") / 7).alias("slope_scalar"),
    )
    files.write_run_attributes(rows, f"{root}/hillslopes", ingest.HILLSLOPE_FIELDS)
    found = ingest.resolve_column(t.spark.read.parquet(f"{root}/hillslopes"), ingest.KEY_SPELLINGS, "topazid")
    typed = ingest.typed_fields(found, ingest.HILLSLOPE_FIELDS, ["runid", "topazid"])
    return typed.select("runid", "topazid", "hillslope_area", "slope_scalar")


@query(
    """, y AS (SELECT topaz_id, value FROM rap WHERE year = 1997) SELECT topaz_id, count(*) AS cells, sum(value)::BIGINT AS total FROM y GROUP BY topaz_id""", "rap"
)
def year_scan(t):
    """One year of a written table, the year test in its Parquet scan."""
    root = shared_folder(t.spark)
    t.rap.write.parquet(f"{root}/rap")
    rows = files.scan(t.spark, f"{root}/rap", ["topaz_id", "value"], 1997)
    return rows.groupBy("topaz_id").agg(F.count(F.lit(1)).alias("cells"), F.sum("value").cast("bigint").alias("total"))


@query(
    """, k AS (SELECT min(topaz_id) AS k FROM rap) SELECT year, count(*) AS cells, sum(value)::BIGINT AS total FROM rap, k WHERE topaz_id = k GROUP BY year ORDER BY year""", "rap"
)
def hillslope_spec(t):
    """A query specification with the filter of one hillslope, over a written table."""
    root = shared_folder(t.spark)
    t.rap.write.parquet(f"{root}/rap.parquet")
    lowest = t.rap.agg(F.min("topaz_id")).first()[0]
    return run_query({
        "datasets": [{"path": "rap.parquet", "alias": "rap"}], "columns": ["rap.year AS year"], "group_by": ["year"], "order_by": ["year"],
        "filters": [hillslope_filter(lowest)],
        "aggregations": [{"expression": "count(*)", "alias": "cells"}, {"expression": "cast(sum(rap.value) AS bigint)", "alias": "total"}],
    }, parquet_opener(t.spark, root))


@query(
    """SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS polygons, CASE c_nationkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 9 END AS points,
  CASE c_nationkey % 4 WHEN 0 THEN 4.0 WHEN 1 THEN 4.5 END::DOUBLE AS area FROM customer"""
)
def polygon_text(t):
    """GeoJSON coordinates as text: polygons, multipolygons, other kinds and empty ones."""
    n = F.col("c_custkey").cast("string")
    square = F.concat(F.lit("[["), n, F.lit(",0],["), n, F.lit(",2],["), (F.col("c_custkey") + 2).cast("string"), F.lit(",2],["), (F.col("c_custkey") + 2).cast("string"), F.lit(",0],["), n, F.lit(",0]]"))
    corner = F.lit("[[0,0],[1,0],[0,1],[0,0]]")
    kind = F.col("c_nationkey") % 4
    coordinates = F.when(kind == 1, F.concat(F.lit("[["), square, F.lit("],["), corner, F.lit("]]"))).when(kind == 2, "[]").otherwise(F.concat(F.lit("["), square, F.lit("]")))
    name = F.when(kind == 1, "MultiPolygon").when(kind == 3, "MultiLineString").otherwise(F.lit("Polygon"))
    shape = t.customer.select("c_custkey", G.multipolygon(name, coordinates).alias("g"))
    return shape.select("c_custkey", F.size("g").alias("polygons"), F.size(G.points(F.col("g"))).alias("points"), G.area(F.col("g")).alias("area"))
