"""The declarative query surface: query specifications, request checks, dataset resolution."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BAND_LIMITS = (1, 6)
FILTER_YEARS = (1900, 2100)
REQUEST_YEARS = (1800, 3000)
REQUEST_FIELDS = {"kind", "scenario", "variable", "spatial_scale", "year"}


def hillslope_filter(topaz_id: int, column: str = "rap.topaz_id") -> dict:
    """FLT-01: equality on one hillslope, a non-negative integer."""
    if isinstance(topaz_id, bool) or int(topaz_id) != topaz_id or topaz_id < 0:
        raise ValueError("a hillslope id is a non-negative integer")
    return {"column": column, "operator": "=", "value": int(topaz_id)}


def band_filter(bands: int | list[int], column: str = "rap.band") -> dict:
    """FLT-02: whole bands 1..6; ``=`` for one, ``IN`` for several, an error for none."""
    given = bands if isinstance(bands, (list, tuple)) else [bands]
    valid = [int(b) for b in given if float(b).is_integer() and BAND_LIMITS[0] <= b <= BAND_LIMITS[1]]
    if not valid:
        raise ValueError("no valid band among those given")
    if len(valid) == 1:
        return {"column": column, "operator": "=", "value": valid[0]}
    return {"column": column, "operator": "IN", "value": valid}


def year_filter(year, column: str = "rap.year") -> list[dict]:
    """FLT-03: a filter for a whole year in 1900..2100, otherwise none at all."""
    whole = isinstance(year, (int, float)) and not isinstance(year, bool) and float(year).is_integer()
    if not whole or not FILTER_YEARS[0] <= year <= FILTER_YEARS[1]:
        return []
    return [{"column": column, "operator": "=", "value": int(year)}]


def run_query(
    spec: dict, open_dataset: Callable[[str, str | None], DataFrame], limit: int | None = None
) -> DataFrame:
    """QRY-01: build the DataFrame a query specification describes.

    ``open_dataset(path, scenario)`` opens a table. Column texts and aggregate expressions
    are Spark SQL expressions over the dataset aliases; nothing is parsed here.
    """
    scenario = spec.get("scenario")
    tables = {
        d["alias"]: open_dataset(d["path"], scenario).alias(d["alias"]) for d in spec["datasets"]
    }
    joins = spec.get("joins", [])
    first = joins[0]["left"] if joins else spec["datasets"][0]["alias"]
    rows = tables[first]
    for join in joins:
        on = reduce(
            lambda a, b: a & b,
            [F.col(f"{join['left']}.{c}") == F.col(f"{join['right']}.{c}") for c in join["on"]],
        )
        rows = rows.join(tables[join["right"]], on, "inner")
    for item in spec.get("filters", []):
        column = F.col(item["column"])
        if item["operator"] == "=":
            rows = rows.where(column == F.lit(item["value"]))
        elif item["operator"] == "IN":
            rows = rows.where(column.isin(*item["value"]))
        else:
            raise ValueError(f"unsupported filter operator {item['operator']!r}")
    order = spec.get("order_by", [])
    if spec.get("group_by"):
        names = {key: _name_of(_matching(spec["columns"], key)) for key in spec["group_by"]}
        totals = [F.expr(item["expression"]).alias(item["alias"]) for item in spec["aggregations"]]
        rows = rows.groupBy(*[F.expr(key).alias(name) for key, name in names.items()]).agg(*totals)
        rows = rows.select(
            *[_name_of(text) for text in spec["columns"]], *[item["alias"] for item in spec["aggregations"]]
        )
        rows = rows.orderBy(*[names.get(key, key) for key in order]) if order else rows
    else:
        rows = rows.orderBy(*order) if order else rows
        rows = rows.select(*[F.expr(text) for text in spec["columns"]])
    limit = spec.get("limit", limit)
    return rows.limit(limit) if limit is not None else rows


def _source_of(text: str) -> str:
    return text.rsplit(" AS ", 1)[0]


def _name_of(text: str) -> str:
    return text.rsplit(" AS ", 1)[1] if " AS " in text else text.rsplit(".", 1)[-1].strip("`")


def _matching(columns: list[str], key: str) -> str:
    return next((text for text in columns if _source_of(text) == key), key)


def parquet_opener(spark: SparkSession, root: str) -> Callable[[str, str | None], DataFrame]:
    """Datasets under a run folder; a scenario is a sub-folder, the base run has none (SRC-02)."""
    def open_dataset(path: str, scenario: str | None) -> DataFrame:
        return spark.read.parquet(f"{root}/{scenario}/{path}" if scenario else f"{root}/{path}")

    return open_dataset


# --- requests as rows --------------------------------------------------------------------


def check_requests(requests: DataFrame) -> DataFrame:
    """QRY-02: adds ``violation``, the first rule a request breaks, or null.

    Columns: kind, scenario, variable, spatial_scale as text, year as JSON text (so that a
    boolean or a fraction can be told from an integer), fields as the array of given keys.
    """
    year = F.col("year")
    whole = F.coalesce(year.rlike(r"^-?[0-9]{1,9}$"), F.lit(False))
    number = F.when(whole, year.cast("int"))
    null_year = year.isNull() | (year == "null")
    wanted = F.array(*[F.lit(name) for name in sorted(REQUEST_FIELDS)])
    empty = lambda name: F.coalesce(F.col(name) == "", F.lit(True))
    outside = lambda name, options: ~F.coalesce(F.col(name).isin(*options), F.lit(False))
    violation = (
        F.when(F.array_sort("fields") != wanted, "shape")
        .when(outside("kind", ["choropleth", "time-series"]), "kind")
        .when(empty("scenario"), "scenario")
        .when(empty("variable"), "variable")
        .when(outside("spatial_scale", ["hillslope", "patch"]), "spatial-scale")
        .when(~null_year & ~F.coalesce(number.between(*REQUEST_YEARS), F.lit(False)), "year")
        .when((F.col("kind") == "choropleth") & null_year, "year-required")
    )
    return requests.withColumn("violation", violation).withColumn("year_number", number)


def parse_request(document) -> dict:
    """One JSON request as a row for ``check_requests``."""
    fields = sorted(document) if isinstance(document, dict) else []
    given = document if isinstance(document, dict) else {}
    text = lambda name: given[name] if isinstance(given.get(name), str) else None
    return {
        "kind": text("kind"), "scenario": text("scenario"), "variable": text("variable"),
        "spatial_scale": text("spatial_scale"), "year": json.dumps(given.get("year")), "fields": fields,
    }


def resolve_requests(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    """QRY-03: the one declared dataset behind each valid request.

    ``catalogue``: dataset_key, scenario, role, variables (array), first_year, last_year.
    Adds dataset_key and ``violation`` (not exactly one dataset, or the year outside it).
    The request table carries ``request_id``; matches are counted after the equi-join.
    """
    role = F.when(
        (F.col("kind") == "choropleth") | (F.col("spatial_scale") == "patch"), F.col("spatial_scale")
    ).otherwise(F.lit("basin"))
    asked = requests.withColumn("role", role)
    declared = catalogue.select(
        "dataset_key", "scenario", "role", "first_year", "last_year", F.explode("variables").alias("variable")
    ).groupBy("scenario", "role", "variable").agg(
        F.count(F.lit(1)).alias("matches"), F.min("dataset_key").alias("dataset_key"),
        F.min("first_year").alias("first_year"), F.max("last_year").alias("last_year"),
    )
    joined = asked.join(declared, ["scenario", "role", "variable"], "left")
    violation = (
        F.when(F.col("violation").isNotNull(), F.col("violation"))
        .when(F.coalesce(F.col("matches"), F.lit(0)) != 1, "dataset")
        .when(
            F.col("year_number").isNotNull() & ~F.col("year_number").between(F.col("first_year"), F.col("last_year")),
            "year-range",
        )
    )
    return joined.withColumn("violation", violation).withColumn(
        "dataset_key", F.when(F.col("violation").isNull(), F.col("dataset_key"))
    )
