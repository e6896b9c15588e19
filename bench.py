"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Each query is run to its end without moving rows to Python. The figure is the best of two
runs after one warm-up query, so that it measures the plan and not the start of the JVM. Beside it stands
the time DuckDB takes for the query's SQL on the same files. BENCH_QUERIES names other queries, or ``all``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from headwater.catalog import ORACLES, QUERIES  # noqa: E402
from headwater.session import build_session  # noqa: E402

HEADLINE = [
    "rap_watershed_by_year", "rap_choropleth_single", "rap_choropleth_multi", "rap_hillslope_series", "chart_fill",
    "rhessys_choropleth", "rhessys_series_month", "rhessys_series_year", "scenario_summary", "scenario_rows",
    "landuse_legend", "robust_range_by_flag", "robust_range_pixels", "choropleth_style", "feature_colour",
    "search_rank", "query_requests", "attribute_join", "exact_coverage", "enrich_report", "integrity_preflight",
    "identity_report", "audit_report", "resolve_runs", "strict_increase", "pixel_rescale", "tile_index", "covers",
    "polygon_merge", "release_plan", "plan_rules", "child_merge", "merge_result", "table_fingerprint",
    "sequence_digest", "domain_digest", "redact", "latest_snapshot", "capability_rules",
]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages conversations".split()


def duckdb_times(folder: str, names: list[str], cpus: str) -> dict[str, float]:
    """Seconds of each query's SQL, the better of two runs; empty where DuckDB is not installed."""
    try:
        import duckdb
    except ModuleNotFoundError:
        return {}
    connection = duckdb.connect(config={"threads": int(cpus)})
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    found = {}
    for name in names:
        runs = []
        for _ in range(2 if name in ORACLES else 0):
            start = time.perf_counter()
            connection.execute(ORACLES[name]).fetchall()
            runs.append(time.perf_counter() - start)
        if runs:
            found[name] = round(min(runs), 3)
    return found


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    names = sorted(QUERIES) if names == ["all"] else names
    spark = build_session(
        "headwater-bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run(names[0])
    times = {name: round(min(run(name), run(name)), 3) for name in names}
    print(json.dumps({
        "metric": "headline queries, total of best-of-two", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "duckdb": duckdb_times(folder, names, cpus), "sf": os.path.basename(folder.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
