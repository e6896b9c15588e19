"""Compare registered queries with their SQL on the driver tables.

    python tests/compare.py sf0.01 [query ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
ROOT = os.environ.get("HEADWATER_TESTDATA", "/root/testdata")


def plain(value):
    """A comparable text of a cell: numbers by value, times as ISO text, null marked."""
    if value is None:
        return "\0"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0) if not value.is_integer() else str(int(value))
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def connect(folder: str):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, connection, folder, build, sql):
    """None if the two results hold the same columns and rows, else what differs."""
    df = build(spark, folder)
    names, ours = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = connection.execute(sql)
    theirs_names, theirs = sorted_rows([d[0] for d in cursor.description], cursor.fetchall())
    if names != theirs_names:
        return f"columns {names} against {theirs_names}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    if ours != theirs:
        first = next(i for i, (a, b) in enumerate(zip(ours, theirs)) if a != b)
        return f"row {first} of {len(ours)}: {names} {ours[first]} against {theirs[first]}"
    return None


def main():
    from __spark_entry__ import oracle_sql, queries
    from headwater.session import build_session

    folder = f"{ROOT}/{sys.argv[1]}"
    built, sqls = queries(), oracle_sql()
    names = sys.argv[2:] or list(built)
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, connection, folder, built[name], sqls[name])
            else:
                rows = built[name](spark, folder).count()
                problem = None if rows else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok':4} {name:28} {time.time() - start:6.2f}s {problem or ''}"[:1500], flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
