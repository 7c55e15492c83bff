"""Run registered queries next to their DuckDB SQL: ``python tests/compare.py [sf_dir] [names..]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


timing: list[float] = []


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 9) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def connect(d):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    return con


def compare(spark, con, d, query, sql):
    """Empty text when both sides agree, else what differs."""
    timing[:] = [time.time()]
    df = query(spark, d)
    timing.append(time.time())
    left_columns, left = df.columns, [tuple(r) for r in df.collect()]
    timing.append(time.time())
    cursor = con.execute(sql)
    right_columns = [c[0] for c in cursor.description]
    right = cursor.fetchall()
    if sorted(left_columns) != sorted(right_columns):
        return f"columns {sorted(left_columns)} <> {sorted(right_columns)}"
    a, b = rows_of(left_columns, left), rows_of(right_columns, right)
    if a == b:
        return ""
    types = [(type(x).__name__, type(y).__name__) for x, y in zip(a[0], b[0])] if a and b else []
    only_a, only_b = list(set(map(repr, a)) - set(map(repr, b)))[:2], list(set(map(repr, b)) - set(map(repr, a)))[:2]
    return f"{len(a)} <> {len(b)} rows; types {types}\n   spark: {only_a}\n   duck:  {only_b}"


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    d = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(d)
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in oracle:
                problem = compare(spark, con, d, queries[name], oracle[name])
            else:
                problem = "" if queries[name](spark, d).count() else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += bool(problem)
        print(f"{'BAD ' if problem else 'ok  '} {name} {time.time() - start:.1f}s {[round(b - a, 1) for a, b in zip(timing, timing[1:])]}{'' if name in oracle else ' (rows only)'} {problem}", flush=True)
    print("bad:", bad, "missing oracle:", sorted(set(queries) - set(oracle)), "extra:", sorted(set(oracle) - set(queries)))


if __name__ == "__main__":
    main()
