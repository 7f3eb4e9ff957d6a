"""Run registered queries and their SQL twins on the same files and compare all rows.

    python tests/compare.py [sf directory] [query ...]
"""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return ("dec", float(value))
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def difference(spark, con, query, sql, sf_dir) -> str | None:
    """None if both sides agree, else what differs."""
    df = query(spark, sf_dir)
    left_cols, left = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    right_cols, right = rows_of(names, cur.fetchall())
    if left_cols != right_cols:
        return f"columns {sorted(set(left_cols) ^ set(right_cols))}"
    spark_kinds = dict(df.dtypes)
    same = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE",
            "boolean": "BOOLEAN", "date": "DATE"}
    bad = [(c, spark_kinds[c], kinds[c]) for c in left_cols
           if spark_kinds[c] in same and same[spark_kinds[c]] != kinds[c]]
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}; types {bad}"
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    if wrong:
        a, b = wrong[0]
        cells = [(c, x, y) for c, x, y in zip(left_cols, a, b) if x != y]
        return f"{len(wrong)} of {len(left)} rows differ, first: {cells[:6]}"
    if bad:
        return f"types {bad}"
    return None if left else "EMPTY (0 rows on both sides)"


def main(argv) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(queries)
    con, failed = connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            if name in oracle:
                found = difference(spark, con, queries[name], oracle[name], sf_dir)
            else:
                found = f"(no SQL) rows {queries[name](spark, sf_dir).count()}"
        except Exception as error:  # report and go on with the next query
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        ok = found is None or found.startswith("(no SQL)")
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {found or ''}", flush=True)
    print("missing queries for", sorted(set(oracle) - set(queries)))
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
