"""Run registered queries against their SQL in DuckDB and report differences."""

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v) if v is not None else "None"


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


def differences(spark, con, name, fn, sql, sf_dir):
    """None if equal, else a short text."""
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return f"rows {len(got)} vs {len(want)}; only spark {len(a)}: {str(sorted(a)[:2])[:700]}; only sql {len(b)}: {str(sorted(b)[:2])[:700]}"
    return None if got else "both empty"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf = sys.argv[1]
    only = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name, fn in e.queries().items():
        if only and name not in only:
            continue
        t = time.time()
        try:
            sql = e.oracle_sql().get(name)
            if sql is None:
                n = fn(spark, sf).count()
                print(f"{name}: no sql, {n} rows {time.time() - t:.1f}s", flush=True)
                continue
            d = differences(spark, con, name, fn, sql, sf)
        except Exception as ex:  # noqa: BLE001
            d = f"{type(ex).__name__}: {str(ex)[:900]}"
        bad += d is not None
        print(f"{name}: {'ok' if d is None else d} {time.time() - t:.1f}s", flush=True)
    print("bad", bad)
