"""Run registered queries against their SQL twins; also a command: python -m tests.harness [sf] [names...]."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def session():
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").appName("gridsift")
             .config("spark.sql.shuffle.partitions", os.environ.get("SHUFFLE", "8")).config("spark.driver.memory", "8g")
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("NO_BROADCAST"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    return spark


def database(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, float) and value == 0:
        return repr(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, con, query, sql, sf):
    """(ok, message): names, row counts and values must agree exactly."""
    df = query(spark, sf)
    got_names = df.columns
    got = _rows(got_names, [tuple(row) for row in df.collect()])
    cursor = con.execute(sql)
    want_names = [d[0] for d in cursor.description]
    want = _rows(want_names, cursor.fetchall())
    if sorted(got_names) != sorted(want_names):
        return False, f"columns {sorted(got_names)} != {sorted(want_names)}"
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}"
    for a, b in zip(got, want):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            bad = sum(x != y for x, y in zip(got, want))
            return False, f"{sorted(got_names)}: {a} != {b} ({bad} of {len(got)} rows)"
    return True, f"{len(got)} rows"


def main(arguments):
    from __spark_entry__ import oracle_sql, queries
    sf = arguments[0] if arguments else "/root/testdata/sf0.01"
    wanted = arguments[1:]
    spark, con = session(), database(sf)
    sqls, failed = oracle_sql(), []
    for name, query in queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        started = time.time()
        try:
            if name in sqls:
                ok, message = compare(spark, con, query, sqls[name], sf)
            else:
                df = query(spark, sf)
                ok, message = True, f"{len(df.collect())} rows, no SQL {df.dtypes}"
        except Exception as error:  # noqa: BLE001
            ok, message = False, f"{type(error).__name__}: {str(error)[:1200]}"
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - started:.1f}s {message}", flush=True)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
