"""Run registered queries beside their SQL and compare the rows.

Usage: python -m dinesight.check SF_DIR [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from dinesight.catalog import load
from dinesight.session import build_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()

SPARK_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
               "DATE": "date", "TIMESTAMP": "timestamp", "FLOAT": "float"}


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat() if hasattr(value, "tzinfo") else value.isoformat()
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def main(sf_dir: str, names: list[str]) -> int:
    spark = build_session(master="local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    failures = 0
    entries = load()
    for name in names or list(entries):
        entry = entries[name]
        started = time.time()
        try:
            df = entry.run(spark, sf_dir)
            got = [tuple(r) for r in df.collect()]
        except Exception as exc:  # report and go on to the next query
            print(f"ERROR {name}: {str(exc)[:700]}", flush=True)
            failures += 1
            continue
        took = time.time() - started
        if entry.sql is None:
            print(f"rows  {name}: {len(got)} rows {took:.1f}s", flush=True)
            continue
        try:
            res = con.execute(entry.sql)
            want_columns, want = [d[0] for d in res.description], res.fetchall()
        except Exception as exc:
            print(f"SQLERR {name}: {str(exc)[:700]}", flush=True)
            failures += 1
            continue
        a, b = _rows(df.columns, got), _rows(want_columns, want)
        kinds = {d[0]: str(d[1]) for d in res.description}
        for column, kind in df.dtypes:
            expected = SPARK_TYPES.get(kinds.get(column, ""), kinds.get(column, "").lower())
            if column in kinds and kind.replace("timestamp_ntz", "timestamp") != expected:
                print(f"TYPE  {name}.{column}: {kind} vs {kinds[column]}", flush=True)
                failures += 1
        if sorted(df.columns) != sorted(want_columns):
            print(f"COLS  {name}: {sorted(df.columns)} vs {sorted(want_columns)}", flush=True)
            failures += 1
        elif a != b:
            only_a, only_b = set(map(repr, a)) - set(map(repr, b)), set(map(repr, b)) - set(map(repr, a))
            print(f"DIFF  {name}: {len(a)} vs {len(b)} rows; spark only {sorted(only_a)[:3]}; sql only {sorted(only_b)[:3]}",
                  flush=True)
            failures += 1
        else:
            flag = "" if len(a) else "  EMPTY"
            print(f"ok    {name}: {len(a)} rows {took:.1f}s{flag}", flush=True)
    print(f"{failures} failures", flush=True)
    return failures


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
