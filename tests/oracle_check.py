"""Runs registered queries in Spark and their SQL in DuckDB and compares whole results."""

import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, bool) or v is None:
        return str(v)
    return v


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((str(type(x)), str(x)) for x in r))


def compare(spark, con, sf_dir, fn, sql):
    """(message, spark_seconds, rows); the message is empty when both agree."""
    begin = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    ours = [tuple(_norm(r[c]) for c in cols) for r in df.collect()]
    took = time.time() - begin
    if sql is None:
        return "", took, len(ours)
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}", took, len(ours)
    at = [names.index(c) for c in cols]
    theirs = [tuple(_norm(r[i]) for i in at) for r in rel.fetchall()]
    if len(ours) != len(theirs):
        extra = _sorted(set(ours) - set(theirs))[:2], _sorted(set(theirs) - set(ours))[:2]
        return f"rows {len(ours)} != {len(theirs)} {cols} {extra}", took, len(ours)
    a, b = _sorted(ours), _sorted(theirs)
    for x, y in zip(a, b):
        if x != y:
            return f"{cols}\n   spark {x}\n   sql   {y}", took, len(ours)
    return "", took, len(ours)


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = next((a for a in sys.argv[1:] if a.startswith("/")), "/root/testdata/sf0.01")
    only = [a for a in sys.argv[1:] if not a.startswith("/")]
    session = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "12g")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    duck = connect(sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if only and not any(o in name for o in only):
            continue
        try:
            note, took, n = compare(session, duck, sf, fn, oracle.get(name))
        except Exception as e:  # noqa: BLE001 - every failure is reported and counted
            note, took, n = f"{type(e).__name__}: {str(e)[:1500]}", 0.0, -1
        bad += bool(note)
        mark = "FAIL" if note else ("ok  " if name in oracle else "rows")
        print(f"{mark} {name} rows={n} {took:.1f}s {note}", flush=True)
    print("failed:", bad)
    sys.exit(bool(bad))
