"""Run registered queries in Spark and their SQL in DuckDB and compare all rows.

Usable from the command line: python tests/oracle.py [--sf DIR] [--explain] [names...]
"""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
DEFAULT_SF = "/root/testdata/sf0.01"


def session():
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master("local[8]").appName("waveledger")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf: str = DEFAULT_SF):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _kind(v):
    return "float" if isinstance(v, (float, Decimal)) else type(v).__name__


def _sorted_rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=lambda r: tuple(str(x) for x in r))


def compare(got, want) -> list[str]:
    """Differences between (columns, rows) pairs; empty when equal."""
    gc, gr = _sorted_rows(*got)
    wc, wr = _sorted_rows(*want)
    if gc != wc:
        return [f"columns {gc} != {wc}"]
    if len(gr) != len(wr):
        return [f"{len(gr)} rows, expected {len(wr)}; first {gr[:2]} / {wr[:2]}"]
    out = []
    for a, b in zip(gr, wr):
        if a != b:
            out.append(f"{a} != {b}")
        else:
            for c, x, y in zip(gc, a, b):
                if _kind(x) != _kind(y):
                    out.append(f"type of {c}: {_kind(x)} != {_kind(y)}")
    return out


def run_spark(spark, fn, sf):
    df = fn(spark, sf)
    return df.columns, [tuple(r) for r in df.collect()]


def run_duck(con, sql):
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def main(args):
    import __spark_entry__ as entry

    sf = DEFAULT_SF
    if "--sf" in args:
        at = args.index("--sf")
        sf = args[at + 1]
        del args[at:at + 2]
    explain = "--explain" in args
    names = [a for a in args if not a.startswith("--")]
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = names or list(queries)
    spark, con = session(), duck(sf)
    bad = []
    for name in names:
        t0 = time.time()
        try:
            if explain:
                queries[name](spark, sf).explain("formatted")
            got = run_spark(spark, queries[name], sf)
            t1 = time.time()
            if name in oracles:
                diff = compare(got, run_duck(con, oracles[name]))
                note = "ok" if not diff else f"DIFF {len(diff)}: " + " | ".join(diff[:3])
            else:
                diff, note = [], "rows only"
            print(f"{name:24s} {len(got[1]):7d} rows {t1 - t0:6.2f}s "
                  f"{time.time() - t1:6.2f}s  {note[:900]}", flush=True)
            if diff:
                bad.append(name)
        except Exception as exc:  # noqa: BLE001 - report and go on
            print(f"{name:24s} ERROR {type(exc).__name__}: {str(exc)[:900]}", flush=True)
            bad.append(name)
    print("BAD:" if bad else "ALL GOOD", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
