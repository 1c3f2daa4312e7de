"""Compare registered queries with their oracle SQL: python -m tests.oracle_check SF [names…]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.6f}"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return str(v)
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, sf: str, name: str, fn, sql: str | None):
    """(ok, message) of one query."""
    t0 = time.time()
    df = fn(spark, sf)
    got = df.collect()
    cols = df.columns
    took = time.time() - t0
    if sql is None:
        return True, f"{took:5.1f}s {len(got)} rows, no oracle"
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(want_cols):
        return False, f"columns {sorted(cols)} != {sorted(want_cols)}"
    a, b = rows_of(cols, [tuple(r) for r in got]), rows_of(want_cols, want)
    if a != b:
        sa, sb = set(a), set(b)
        return False, (f"{len(a)} vs {len(b)} rows; cols {sorted(cols)}; only spark {sorted(sa - sb)[:3]}; "
                       f"only sql {sorted(sb - sa)[:3]}")
    return True, f"{took:5.1f}s {len(a)} rows"


def session(cpus: int = 8):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("check")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main():
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    sf = f"/root/testdata/{sys.argv[1]}"
    q, o = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(q)
    spark, con = session(), connect(sf)
    bad = []
    for n in names:
        try:
            ok, msg = compare(spark, con, sf, n, q[n], o.get(n))
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{type(e).__name__}: {str(e)[:900]}"
        print("ok  " if ok else "FAIL", n, msg, flush=True)
        if not ok:
            bad.append(n)
    print(f"{len(names) - len(bad)}/{len(names)} ok; failed: {bad}")


if __name__ == "__main__":
    main()
