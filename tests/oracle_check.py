"""Compare registered queries with their SQL twins: python tests/oracle_check.py [sf] [name ...]."""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if hasattr(v, "normalize") and not isinstance(v, str):
        return float(f"{float(v):.9g}")
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return v
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql):
    """None when equal, else what differs."""
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    want, wcols = cur.fetchall(), [d[0] for d in cur.description]
    if sorted(df.columns) != sorted(wcols):
        return f"columns {sorted(df.columns)} vs {sorted(wcols)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    g, w = rows_of(df.columns, got), rows_of(wcols, want)
    bad = [(a, b) for a, b in zip(g, w) if a != b]
    return None if not bad else f"{len(bad)} of {len(g)} rows differ, e.g. {bad[:3]}"


def main():
    import __spark_entry__ as entry
    from sparkmeter.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    names = sys.argv[2:]
    spark = local_session()
    sf_dir = f"/root/testdata/{sf}"
    con = connect(sf_dir)
    q, o = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in q.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            err = compare(df, con, o[name]) if name in o else None
            n = df.count() if name not in o else ""
            status = "OK" if err is None else "DIFF " + err
        except Exception as e:  # report and go on
            status, n = "FAIL " + str(e)[:900].replace("\n", " "), ""
        bad += not status.startswith("OK")
        print(f"{time.time() - t:6.1f}s {name:34s} {status if name in o else status + ' (rows only) ' + str(n)}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
