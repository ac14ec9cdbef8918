"""Run a query on Spark and its twin on DuckDB and compare rows as a bag.

python tests/oracle.py [sf] [name ...]
"""

import datetime
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path("/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    f = float(v)
    return "nan" if math.isnan(f) else 0.0 if f == 0 else f


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda j: columns[j])
    return sorted(columns), Counter(tuple(plain(r[j]) for j in order) for r in rows)


def compare(con, df, sql):
    got = bag(df.columns, df.collect())
    rel = con.execute(sql)
    want = bag([c[0] for c in rel.description], rel.fetchall())
    if got == want:
        return None
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    extra, missing = got[1] - want[1], want[1] - got[1]
    return f"rows {sum(got[1].values())} vs {sum(want[1].values())}; {sum(extra.values())} extra e.g. {list(extra)[:2]}, {sum(missing.values())} missing e.g. {list(missing)[:2]}"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from __spark_entry__ import oracle_sql, queries
    from tracewell.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    folder, oracle = str(ROOT / f"sf{sf}"), oracle_sql()
    con = connect(folder)
    bad = 0
    for name, fn in queries().items():
        if len(sys.argv) > 2 and not any(name.startswith(a) for a in sys.argv[2:]):
            continue
        start = time.time()
        try:
            if name in oracle:
                problem = compare(con, fn(spark, folder), oracle[name])
            else:
                problem = None if fn(spark, folder).collect() else "no rows"
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {'' if name in oracle else '(rows only) '}{problem or ''}", flush=True)
    print("failures:", bad)
