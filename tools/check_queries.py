"""Run registered queries and compare each with its SQL text on the same files.

usage: check_queries.py [scale, default 0.001] [name part ...]
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import numpy as np  # noqa: E402
import pandas as pd  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from tetrarank import workloads  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, (float, np.floating)) and np.isnan(v)):
        return "NULL"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (float, np.floating)) and float(v).is_integer() and abs(v) < 1e15:
        return str(int(v))
    return str(v.item() if isinstance(v, np.generic) else v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(cell(v) for v in r) for r in frame.itertuples(index=False, name=None))


def compare(spark, con, name, folder):
    """(problem or None, number of rows) of one query."""
    got = workloads.all_queries()[name](spark, folder).toPandas()
    sql = workloads.all_oracles().get(name)
    if sql is None:
        return (None if len(got) else "no rows"), len(got)
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} against {sorted(want.columns)}", len(got)
    a, b = rows(got), rows(want)
    if a == b:
        return None, len(a)
    return f"{len(a)} against {len(b)} rows; {sorted(set(a) - set(b))[:2]} against {sorted(set(b) - set(a))[:2]}", len(a)


def main():
    scale = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    folder = f"/root/testdata/sf{scale}"
    spark = (SparkSession.builder.master(f"local[{os.environ.get('CPUS', '8')}]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = []
    for name in workloads.all_queries():
        if sys.argv[2:] and not any(part in name for part in sys.argv[2:]):
            continue
        start = time.time()
        try:
            problem, n = compare(spark, con, name, folder)
        except Exception as e:  # report and go on with the next query
            problem, n = f"{type(e).__name__}: {str(e)[:800]}", 0
        kind = "sql" if name in workloads.all_oracles() else "rows"
        print(f"{'FAIL' if problem else 'ok':5}{kind:5}{time.time() - start:7.1f}s {n:8} {name} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
    sys.exit(bool(failed))


if __name__ == "__main__":
    main()
