"""Run registered queries beside their SQL twins: python tests/oracle.py SF_DIR [NAME...]"""

import math
import os
import sys
import time
from collections import Counter

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return round(float(v), 6) if type(v).__name__ == "Decimal" else list(map(plain, v)) if isinstance(v, list | tuple) else v


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(p := f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*' if os.path.isdir(p) else ''}')")
    return con


def compared(df, con, sql):
    """Problems of a Spark result against SQL."""
    got = df.collect()
    names = sorted(df.columns)
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    if sorted(cols) != names:
        return [f"columns {names} against {sorted(cols)}"]
    want = Counter(str([plain(r[cols.index(c)]) for c in names]) for r in cur.fetchall())
    have = Counter(str([plain(r[c]) for c in names]) for r in got)
    if want != have:
        return [f"{len(got)} rows against {sum(want.values())}", f"only Spark: {list((have - want))[:3]}", f"only SQL: {list((want - have))[:3]}"]
    return []


if __name__ == "__main__":
    import __spark_entry__ as e
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sql, con = e.oracle_sql(), duck(sys.argv[1])
    for name, f in e.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        if not sys.argv[2:] and name not in sql:
            continue
        began = time.time()
        try:
            bad = compared(f(spark, sys.argv[1]), con, sql[name])
        except Exception as x:
            bad = [f"{type(x).__name__}: {str(x)[:400]}"]
        print("ok  " if not bad else "BAD ", name, f"{time.time() - began:.1f}s", *bad, flush=True)
