"""Compares each query with its SQL: ``python tests/oracle.py SF_DIR [NAME...]``."""

import datetime
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 9))
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return repr(v)


def compare(spark, name, run, sql, sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    began = time.time()
    df = run(spark, sf)
    mine = df.collect()
    took = time.time() - began
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    theirs = cur.fetchall()
    assert sorted(df.columns) == sorted(cols), (name, df.columns, cols)
    order = sorted(cols)
    a = sorted(tuple(norm(r[c]) for c in order) for r in mine)
    b = sorted(tuple(norm(r[cols.index(c)]) for c in order) for r in theirs)
    assert a == b, (name, order, len(a), len(b), [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3])
    return len(a), took


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    q, o, bad = e.queries(), e.oracle_sql(), 0
    for name in sys.argv[2:] or o:
        try:
            print(name, *compare(spark, name, q[name], o[name], sys.argv[1]), flush=True)
        except Exception as x:
            bad += 1
            print("BAD", name, str(x)[:700], flush=True)
    sys.exit(bad)
