"""Runs registered queries beside their SQL: python tests/compare.py [sf folder] [name prefix...]"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(frame):
    """Rows as a sorted list of texts, columns by name; doubles to 6 places."""
    import pandas as pd

    out = []
    cols = sorted(frame.columns)
    for r in frame[cols].itertuples(index=False):
        out.append(tuple(None if pd.isna(v) else f"{v:.6g}" if isinstance(v, float) else str(int(v)) if hasattr(v, "__index__") and not isinstance(v, bool) else str(v) for v in r))
    return cols, sorted(out, key=str)


if __name__ == "__main__":
    import time
    import traceback

    from pyspark.sql import SparkSession

    from evidentia.plans import registry

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "5g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    d, prefixes = (sys.argv[1:2] or ["/root/testdata/sf0.001"])[0], tuple(sys.argv[2:])
    con = duck(d)
    for name, run in registry.QUERIES.items():
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            t = time.time()
            got = run(spark, d).toPandas()
            took = time.time() - t
            if name not in registry.ORACLES:
                print("rows", name, len(got), f"{took:.1f}s")
                continue
            a, b = rows(got), rows(con.sql(registry.ORACLES[name]).df())
            if a == b:
                print("ok  ", name, len(a[1]), f"{took:.1f}s")
            else:
                x = [r for r in a[1] if r not in set(b[1])][:2]
                y = [r for r in b[1] if r not in set(a[1])][:2]
                print("DIFF", name, a[0], b[0], len(a[1]), len(b[1]), x, y)
        except Exception as e:
            print("FAIL", name, str(e)[:700].replace("\n", " "))
            if "-v" in sys.argv:
                traceback.print_exc()
