"""Compares a query's Spark result with its DuckDB SQL, order-insensitively, as the driver does."""

import glob
import math
import os

import duckdb

#: The smallest of the given tables.
SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        p = f"{p}/*.parquet" if os.path.isdir(p) else p
        if glob.glob(p):
            c.sql(f"create view {t} as select * from '{p}'")
    return c


def cell(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        v = float(v)
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql):
    """None if equal, else a short description."""
    r = con.sql(sql)
    want_cols, want = list(r.columns), r.fetchall()
    got_cols = spark_df.columns
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} and {sorted(want_cols)}"
    got, want = table(got_cols, [tuple(x) for x in spark_df.collect()]), table(want_cols, want)
    if got == want:
        return None
    a, b = [x for x in got if x not in set(want)][:2], [x for x in want if x not in set(got)][:2]
    return f"{len(got)} and {len(want)} rows; only in Spark {a}, only in DuckDB {b}"
