"""Runs a query and its SQL over the same tables and compares the rows."""

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz", "FLOAT": "float"}


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return repr(v + 0.0) if isinstance(v, float) else str(v)


def connection(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def check(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if not sql:
        return
    found = con.sql(sql)
    names = found.columns
    assert sorted(names) == columns
    want = sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in found.fetchall()), key=str)
    assert got == want
    kinds = dict(df.dtypes)
    assert {n: TYPES.get(str(t)) for n, t in zip(names, found.types)} == {n: kinds[n] for n in names}
