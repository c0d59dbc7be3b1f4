"""Runs a query and its SQL over the same tables."""

import datetime
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection():
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    return con


def rows(columns, values):
    def plain(v):
        if isinstance(v, bool) or v is None or isinstance(v, (str, datetime.date)):
            return v
        return round(float(v), 9) + 0.0

    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[k]) for k in order) for r in values), key=repr)


def agree(spark, con, query, sql):
    df = query(spark, DATA)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, found.fetchall())
