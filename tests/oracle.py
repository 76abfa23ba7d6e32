"""Compares a query with its SQL on the smallest tables."""

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def compare(spark, con, query, sql):
    df = query(spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(map(repr, r)) for r in df.select(*names).collect())
    want = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in names)} from ({sql})")
    assert got == sorted(tuple(map(repr, r)) for r in want.fetchall())
