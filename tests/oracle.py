"""Comparing a query's rows with those of its SQL."""

import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: round(x, 9) if isinstance(x, float) else x
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


def assert_same(spark, folder, query, sql):
    df = query(spark, folder)
    cursor = connect(folder).execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cursor.fetchall())
