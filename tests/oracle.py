"""Compares a query with its SQL, without regard to the order of rows."""

from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    return round(x, 6) if isinstance(x, float) else str(x) if not isinstance(x, (int, str, bool, type(None))) else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in data)


def same(df, sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = con.execute(sql)
    expected = rows([c[0] for c in found.description], found.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == expected[0]
    assert got[1] == expected[1]
