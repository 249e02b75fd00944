"""Runs a query and its SQL side by side."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def by_sql(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return names, got.fetchall()


def same(df, sql, sf_dir):
    names, rows = by_sql(sql, sf_dir)
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    left = sorted(repr(tuple(r[c] for c in order)) for r in df.collect())
    right = sorted(repr(tuple(dict(zip(names, r))[c] for c in order)) for r in rows)
    assert left == right
