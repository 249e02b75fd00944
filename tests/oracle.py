"""Runs a query and its SQL side by side."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, decimal.Decimal):
        return round(float(x), 6) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return x


def kind(x):
    return "int" if isinstance(x, int) and not isinstance(x, bool) else type(x).__name__


def differences(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    right = got.fetchall()
    left = df.collect()
    order = sorted(names)
    if order != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {order}"
    at = [names.index(c) for c in order]
    a = sorted(repr([plain(r[c]) for c in order]) for r in left)
    b = sorted(repr([plain(r[i]) for i in at]) for r in right)
    if a != b:
        only = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        return f"{len(a)} and {len(b)} rows; only in one: {only}"
    if left:
        kinds = {(kind(left[0][c]), kind(right[0][i])) for c, i in zip(order, at)}
        odd = [k for k in kinds if k[0] != k[1] and "NoneType" not in k]
        if odd and not any(r is None for r in right[0]):
            return f"types {odd}"
    return None
