"""Compares a query's rows with those of its SQL in DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x


def oracle(sf_dir, sql):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    found = connection.execute(sql)
    names = [d[0] for d in found.description]
    return names, found.fetchall()


def assert_same(df, sf_dir, sql):
    names, rows = oracle(sf_dir, sql)
    columns = sorted(df.columns)
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    key = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
    theirs = sorted((tuple(value(r[i]) for i in order) for r in rows), key=key)
    ours = sorted((tuple(value(x) for x in r) for r in df.select(*columns).collect()), key=key)
    assert len(ours) == len(theirs), (len(ours), len(theirs))
    for a, b in zip(ours, theirs, strict=True):
        assert a == b
