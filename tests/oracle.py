"""Runs a query and its SQL and compares columns, kinds and rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def canon(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(canon(r[i]) for i in order) for r in data), key=repr)


KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def difference(spark, con, sf_dir, make, sql):
    """None if they agree, else what differs."""
    df = make(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = rows(rel.columns, rel.fetchall())
    kinds = {c: KINDS.get(k, k) for c, k in df.dtypes}
    told = {c: str(t) for c, t in zip(rel.columns, rel.types, strict=True)}
    if kinds != told:
        return f"kinds {kinds} and {told}; rows {len(got)} {len(want)}"
    if got != want:
        a, b = [x for x in got if x not in set(want)][:2], [x for x in want if x not in set(got)][:2]
        return f"rows {len(got)} and {len(want)}; only here {a}; only there {b}"
    return None
