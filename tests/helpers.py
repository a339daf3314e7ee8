"""Comparing a query with its SQL, as the driver does."""

import os

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        p = p + "/*.parquet" if os.path.isdir(p) else p
        con.execute(f"create view {t} as select * from '{p}'")
    return con


def rows_of(frame):
    cols = sorted(frame.columns)
    frame = frame[cols].copy()
    for c in cols:
        if frame[c].dtype.kind == "f":
            frame[c] = frame[c].round(6)
    return cols, sorted(map(tuple, frame.astype(str).to_numpy().tolist()))


def same(got, expected):
    (a, x), (b, y) = rows_of(got), rows_of(expected)
    assert a == b
    assert len(x) == len(y)
    assert x == y
