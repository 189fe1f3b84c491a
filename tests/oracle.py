"""Runs a query and its SQL over the same tables and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    return x


def compare(spark, con, name, run, sql, sf_dir):
    got = run(spark, sf_dir)
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns), (name, names, got.columns)
    order = sorted(names)
    have = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=repr)
    rows = [dict(zip(names, r, strict=True)) for r in want.fetchall()]
    need = sorted((tuple(plain(r[c]) for c in order) for r in rows), key=repr)
    assert len(have) == len(need), (name, len(have), len(need))
    wrong = [(a, b) for a, b in zip(have, need, strict=True) if a != b]
    assert not wrong, (name, wrong[:3])
    return len(have)
