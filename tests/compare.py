"""Side-by-side run of a query and its SQL twin.  Also a small command line:

    python -m tests.compare [sf] [query ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def frame(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def kind(dtype: str) -> str:
    dtype = str(dtype).lower()
    if dtype in ("double", "float"):
        return "float"
    if "int" in dtype or dtype in ("hugeint", "long"):
        return "integer:" + {"bigint": "64", "long": "64", "integer": "32", "int": "32"}.get(dtype, dtype)
    return {"varchar": "string"}.get(dtype, dtype)


def compare(spark, con, name: str, build, sql: str, sf_dir: str) -> tuple[bool, str]:
    began = time.time()
    df = build(spark, sf_dir)
    got = frame(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - began
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    types = {d[0]: kind(d[1]) for d in result.description}
    want = frame(columns, result.fetchall())
    mine = {f.name: kind(f.dataType.simpleString()) for f in df.schema.fields}
    note = f"{len(got[1])} rows, {spent:.2f}s"
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}"
    if mine != types:
        note += f", types { {k: (mine[k], types[k]) for k in mine if mine[k] != types[k]} }"
    if got[1] == want[1]:
        return True, note
    only, other = list(set(got[1]) - set(want[1]))[:2], list(set(want[1]) - set(got[1]))[:2]
    cut = lambda rows: [tuple(x[:150] for x in r) for r in rows]
    return False, f"{note} vs {len(want[1])}\n   spark {cut(only)}\n   sql   {cut(other)}"


if __name__ == "__main__":
    from loomframe.plans import ORACLE, QUERIES
    from loomframe.session import local_session

    sf = f"/root/testdata/sf{sys.argv[1]}" if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:] or list(QUERIES)
    spark, con, bad = local_session(), duck(sf), []
    for name in wanted:
        try:
            if name in ORACLE:
                ok, note = compare(spark, con, name, QUERIES[name], ORACLE[name], sf)
            else:
                began = time.time()
                n = len(QUERIES[name](spark, sf).collect())
                ok, note = True, f"{n} rows only, {time.time() - began:.2f}s"
        except Exception as error:  # noqa: BLE001
            ok, note = False, str(error)[:900]
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)
