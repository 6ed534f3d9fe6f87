"""Numbering in pieces equals numbering in one go, also with one hot group."""

import random

import pytest
from pyspark.sql import functions as F

from loomframe.operators import ordering


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    ids = rng.sample(range(10_000), 900)
    # A third of all rows share one group; some groups are null.
    return [
        ("hot" if n % 3 == 0 else None if n % 11 == 0 else f"g{n % 40}", i, rng.randint(-5, 9))
        for n, i in enumerate(ids)
    ]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "grp string, id bigint, v int").repartition(7)


@pytest.mark.parametrize("size", [10_000, 100, 17])
def test_global_numbers(table, rows, size):
    got = ordering.numbered(table, ["id"], rows_per_task=size).collect()
    want = {i: n for n, i in enumerate(sorted(r[1] for r in rows))}
    assert {r["id"]: r["row_no"] for r in got} == want


def test_more_pieces_than_rows_of_some(table, rows):
    got = ordering.numbered(table, ["id"], within=["grp"], rows_per_task=3).collect()
    want = {}
    for g in {r[0] for r in rows}:
        want |= {i: n for n, i in enumerate(sorted(r[1] for r in rows if r[0] == g))}
    assert {r["id"]: r["row_no"] for r in got} == want


@pytest.mark.parametrize("size", [10_000, 100, 17])
def test_group_numbers_and_totals(table, rows, size):
    got = ordering.running_total(
        table, ["id"], F.col("v"), "sum", within=["grp"], rows_per_task=size
    )
    got = ordering.numbered(got, ["id"], "no", within=["grp"], rows_per_task=size).collect()
    want, seen = {}, {}
    for g, i, v in sorted(rows, key=lambda r: r[1]):
        n, total = seen.get(g, (0, 0))
        want[i] = (n, total + v)
        seen[g] = (n + 1, total + v)
    assert {r["id"]: (r["no"], r["sum"]) for r in got} == want
    assert len(got) == len(rows)


@pytest.mark.parametrize("size", [10_000, 50])
def test_gathered_lists_are_whole_and_bounded(table, rows, size):
    got = ordering.gathered(
        table, ["grp"], ["id"], F.col("v"), "items", chunk=25, rows_per_task=size
    ).collect()
    assert max(len(r["items"]) for r in got) <= 25
    joined = {}
    for r in sorted(got, key=lambda r: (str(r["grp"]), r["chunk"])):
        joined.setdefault(r["grp"], []).extend(r["items"])
    want = {}
    for g, _, v in sorted(rows, key=lambda r: r[1]):
        want.setdefault(g, []).append(v)
    assert joined == want


@pytest.mark.parametrize("block", [10_000, 9])
def test_trailing_blocks(table, rows, block):
    got = ordering.trailing(table.fillna("none"), "grp", "id", "v", 4, block=block, rows_per_task=80)
    want, seen = {}, {}
    for g, i, v in sorted(rows, key=lambda r: r[1]):
        held = seen.setdefault(g or "none", [])
        held.append(v)
        want[i] = held[-4:]
    assert {r["id"]: r["history"] for r in got.collect()} == want


@pytest.mark.parametrize("block", [4096, 5])
def test_moving_average_blocks(table, rows, block):
    got = ordering.moving_average(
        table.fillna("none"), "grp", "id", "v", 0.9, block=block, rows_per_task=80
    )
    want, count = {}, {}
    for g, _, v in sorted(rows, key=lambda r: r[1]):
        g = g or "none"
        n = count.get(g, 0)
        rate = 0.0 if n == 0 else min(0.9, (1 + n) / (10 + n))
        want[g] = rate * want.get(g, 0.0) + (1 - rate) * v
        count[g] = n + 1
    assert {r["grp"]: r["average"] for r in got.collect()} == pytest.approx(want)


def test_batches_drop_incomplete(table):
    kept = ordering.batches(table, ["id"], 64, drop_last=True, rows_per_task=100)
    sizes = {r["batch"]: r["count"] for r in kept.groupBy("batch").count().collect()}
    assert sizes == {n: 64 for n in range(900 // 64)}
