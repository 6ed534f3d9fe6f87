"""Vector jobs against brute force, at every size of tiles and blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.functions import arrays
from loomframe.operators import matching, metrics, schedule, vectors


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    z, e = rng.normal(size=(120, 6)), rng.normal(size=(20, 6))
    vec = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(z)], "id bigint, z array<double>")
    code = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(e)], "code bigint, e array<double>")
    return z, e, vec, code


# bytes of shipped tables and of tiles: whole, blocks of a few rows, tiles of three rows
SIZES = [(1 << 26, 1 << 25), (7 * 48, 1 << 25), (1 << 26, 3 * 48), (9 * 48, 3 * 48)]


@pytest.mark.parametrize("ship,tile", SIZES)
def test_nearest(data, ship, tile):
    z, e, vec, code = data
    dist = ((z[:, None] - e[None]) ** 2).sum(2)
    found = matching.nearest_code(vec, code, ship_bytes=ship, tile_bytes=tile, keep_vector=True)
    got = {r["id"]: r for r in found.collect()}
    assert [got[i]["code"] for i in range(len(z))] == dist.argmin(1).tolist()
    assert [got[i]["dist"] for i in range(len(z))] == pytest.approx(dist.min(1).tolist())
    assert got[3]["z"] == z[3].tolist()


@pytest.mark.parametrize("ship,tile", SIZES)
def test_top_matches(data, ship, tile):
    z, e, vec, code = data
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    want = np.argsort(-(unit(z) @ unit(e).T), axis=1)[:, :3]
    got = matching.top_matches(vec, code, 3, ship_bytes=ship, tile_bytes=tile).orderBy("id", "rank").collect()
    assert [r["code"] for r in got] == want.ravel().tolist()


@pytest.mark.parametrize("ship,tile", SIZES)
def test_ties_go_to_the_lower_code(spark, ship, tile):
    vec = spark.createDataFrame([(i, [float(i % 4)] * 6) for i in range(40)], "id bigint, z array<double>")
    code = spark.createDataFrame([(30 - i, [float(i % 2)] * 6) for i in range(30)], "code bigint, e array<double>")
    top = matching.closest(vec, code, 3, ship_bytes=ship, tile_bytes=tile).orderBy("id", "rank").collect()
    even, odd = [2, 4, 6], [1, 3, 5]
    assert [r["code"] for r in top] == [c for i in range(40) for c in (even if i % 4 == 0 else odd)]


def test_the_exact_distance_decides(spark):
    vec = spark.createDataFrame([(0, [1e8, 1.0])], "id bigint, z array<double>")
    code = spark.createDataFrame([(0, [1e8, 1.5]), (1, [1e8, 0.9])], "code bigint, e array<double>")
    row = matching.nearest_code(vec, code).first()
    assert (row["code"], row["dist"]) == (1, pytest.approx(0.01))


@pytest.mark.parametrize("ship", [1 << 26, 5 * 48])
def test_similarity_whole(data, ship):
    z, e, vec, code = data
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    want = np.exp(0.5) * unit(z) @ unit(e).T
    rows = matching.similarity(vec, code, 0.5, ship_bytes=ship, part_rows=8).collect()
    got = {(r["id"], c): x for r in rows for c, x in zip(r["codes"], r["logits"])}
    assert len(got) == want.size and max(len(r["codes"]) for r in rows) <= 20
    assert all(got[i, c] == pytest.approx(want[i, c]) for i in range(len(z)) for c in range(len(e)))


@pytest.mark.parametrize("ship", [1 << 26, 8])
def test_empty_tables_and_zero_vectors(spark, data, ship):
    _, _, vec, code = data
    none, blank = code.limit(0), spark.createDataFrame([(0, [0.0] * 6)], "id bigint, z array<double>")
    assert matching.nearest_code(vec, none, ship_bytes=ship).count() == 0
    assert matching.top_matches(vec.limit(0), code, 2, ship_bytes=ship).count() == 0
    assert matching.similarity(vec, none, ship_bytes=ship).count() == 0
    assert [r["score"] for r in matching.top_matches(blank, code, 2, ship_bytes=ship).collect()] == [0.0, 0.0]


def test_summed_statistics(data):
    z, _, vec, _ = data
    stats = {r["pos"]: r for r in metrics.channel_stats(vec, "z").collect()}
    assert [stats[n]["std"] for n in range(6)] == pytest.approx(z.std(0, ddof=1).tolist())
    assert metrics.scale_factor(vec, "z").first()["std"] == pytest.approx(z.std(ddof=1))
    means = vectors.element_means(vec.selectExpr("id % 3 as g", "z"), "g", "z").collect()
    assert all(r["mean"] == pytest.approx(z[r["g"] :: 3, r["pos"]].mean()) and r["n"] == 40 for r in means)


def test_kmeans_reseeds_empty_codes(spark):
    vec = spark.createDataFrame([(i, [float(i % 3), 0.0]) for i in range(30)], "id bigint, z array<double>")
    start = spark.createDataFrame([(0, [0.0, 0.0]), (1, [900.0, 0.0])], "code bigint, e array<double>")
    got = {r["code"]: r["e"] for r in vectors.kmeans(vec, 2, 1, 5, start=start).collect()}
    assert got[0] == pytest.approx([1.0, 0.0])
    assert got[1][0] in (0.0, 1.0, 2.0)


def test_perplexity_of_two_equal_codes(spark):
    table = spark.createDataFrame([(n % 2,) for n in range(10)], "code bigint")
    row = vectors.perplexity(vectors.code_usage(table)).first()
    assert row["perplexity"] == pytest.approx(2.0, abs=1e-6) and row["used"] == 2


def test_remap_round_trip(spark):
    codes = spark.createDataFrame([(n, n) for n in range(6)], "id bigint, code bigint")
    used = spark.createDataFrame([(1, 0), (4, 1)], "code bigint, position bigint")
    out = vectors.unmap_codes(vectors.remap_codes(codes, used), used, into="back")
    assert {r["code"]: (r["compact"], r["back"]) for r in out.collect()} == {
        1: (0, 1), 4: (1, 4), 0: (2, 1), 2: (2, 1), 3: (2, 1), 5: (2, 1),
    }
    fixed = vectors.remap_codes(codes, used, unknown=1)
    assert {r["code"]: r["compact"] for r in fixed.collect()}[3] == 1


@pytest.mark.parametrize("kind", ["linear", "sqrt_linear", "sqrt", "cosine"])
def test_schedules(spark, kind):
    steps = 50
    got = schedule.schedule(spark, steps, schedule.betas(kind, steps), kind="x0").orderBy("t").collect()
    t = np.arange(steps)
    if kind == "cosine":
        f = np.cos(((np.arange(steps + 1) / steps + 8e-3) / 1.008) * np.pi / 2) ** 2
        want = np.clip(1 - f[1:] / f[:-1], 0, 0.999)
    else:
        line = 1e-4 + (2e-2 - 1e-4) * t / (steps - 1)
        want = {
            "linear": (1e-2 + (2e-2**0.5 - 1e-2) * t / (steps - 1)) ** 2,
            "sqrt_linear": line, "sqrt": np.sqrt(line),
        }[kind]
    assert [r["beta"] for r in got] == pytest.approx(want.tolist())
    bar = np.cumprod(1 - want)
    assert [r["alpha_bar"] for r in got] == pytest.approx(bar.tolist())
    weight = 0.5 * np.sqrt(bar) / (2 - bar)
    assert [r["weight"] for r in got] == pytest.approx([weight[1], *weight[1:]])


def test_steps():
    assert schedule.uniform_steps(1000, 4) == [1, 251, 501, 751]
    assert schedule.quadratic_steps(1000, 5)[0] == 1 and schedule.quadratic_steps(1000, 5)[-1] in (800, 801)


def test_embedding_of_ragged_rows(spark):
    rows = [(n, list(range(n % 4)), [1] * (n % 4)) for n in range(20)] + [(99, None, None)]
    table = spark.createDataFrame(rows, "id bigint, ids array<int>, mask array<int>")
    seen = vectors.embed(table, "ids", "mask", lambda: lambda ids, mask: np.stack([ids * mask, ids + 1], axis=2), width=2, batch_size=3)
    got = {r["id"]: r["embedding"] for r in seen.collect()}
    assert got[99] is None
    assert all(got[n] == [float(v) for k in range(n % 4) for v in (k, k + 1)] for n in range(20))


def test_embedding_job_and_check(spark):
    table = spark.createDataFrame([(n, [n, 1, 2], [1, 1, 0]) for n in range(9)], "id bigint, ids array<int>, mask array<int>")

    def make_encoder():
        return lambda ids, mask: (ids * mask)[:, :, None] * np.array([1.0, 10.0])

    out = vectors.embed(table, "ids", "mask", make_encoder, width=2, batch_size=4)
    first = out.filter("id = 3").first()["embedding"]
    assert first == [3.0, 30.0, 1.0, 10.0, 0.0, 0.0]
    packed = out.withColumn("raw", arrays.to_float_bytes("embedding"))
    check = packed.agg(
        vectors.largest_difference(arrays.from_float_bytes("raw", 6), F.col("embedding")).alias("d")
    )
    assert check.first()["d"] == 0.0
