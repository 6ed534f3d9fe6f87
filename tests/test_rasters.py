"""Column rasters against the same filters written with dense matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.functions import rasters
from loomframe.operators import images


def dense(n_in, n_out, kind, edge):
    out = np.zeros((n_out, n_in))
    stretch = max(1.0, n_in / n_out)
    radius = {"box": 0.5, "linear": 1, "cubic": 2}.get(kind)
    for o in range(n_out):
        if kind == "nearest":
            out[o, min(int((o + 0.5) * n_in / n_out), n_in - 1)] = 1
            continue
        centre = (o + 0.5) * n_in / n_out - 0.5
        for at in range(int(centre - radius * stretch) - 3, int(centre + radius * stretch) + 4):
            d = (centre - at) / stretch
            a = abs(d)
            w = {
                "box": float(-0.5 < d <= 0.5), "linear": max(0.0, 1 - a),
                "cubic": (1.5 * a - 2.5) * a * a + 1 if a <= 1 else ((2.5 - 0.5 * a) * a - 4) * a + 2 if a < 2 else 0.0,
            }[kind]
            if edge == "mirror":
                fold = at % (2 * n_in)
                out[o, 2 * n_in - 1 - fold if fold >= n_in else fold] += w
            elif 0 <= at < n_in:
                out[o, at] += w
    return out / out.sum(1, keepdims=True)


@pytest.fixture(scope="module")
def photo(spark):
    rng = np.random.default_rng(4)
    arrays = [rng.integers(0, 256, (h, w, c)).astype(float) for h, w, c in ((5, 7, 3), (9, 4, 1), (12, 13, 2), (1, 1, 1))]
    rows = [(i, *a.shape, a.ravel().tolist()) for i, a in enumerate(arrays)]
    return arrays, spark.createDataFrame(rows, "id int, h int, w int, c int, data array<double>")


@pytest.mark.parametrize("kind", ["nearest", "box", "linear", "cubic"])
@pytest.mark.parametrize("edge", ["cut", "mirror"])
def test_resize_equals_dense_matrices(photo, kind, edge):
    arrays, df = photo
    for out_h, out_w in ((6, 11), (3, 2)):
        for r in images.resize(df, "id", out_h, out_w, kind, edge).collect():
            x = arrays[r.id]
            want = np.einsum("ih,hwc,jw->ijc", dense(x.shape[0], out_h, kind, edge), x, dense(x.shape[1], out_w, kind, edge))
            assert (r.h, r.w, r.c) == want.shape and np.abs(np.array(r.data) - want.ravel()).max() < 1e-9


def test_sizes_from_columns(photo):
    arrays, df = photo
    rows = images.resize(df, "id", F.col("h") * 2, F.col("w") + 1, "linear").collect()
    assert {r.id: (r.h, r.w) for r in rows} == {i: (2 * a.shape[0], a.shape[1] + 1) for i, a in enumerate(arrays)}


def test_blur_mirrors_its_edges(photo):
    arrays, df = photo
    line = np.array(rasters.gaussian(5, 1.1))
    soft = rasters.blurred(F.col("data"), F.col("h"), F.col("w"), F.col("c"), line.tolist())
    for r in df.withColumn("soft", soft).collect():
        x = arrays[r.id]
        if min(x.shape[:2]) >= 2:
            p = np.pad(x, [(2, 2), (2, 2), (0, 0)], "symmetric")
            want = sum(line[i] * line[j] * p[i : i + x.shape[0], j : j + x.shape[1]] for i in range(5) for j in range(5))
            assert np.abs(np.array(r.soft) - want.ravel()).max() < 1e-9


def test_similarity(spark):
    rng = np.random.default_rng(5)
    a, b = (rng.integers(0, 256, (14, 13, 2)).astype(float) for _ in range(2))
    k = np.array(rasters.gaussian(11, 1.5))
    local = lambda x: sum(k[i] * k[j] * x[i : i + 4, j : j + 3] for i in range(11) for j in range(11))
    ma, mb = local(a), local(b)
    va, vb, both = local(a * a) - ma**2, local(b * b) - mb**2, local(a * b) - ma * mb
    want = ((2 * ma * mb + 6.5025) * (2 * both + 58.5225) / ((ma**2 + mb**2 + 6.5025) * (va + vb + 58.5225))).mean()
    rows = [(1, 14, 13, 2, a.ravel().tolist(), b.ravel().tolist()), (2, 5, 5, 1, [1.0] * 25, [1.0] * 25)]
    df = spark.createDataFrame(rows, "id int, h int, w int, c int, data array<double>, ref array<double>")
    got = {r.id: r.ssim for r in images.ssim(df, "id").collect()}
    assert got[1] == pytest.approx(want, abs=1e-10) and got[2] is None
    inner = {r.id: r.ssim for r in images.ssim(df, "id", border=1).collect()}
    assert inner[1] is not None and inner[1] != pytest.approx(want, abs=1e-6)


def test_square_crop_equals_padding(spark):
    x = np.arange(9 * 6 * 2, dtype=float).reshape(9, 6, 2)
    boxes = [(0, 0, 6, 4), (-3, 2, 1, 5), (4, 7, 9, 12), (2, 2, 3, 3), (0, 0, 20, 20), (1.5, 2.25, 4, 8)]
    rows = [(i, 9, 6, 2, x.ravel().tolist(), [float(v) for v in b]) for i, b in enumerate(boxes)]
    df = spark.createDataFrame(rows, "id int, h int, w int, c int, data array<double>, b array<double>")
    for ratio in (1.0, 1.7):
        for r in images.square_crop_around(df, "id", "b", ratio).collect():
            left, top, right, bottom = np.clip(boxes[r.id], 0, 9)
            side = max(2, int(ratio * max(right - left, bottom - top)))
            p = np.pad(x, [(40, 40), (40, 40), (0, 0)], "reflect")
            x0, y0 = (int((lo + hi) / 2 + 40 - side / 2) for lo, hi in ((left, right), (top, bottom)))
            assert r.h == r.w == side and r.data == p[y0 : y0 + side, x0 : x0 + side].ravel().tolist()


def test_warp_equals_direct_sampling(spark):
    rng = np.random.default_rng(6)
    x = rng.random((6, 5, 2))
    matrices = [[1.0, 0, 0, 0, 1, 0], [0.8, -0.3, 1.2, 0.4, 1.1, -0.7], [2.0, 0, -3, 0, 0.5, 1], [1.0, 2, 0, 2, 4, 0]]
    rows = [(i, 6, 5, 2, x.ravel().tolist(), [float(v) for v in m]) for i, m in enumerate(matrices)]
    df = spark.createDataFrame(rows, "id int, h int, w int, c int, data array<double>, m array<double>")
    for r in images.warp(df, "id", "m", 7, 4).collect():
        a, b, tx, c, d, ty = matrices[r.id]
        if a * d == b * c:
            assert r.data is None
            continue
        back, want = np.linalg.inv([[a, b], [c, d]]), np.zeros((7, 4, 2))
        for y in range(7):
            for col in range(4):
                sx, sy = back @ [col - tx, y - ty]
                x0, y0 = int(np.floor(sx)), int(np.floor(sy))
                for yy, wy in ((y0, 1 - (sy - y0)), (y0 + 1, sy - y0)):
                    for xx, wx in ((x0, 1 - (sx - x0)), (x0 + 1, sx - x0)):
                        if 0 <= yy < 6 and 0 <= xx < 5:
                            want[y, col] += wy * wx * x[yy, xx]
        assert np.abs(np.array(r.data) - want.ravel()).max() < 1e-9


@pytest.mark.parametrize(("up", "down"), [(1, 1), (3, 1), (1, 2)])
def test_stitch_equals_accumulation(spark, up, down):
    rng = np.random.default_rng(7)
    height, width, kernel, stride, channels = 8, 10, 4, 2, 3
    rows, cols = (height - kernel) // stride + 1, (width - kernel) // stride + 1
    size, step = kernel * up // down, stride * up // down
    data = rng.random((rows * cols, size, size, channels))
    total, weight = np.zeros((height * up // down, width * up // down, channels)), np.zeros((height * up // down, width * up // down, 1))
    edge = lambda i, j, n, m: min(max(min(i / (n - 1), j / (m - 1), 1 - i / (n - 1), 1 - j / (m - 1)), 0.01), 0.5)
    for p in range(rows * cols):
        for i in range(size):
            for j in range(size):
                g = edge(i, j, size, size) * edge(p // cols, p % cols, rows, cols)
                total[p // cols * step + i, p % cols * step + j] += g * data[p, i, j]
                weight[p // cols * step + i, p % cols * step + j] += g
    table = [(1, p, data[p].ravel().tolist()) for p in rng.permutation(rows * cols).tolist()]
    parts = spark.createDataFrame(table, "id int, patch int, data array<double>")
    r = images.stitched(parts, "id", height, width, kernel, stride, channels=channels, up=up, down=down).first()
    assert (r.h, r.w, r.c) == total.shape and np.abs(np.array(r.data) - (total / weight).ravel()).max() < 1e-9


def test_label_runs(spark):
    rows = [(1, [3, 3, 0, 0, 0, 7]), (2, []), (3, [None, 1])]
    df = spark.createDataFrame(rows, "id int, l array<int>").withColumn("r", rasters.label_runs(F.col("l")))
    got = {x.id: x for x in df.withColumn("hot", rasters.runs_one_hot(F.col("r"), 4)).collect()}
    assert [tuple(v) for v in got[1].r] == [(3, 0, 2), (0, 2, 3), (7, 5, 1)] and got[2].r == []
    assert got[1].hot == [0, 0, 0, 1] * 2 + [1, 0, 0, 0] * 3 + [0] * 4 and got[3].hot == [0] * 4 + [0, 1, 0, 0]
