"""Pixel work on array rows: resampling, filtering, folding and gathering as Column expressions.

A raster is an ``array<double>`` of ``h * w * c`` values, channel last.  A one-dimensional filter is
a table of taps: for each place of the output an array of (place in the input, weight).  A filter
along both axes is two passes, whole rows first.  Tables and rasters are bound once per row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomframe.functions.arrays import bind

Number = int | Column


def _c(value: Number | str) -> Column:
    return F.col(value) if isinstance(value, str) else value if isinstance(value, Column) else F.lit(value)


# --- places beyond the edges -------------------------------------------------


def mirrored(at: Column, n: Number) -> Column:
    """Place of ``at`` on an axis mirrored behind its edges, which stand twice: 1 0 | 0 1 2 | 2 1."""
    n = _c(n)
    turn = F.pmod(at, n * 2)
    return F.when(turn >= n, n * 2 - 1 - turn).otherwise(turn).cast("int")


def reflected(at: Column, n: Number) -> Column:
    """Place of ``at`` on an axis mirrored at its edges, which stand once: 2 1 | 0 1 2 | 1 0."""
    n = _c(n)
    turn = F.pmod(at, F.greatest(n * 2 - 2, F.lit(1)))
    return F.when(turn >= n, n * 2 - 2 - turn).otherwise(turn).cast("int")


# --- tables of taps ----------------------------------------------------------


def _box(d: Column) -> Column:
    return ((d > -0.5) & (d <= 0.5)).cast("double")


def _linear(d: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(d))


def _cubic(d: Column) -> Column:
    d = F.abs(d)
    near = (d * 1.5 - 2.5) * d * d + 1.0
    far = ((d * -0.5 + 2.5) * d - 4.0) * d + 2.0
    return F.when(d <= 1, near).when(d < 2, far).otherwise(0.0)


#: Filter and its radius at scale one.
FILTERS: dict[str, tuple[Callable[[Column], Column], float]] = {"box": (_box, 0.5), "linear": (_linear, 1.0), "cubic": (_cubic, 2.0)}


def _tap(at: Column, weight: Column) -> Column:
    return F.struct(at.cast("int").alias("at"), weight.cast("double").alias("w"))


def _even(taps: Column) -> Column:
    """Weights that add up to one."""
    whole = F.aggregate(taps, F.lit(0.0), lambda acc, t: acc + t["w"])
    return bind(whole, lambda s: F.transform(taps, lambda t: _tap(t["at"], t["w"] / s)))


def resize_taps(n_in: Number, n_out: Number, kind: str = "cubic", edge: str = "cut") -> Column:
    """Taps of an antialiased resize of one axis: enlarging interpolates, shrinking widens the filter.

    ``edge`` "cut" drops what lies beyond the axis and evens out the rest; "mirror" folds it back.
    """
    n_in, n_out = _c(n_in), _c(n_out)
    places = F.sequence(F.lit(0), n_out - 1)
    if kind == "nearest":
        return F.transform(places, lambda o: F.array(_tap(F.least(F.floor((o + 0.5) * n_in / n_out), n_in - 1), F.lit(1.0))))
    shape, radius = FILTERS[kind]
    stretch = F.greatest(F.lit(1.0), n_in / n_out)
    reach = (F.ceil(stretch * radius) + 1).cast("int")

    def taps(o: Column) -> Column:
        centre = (o + 0.5) * n_in / n_out - 0.5

        def near(mid: Column) -> Column:
            around = F.sequence((F.floor(mid) - reach).cast("int"), (F.floor(mid) + reach).cast("int"))
            some = F.transform(around, lambda at: _tap(at, shape((mid - at) / stretch)))
            if edge == "cut":
                return F.filter(some, lambda t: (t["w"] != 0) & (t["at"] >= 0) & (t["at"] < n_in))
            some = F.filter(some, lambda t: t["w"] != 0)
            return F.transform(some, lambda t: _tap(mirrored(t["at"], n_in), t["w"]))

        return bind(bind(centre, near), _even)

    return F.transform(places, taps)


def gaussian(size: int, sigma: float) -> list[float]:
    """Weights of a Gaussian of ``size`` places, adding up to one."""
    line = [math.exp(-0.5 * ((k - (size - 1) / 2) / sigma) ** 2) for k in range(size)]
    return [v / math.fsum(line) for v in line]


def kernel_taps(n: Number, weights: list[float], edge: str = "mirror") -> Column:
    """Taps of a filter of fixed weights: "valid" stays inside, "mirror" keeps the size."""
    n, table, size = _c(n), F.lit(weights), len(weights)
    if edge == "valid":
        places = F.when(n >= size, F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda o: F.transform(table, lambda w, k: _tap(o + k, w)))
    return F.transform(
        F.sequence(F.lit(0), n - 1), lambda o: F.transform(table, lambda w, k: _tap(mirrored(o + k - size // 2, n), w))
    )


# --- passes ------------------------------------------------------------------


def filtered(data: Column, w: Number, c: Number, down: Column, across: Column) -> Column:
    """``data`` under the taps ``down`` (of its rows) and ``across`` (of its columns)."""
    w, c = _c(w), _c(c)
    row = w * c

    def both(d: Column, rows: Column, columns: Column) -> Column:
        def whole_row(taps: Column) -> Column:
            return F.aggregate(
                taps, F.array_repeat(F.lit(0.0), row),
                lambda acc, t: F.zip_with(acc, F.slice(d, t["at"] * row + 1, row), lambda a, v: a + t["w"] * v),
            )

        def along(line: Column) -> Column:
            return F.flatten(F.transform(columns, lambda taps: F.transform(
                F.sequence(F.lit(0), c - 1),
                lambda k: F.aggregate(taps, F.lit(0.0), lambda acc, t: acc + t["w"] * F.get(line, t["at"] * c + k)),
            )))

        return F.flatten(F.transform(rows, lambda taps: bind(whole_row(taps), along)))

    return bind(data, lambda d: bind(down, lambda rows: bind(across, lambda columns: both(d, rows, columns))))


def resized(data: Column, h: Number, w: Number, c: Number, out_h: Number, out_w: Number, kind: str = "cubic", edge: str = "cut") -> Column:
    """``data`` resampled to ``out_h`` x ``out_w``."""
    return filtered(data, w, c, resize_taps(h, out_h, kind, edge), resize_taps(w, out_w, kind, edge))


def blurred(data: Column, h: Number, w: Number, c: Number, weights: list[float], edge: str = "mirror") -> Column:
    """``data`` under a separable kernel, the same along both axes."""
    return filtered(data, w, c, kernel_taps(h, weights, edge), kernel_taps(w, weights, edge))


def gathered(data: Column, w: Number, c: Number, rows: Column, columns: Column) -> Column:
    """The pixels at every row of ``rows`` and column of ``columns``; nothing beside them is made."""
    w, c = _c(w), _c(c)

    def pick(d: Column, across: Column) -> Column:
        return F.flatten(F.transform(rows, lambda y: F.flatten(F.transform(across, lambda x: F.slice(d, (y * w + x) * c + 1, c)))))

    return bind(data, lambda d: bind(columns, lambda across: pick(d, across)))


def warped(data: Column, h: Number, w: Number, c: Number, matrix: Column, out_h: int, out_w: int) -> Column:
    """``data`` under a forward 2x3 matrix (row-major), bilinear, zero beyond the raster.

    Each output place is taken back by the inverse and gathers its four neighbours.  A matrix that
    can't be inverted gives null.
    """
    h, w, c = _c(h), _c(w), _c(c)

    def neighbours(d: Column, m: Column, y: Column, x: Column) -> Column:
        det = m[0] * m[4] - m[1] * m[3]
        dx, dy = x - m[2], y - m[5]
        source = F.struct(((m[4] * dx - m[1] * dy) / det).alias("x"), ((m[0] * dy - m[3] * dx) / det).alias("y"))

        def around(s: Column) -> Column:
            x0, y0 = F.floor(s["x"]).cast("int"), F.floor(s["y"]).cast("int")
            fx, fy = s["x"] - x0, s["y"] - y0

            def one(yy: Column, xx: Column, weight: Column, k: Column) -> Column:
                inside = (yy >= 0) & (yy < h) & (xx >= 0) & (xx < w)
                return F.when(inside, weight * F.get(d, (yy * w + xx) * c + k)).otherwise(0.0)

            return F.transform(
                F.sequence(F.lit(0), c - 1),
                lambda k: (one(y0, x0, (1 - fy) * (1 - fx), k) + one(y0, x0 + 1, (1 - fy) * fx, k))
                + (one(y0 + 1, x0, fy * (1 - fx), k) + one(y0 + 1, x0 + 1, fy * fx, k)),
            )

        return bind(source, around)

    def whole(d: Column, m: Column) -> Column:
        ys, xs = F.sequence(F.lit(0), F.lit(out_h - 1)), F.sequence(F.lit(0), F.lit(out_w - 1))
        return F.flatten(F.transform(ys, lambda y: F.flatten(F.transform(xs, lambda x: neighbours(d, m, y, x)))))

    turns = matrix[0] * matrix[4] - matrix[1] * matrix[3]
    return F.when(turns != 0, bind(data, lambda d: bind(matrix, lambda m: whole(d, m))))


def as_bytes(data: Column) -> Column:
    """Values rounded to whole numbers of 0 to 255, halves to even."""
    return F.transform(data, lambda v: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.rint(v))))


# --- similarity --------------------------------------------------------------

# Window and constants of structural similarity on the 8-bit scale.
SSIM_SIZE, SSIM_SIGMA = 11, 1.5
SSIM_LIGHT, SSIM_CONTRAST = (0.01 * 255) ** 2, (0.03 * 255) ** 2


def structural_similarity(a: Column, b: Column, h: Number, w: Number, c: Number) -> Column:
    """Mean structural similarity of two rasters over all windows inside them; null if there are none.

    Local means, variances and the covariance come from five maps under one separable window.
    """
    window = gaussian(SSIM_SIZE, SSIM_SIGMA)
    local = lambda x: blurred(x, h, w, c, window, "valid")
    product = lambda x, y: F.zip_with(x, y, lambda p, q: p * q)
    maps = F.arrays_zip(
        local(a).alias("a"), local(b).alias("b"), local(product(a, a)).alias("aa"), local(product(b, b)).alias("bb"), local(product(a, b)).alias("ab")
    )

    def at(m: Column) -> Column:
        light = (m["a"] * m["b"] * 2 + SSIM_LIGHT) / (m["a"] * m["a"] + m["b"] * m["b"] + SSIM_LIGHT)
        shared, own = m["ab"] - m["a"] * m["b"], (m["aa"] - m["a"] * m["a"]) + (m["bb"] - m["b"] * m["b"])
        return light * (shared * 2 + SSIM_CONTRAST) / (own + SSIM_CONTRAST)

    return bind(maps, lambda x: F.when(F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda acc, m: acc + at(m)) / F.size(x)))


# --- label maps as runs ------------------------------------------------------


def label_runs(labels: Column) -> Column:
    """(class, start, length) of each run of equal labels."""
    def runs(a: Column) -> Column:
        last = F.size(a) - 1
        starts = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: (i == 0) | ~F.get(a, i).eqNullSafe(F.get(a, i - 1)))
        return bind(starts, lambda s: F.transform(s, lambda i, k: F.struct(
            F.get(a, i).alias("class"), i.alias("start"), (F.coalesce(F.get(s, k + 1), last + 1) - i).alias("length")
        )))

    empty = F.array().cast("array<struct<class:int,start:int,length:int>>")
    return bind(labels.cast("array<int>"), lambda a: F.when(F.size(a) > 0, runs(a)).otherwise(empty))


def runs_one_hot(runs: Column, classes: int) -> Column:
    """The runs' labels one-hot, place by place; a label outside the classes has no one."""
    places = F.sequence(F.lit(0), F.lit(classes - 1))
    return F.flatten(F.transform(runs, lambda r: F.flatten(F.array_repeat(
        F.transform(places, lambda k: F.coalesce(k == r["class"], F.lit(False)).cast("int")), r["length"]
    ))))
