"""Array functions for pixel rows, vectors, token sequences and logits."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.functions import seeded


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bind(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once per row.

    A column expression used inside a lambda is otherwise computed again for
    every element, which makes row statistics quadratic in the array length.
    """
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def doubles(v) -> Column:
    return _c(v).cast("array<double>")


def total(v) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x)


def mean(v) -> Column:
    return total(v) / F.size(_c(v))


def literal(values: Sequence[float]) -> Column:
    return F.lit([float(v) for v in values])


# --- pixel scaling -----------------------------------------------------------


def signed_unit(px) -> Column:
    return F.transform(_c(px), lambda x: x / F.lit(127.5) - 1.0)


def to_byte_scaled(v) -> Column:
    """``(x + 1) * 127.5`` clamped to [0, 255], truncated."""
    return F.transform(
        _c(v),
        lambda x: F.least(F.greatest((x + 1.0) * 127.5, F.lit(0.0)), F.lit(255.0)).cast("int"),
    )


def to_byte_unit(v) -> Column:
    """Clamp to [-1, 1], map to [0, 1], times 255, truncated."""
    return F.transform(
        _c(v),
        lambda x: (((F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0)) + 1.0) / 2.0) * 255.0).cast(
            "int"
        ),
    )


def unit_from_int(px, top: int = 255) -> Column:
    return F.transform(_c(px), lambda x: x / F.lit(float(top)))


def int_from_unit(v, top: int = 255) -> Column:
    return F.transform(
        _c(v),
        lambda x: F.rint(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * float(top)).cast("int"),
    )


def min_max(v, eps: float = 1e-12, signed: bool = False) -> Column:
    v = _c(v)
    low, high = F.array_min(v), F.array_max(v)

    def scale(r: Column) -> Column:
        width = r["high"] - r["low"] + F.lit(eps)
        return F.transform(
            r["v"],
            lambda x: (x - r["low"]) / width * 2.0 - 1.0 if signed else (x - r["low"]) / width,
        )

    return bind(F.struct(v.alias("v"), low.alias("low"), high.alias("high")), scale)


def channel_scale(v, means: Sequence[float], stds: Sequence[float]) -> Column:
    """Normalise interleaved channels by fixed means and deviations."""
    n, m, s = len(means), literal(means), literal(stds)
    return F.transform(_c(v), lambda x, i: (x - F.get(m, i % n)) / F.get(s, i % n))


def quantile_clip(v, q: float, floor: float = 1.0) -> Column:
    """Clip to the q-quantile of absolute values (at least ``floor``) and divide."""
    limit = F.greatest(abs_quantile(v, q), F.lit(float(floor)))
    return bind(
        F.struct(_c(v).alias("v"), limit.alias("s")),
        lambda r: F.transform(
            r["v"], lambda x: F.greatest(F.least(x, r["s"]), -r["s"]) / r["s"]
        ),
    )


def abs_quantile(v, q: float) -> Column:
    """Linearly interpolated quantile of the absolute values."""
    def pick(ordered: Column) -> Column:
        at = (F.size(ordered) - 1) * F.lit(float(q))
        low = F.floor(at)
        a = F.get(ordered, low.cast("int"))
        b = F.get(ordered, F.ceil(at).cast("int"))
        return a + (b - a) * (at - low)

    return bind(F.sort_array(F.transform(_c(v), F.abs)), pick)


# --- binary interchange ------------------------------------------------------


@F.pandas_udf(T.BinaryType())
def to_float_bytes(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else np.asarray(x, dtype="<f4").tobytes())


def from_float_bytes(column, length: int) -> Column:
    """Raw float32 bytes as an array; the length is the caller's contract."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def decode(raw: pd.Series) -> pd.Series:
        def one(b):
            if b is None:
                return None
            out = np.frombuffer(b, dtype="<f4")
            if out.size != length:
                raise ValueError(f"expected {length} floats, found {out.size}")
            return out

        return raw.map(one)

    return decode(_c(column))


def depth_from_bytes(column) -> Column:
    """Four bytes per value as float32, min-max scaled to [-1, 1]."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def decode(raw: pd.Series) -> pd.Series:
        return raw.map(
            lambda b: None if b is None else np.frombuffer(b, dtype="<f4").astype("f8")
        )

    return min_max(decode(_c(column)), signed=True)


# --- labels ------------------------------------------------------------------


def one_hot(label, classes: int) -> Column:
    label = _c(label)
    return F.transform(
        F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == label).cast("int")
    )


def shift_label(label) -> Column:
    """Next label in 8 bits: 255 wraps to 0."""
    return F.pmod(_c(label) + 1, F.lit(256))


def binarise(v, threshold: float = 0.5) -> Column:
    return F.transform(_c(v), lambda x: F.when(x < threshold, 0.0).otherwise(1.0))


def blend(mask, inside, outside) -> Column:
    """``mask * inside + (1 - mask) * outside`` per element."""
    both = F.arrays_zip(_c(mask).alias("m"), _c(inside).alias("a"), _c(outside).alias("b"))
    return F.transform(both, lambda z: z["m"] * z["a"] + (F.lit(1.0) - z["m"]) * z["b"])


# --- permutations ------------------------------------------------------------


def permutation(kind: str, height: int, width: int) -> list[int]:
    """Source index for every output position of a raster of ``height*width``."""
    cells = [(i, j) for i in range(height) for j in range(width)]
    square = height == width
    if kind.startswith("spiral") and not (square and height % 2 == 0):
        raise ValueError("a spiral needs an even square raster")
    if kind == "subsample" and not (square and height & (height - 1) == 0):
        raise ValueError("subsampling needs a square raster with a power of two as side")
    if kind == "identity":
        ordered = cells
    elif kind == "z_curve":
        ordered = sorted(cells, key=lambda c: morton_number(*c))
    elif kind == "boustrophedon":
        ordered = [(i, width - 1 - j if i % 2 else j) for i, j in cells]
    elif kind == "subsample":
        levels = int(math.log2(min(height, width)))
        ordered = sorted(cells, key=lambda c: _phases(c, levels))
    elif kind in ("spiral_out", "spiral_in"):
        ordered = _spiral(height)
        if kind == "spiral_in":
            ordered = ordered[::-1]
    elif kind == "random":
        # Fixed value: seed 1.
        return [int(k) for k in np.random.RandomState(1).permutation(height * width)]
    else:
        raise ValueError(f"unknown permutation {kind!r}")
    order = [i * width + j for i, j in ordered]
    if sorted(order) != list(range(height * width)):
        raise ValueError(f"{kind} is no permutation of {height} x {width}")
    return order


def inverse_permutation(order: Sequence[int]) -> list[int]:
    return [int(k) for k in np.argsort(np.asarray(order))]


def reorder(v, order: Sequence[int]) -> Column:
    places = F.split(F.lit(",".join(str(k) for k in order)), ",").cast("array<int>")
    return bind(_c(v), lambda a: F.transform(places, lambda i: F.get(a, i)))


def morton_number(i: int, j: int) -> int:
    code = 0
    for bit in range(32):
        code |= ((j >> bit) & 1) << (2 * bit)
        code |= ((i >> bit) & 1) << (2 * bit + 1)
    return code


def morton(i, j) -> Column:
    """Morton code of a cell: bits of ``i`` on odd, of ``j`` on even places.

    Bits are spread by doubling gaps, exact for 32-bit inputs.
    """
    return F.shiftleft(_spread(_c(i)), 1).bitwiseOR(_spread(_c(j)))


def _spread(v: Column) -> Column:
    v = v.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    # Masks of the classical bit-interleave.
    for shift, mask in (
        (16, 0x0000FFFF0000FFFF),
        (8, 0x00FF00FF00FF00FF),
        (4, 0x0F0F0F0F0F0F0F0F),
        (2, 0x3333333333333333),
        (1, 0x5555555555555555),
    ):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def _phases(cell: tuple[int, int], levels: int) -> tuple[int, ...]:
    """Sort key of repeated 2x2 subsampling: low bits of (i, j) come first."""
    i, j = cell
    key: list[int] = []
    for bit in range(levels):
        key += [(i >> bit) & 1, (j >> bit) & 1]
    return tuple(key) + (i >> levels, j >> levels)


def _spiral(size: int) -> list[tuple[int, int]]:
    """Square spiral from the centre: up, right, down, left, with growing legs."""
    at = (size // 2, size // 2 - 1)
    path = [at]
    headings = ((-1, 0), (0, 1), (1, 0), (0, -1))
    leg = 0
    while len(path) < size * size:
        di, dj = headings[leg % 4]
        for _ in range(leg // 2 + 1):
            at = (at[0] + di, at[1] + dj)
            path.append(at)
            if len(path) == size * size:
                break
        leg += 1
    return path


# --- quantised maps ----------------------------------------------------------


def quantise_levels(v, levels: int) -> Column:
    """[0, 1] values to level numbers, halves to even."""
    return F.transform(
        _c(v),
        lambda x: F.rint(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * float(levels)).cast(
            "int"
        ),
    )


def level_values(v, levels: int) -> Column:
    return F.transform(_c(v), lambda x: x / F.lit(float(levels)))


def block_repeat(v, height: int, width: int, factor: int) -> Column:
    """A raster enlarged by an integer factor: every value becomes a square of itself."""
    places = F.sequence(F.lit(0), F.lit(height * width * factor * factor - 1))
    wide = width * factor
    at = lambda k: F.floor(k / (wide * factor)) * width + F.floor(k % wide / factor)
    return bind(_c(v), lambda a: F.transform(places, lambda k: F.get(a, at(k).cast("int"))))


def block_mean(v, height: int, width: int, factor: int) -> Column:
    """Area pooling of a raster by an integer factor."""
    out_w = width // factor
    cells = F.sequence(F.lit(0), F.lit((height // factor) * out_w - 1))
    inner = F.sequence(F.lit(0), F.lit(factor * factor - 1))

    def one(v: Column, k: Column) -> Column:
        top, left = F.floor(k / out_w) * factor, (k % out_w) * factor
        picked = F.transform(
            inner,
            lambda e: F.get(
                v, ((top + F.floor(e / factor)) * width + left + e % factor).cast("int")
            ),
        )
        return mean(picked)

    return bind(_c(v), lambda a: F.transform(cells, lambda k: one(a, k)))


def strided_tokens(v, height: int, width: int, channels: int, stride: int) -> Column:
    """Raster (row, column, channel) as ``(h/stride * w/stride)`` tokens.

    A token gathers pixels a whole sub-grid apart (the split puts the stride on
    the outer index), features ordered by (row step, column step, channel).
    """
    h, w = height // stride, width // stride
    tokens = F.sequence(F.lit(0), F.lit(h * w - 1))
    feats = F.sequence(F.lit(0), F.lit(stride * stride * channels - 1))

    def one(v: Column, t: Column) -> Column:
        i, j = F.floor(t / w), t % w
        return F.transform(
            feats,
            lambda f: F.get(
                v,
                (
                    (
                        (F.floor(f / (stride * channels)) * h + i) * width
                        + (F.floor(f / channels) % stride) * w
                        + j
                    )
                    * channels
                    + f % channels
                ).cast("int"),
            ),
        )

    return bind(_c(v), lambda a: F.transform(tokens, lambda t: one(a, t)))


# --- logits and token noise --------------------------------------------------


def top_k_logits(v, k: int, temperature: float = 1.0) -> Column:
    """Temperature, then everything below the k-th value becomes null."""
    v = _c(v)
    scaled = F.transform(v, lambda x: x / F.lit(float(temperature)))
    cut = F.get(F.sort_array(scaled, False), F.lit(k - 1))
    return bind(
        F.struct(scaled.alias("v"), cut.alias("cut")),
        lambda r: F.transform(r["v"], lambda x: F.when(x >= r["cut"], x)),
    )


def softmax(v) -> Column:
    """Softmax in which null entries get probability zero."""
    v = _c(v)
    exps = bind(
        F.struct(v.alias("v"), F.array_max(v).alias("top")),
        lambda r: F.transform(r["v"], lambda x: F.coalesce(F.exp(x - r["top"]), F.lit(0.0))),
    )
    return bind(
        exps,
        lambda e: bind(
            F.struct(e.alias("e"), total(e).alias("sum")),
            lambda r: F.transform(r["e"], lambda x: x / r["sum"]),
        ),
    )


def keep_tokens(v, key, keep: float, vocabulary: int, seed: int) -> Column:
    """Keep each token with probability ``keep``, else draw a random token."""
    key = _c(key)
    return F.transform(
        _c(v),
        lambda x, i: F.when(seeded.uniform(seed, key, i) < keep, x.cast("long")).otherwise(
            seeded.uniform_int(seed + 1, vocabulary, key, i)
        ),
    )


def drop_condition(v, key, p: float, null_vector: Column, seed: int) -> Column:
    """Replace a row's vector with probability ``p`` (exact at 0 and 1)."""
    return F.when(seeded.uniform(seed, key) < F.lit(1.0 - p), _c(v)).otherwise(null_vector)


def guided(unconditional, conditional, scale: float) -> Column:
    return F.zip_with(
        _c(unconditional), _c(conditional), lambda u, c: u + F.lit(float(scale)) * (c - u)
    )


# --- vectors -----------------------------------------------------------------


def dot(a, b) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def l2_normalised(v, eps: float = 0.0) -> Column:
    v = _c(v)
    norm = F.sqrt(dot(v, v)) + F.lit(float(eps))
    return bind(
        F.struct(v.alias("v"), norm.alias("norm")),
        lambda r: F.transform(r["v"], lambda x: x / r["norm"]),
    )


def sinusoid(position, dim: int, max_period: float = 10000.0) -> Column:
    """Cosines then sines of geometric frequencies; a zero ends an odd size."""
    half = dim // 2
    position = _c(position).cast("double")

    def wave(fn):
        return F.transform(
            F.sequence(F.lit(0), F.lit(half - 1)),
            lambda i: fn(position * F.exp(F.lit(-math.log(max_period)) * i / F.lit(float(half)))),
        )

    parts = [wave(F.cos), wave(F.sin)]
    if dim % 2:
        parts.append(F.array(F.lit(0.0)))
    return F.concat(*parts)


# --- colour ------------------------------------------------------------------

# Studio-range YCbCr weights (rows R, G, B), their offsets, the
# inverse weights (rows Y, Cb, Cr) and offsets, and luma weights for gray.
YCC = ((65.481, -37.797, 112.0), (128.553, -74.203, -93.786), (24.966, 112.0, -18.214))
YCC_OFFSET = (16.0, 128.0, 128.0)
RGB = (
    (0.00456621, 0.00456621, 0.00456621),
    (0.0, -0.00153632, 0.00791071),
    (0.00625893, -0.00318811, 0.0),
)
RGB_OFFSET = (-222.921, 135.576, -276.836)
GRAY = (0.299, 0.587, 0.114)


def rgb_to_ycc(r, g, b) -> list[Column]:
    """8-bit RGB to unrounded Y, Cb, Cr on the 8-bit scale."""
    return [
        (_c(r) * YCC[0][k] + _c(g) * YCC[1][k] + _c(b) * YCC[2][k]) / 255.0 + YCC_OFFSET[k]
        for k in range(3)
    ]


def ycc_to_rgb(y, cb, cr) -> list[Column]:
    return [
        (_c(y) * RGB[0][k] + _c(cb) * RGB[1][k] + _c(cr) * RGB[2][k]) * 255.0 + RGB_OFFSET[k]
        for k in range(3)
    ]


def gray_value(r, g, b) -> Column:
    return _c(r) * GRAY[0] + _c(g) * GRAY[1] + _c(b) * GRAY[2]


def as_byte(v) -> Column:
    """Round half to even and store in 8 bits (out-of-range values wrap)."""
    return F.pmod(F.rint(_c(v)), F.lit(256.0)).cast("int")


def coordinate_map(height: int, width: int) -> Column:
    """Row-major cell numbers scaled to [0, 1]."""
    n = height * width
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i / F.lit(float(n)))
