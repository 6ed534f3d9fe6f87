"""Per-row error, likelihood and ranking scores over arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomframe.functions.arrays import bind, mean, total


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def mean_abs_error(a, b) -> Column:
    return mean(F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x - y)))


def mean_square_error(a, b) -> Column:
    return mean(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)))


def top_indices(v, k: int) -> Column:
    """Positions (0-based) of the k largest values, the first one on ties."""
    ranked = F.array_sort(F.transform(_c(v), lambda x, i: F.struct((-x).alias("v"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: s["i"])


def arg_max(v) -> Column:
    return (F.array_position(_c(v), F.array_max(_c(v))) - 1).cast("int")


def arg_min(v) -> Column:
    return (F.array_position(_c(v), F.array_min(_c(v))) - 1).cast("int")


def hit_at(v, label, k: int) -> Column:
    return F.array_contains(top_indices(v, k), _c(label).cast("int")).cast("int")


def cross_entropy(logits, label) -> Column:
    logits = _c(logits)
    log_sum = bind(
        F.struct(logits.alias("v"), F.array_max(logits).alias("top")),
        lambda r: r["top"] + F.log(total(F.transform(r["v"], lambda x: F.exp(x - r["top"])))),
    )
    return log_sum - F.get(logits, _c(label).cast("int"))


def binary_cross_entropy(logits, targets) -> Column:
    """Mean over elements, in the overflow-safe form."""
    return mean(
        F.zip_with(
            _c(logits),
            _c(targets),
            lambda x, t: F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x))),
        )
    )


def clamp_log_var(v) -> Column:
    return F.transform(_c(v), lambda x: F.least(F.greatest(x, F.lit(-30.0)), F.lit(20.0)))


def gaussian_parts(params) -> tuple[Column, Column]:
    """Mean and clamped log-variance halves of one parameter array."""
    params = _c(params)
    half = F.floor(F.size(params) / 2).cast("int")
    return F.slice(params, F.lit(1), half), clamp_log_var(F.slice(params, half + 1, half))


def gaussian_kl(mean1, log_var1, mean2=None, log_var2=None) -> Column:
    """KL divergence summed over elements, to the standard normal by default."""
    pair = F.arrays_zip(_c(mean1).alias("m"), _c(log_var1).alias("l"))
    if mean2 is None:
        terms = F.transform(pair, lambda p: p["m"] * p["m"] + F.exp(p["l"]) - 1.0 - p["l"])
    else:
        both = F.arrays_zip(
            _c(mean1).alias("m"), _c(log_var1).alias("l"),
            _c(mean2).alias("n"), _c(log_var2).alias("k"),
        )
        terms = F.transform(
            both,
            lambda p: (p["m"] - p["n"]) * (p["m"] - p["n"]) / F.exp(p["k"])
            + F.exp(p["l"] - p["k"]) - 1.0 - p["l"] + p["k"],
        )
    return total(terms) * 0.5


def gaussian_nll(sample, mean1, log_var1) -> Column:
    both = F.arrays_zip(_c(sample).alias("s"), _c(mean1).alias("m"), _c(log_var1).alias("l"))
    return 0.5 * total(
        F.transform(
            both,
            lambda p: math.log(2.0 * math.pi)
            + p["l"]
            + (p["s"] - p["m"]) * (p["s"] - p["m"]) / F.exp(p["l"]),
        )
    )


def bits(nats) -> Column:
    return _c(nats) / math.log(2.0)


def psnr(mse, top: float = 255.0) -> Column:
    """Peak signal-to-noise ratio in dB, infinite for equal images."""
    mse = _c(mse)
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(
        F.lit(20.0) * F.log10(F.lit(top) / F.sqrt(mse))
    )


def interior(v, height: int, width: int, border: int) -> Column:
    """A raster without its border."""
    rows = F.sequence(F.lit(border), F.lit(height - border - 1))
    return bind(
        _c(v),
        lambda a: F.flatten(
            F.transform(rows, lambda r: F.slice(a, r * width + border + 1, width - 2 * border))
        ),
    )


def hinge(v, sign: int) -> Column:
    """Mean of ``max(0, 1 + sign * x)``; sign -1 for real, +1 for fake logits."""
    return mean(F.transform(_c(v), lambda x: F.greatest(F.lit(0.0), F.lit(1.0) + sign * x)))


def softplus(v, sign: int) -> Column:
    return mean(
        F.transform(
            _c(v),
            lambda x: F.greatest(sign * x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))),
        )
    )
