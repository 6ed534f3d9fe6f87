"""Noise schedules as small step tables, and their use on vector tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomframe.functions import seeded


# The default ends of the schedules.
def betas(kind: str, steps: int, start: float = 1e-4, end: float = 2e-2, s: float = 8e-3) -> Column:
    """Beta of step ``t``.  ``linear`` is linear in the square root."""
    t = F.col("t").cast("double")
    last = F.lit(float(steps - 1))
    if kind == "linear":
        root = F.lit(start**0.5) + (F.lit(end**0.5) - F.lit(start**0.5)) * t / last
        return root * root
    if kind == "sqrt_linear":
        return F.lit(start) + F.lit(end - start) * t / last
    if kind == "sqrt":
        return F.sqrt(F.lit(start) + F.lit(end - start) * t / last)
    if kind == "cosine":

        def bar(at: Column) -> Column:
            c = F.cos((at / float(steps) + s) / (1 + s) * math.pi / 2)
            return c * c

        return F.greatest(F.least(1.0 - bar(t + 1.0) / bar(t), F.lit(0.999)), F.lit(0.0))
    raise ValueError(f"unknown schedule {kind!r}")


def betas_of(alpha_bar, steps: int, max_beta: float = 0.999) -> Column:
    """Betas that discretise ``alpha_bar``, a function of a Column in [0, 1]."""
    t = F.col("t").cast("double") / float(steps)
    return F.least(1.0 - alpha_bar(t + 1.0 / steps) / alpha_bar(t), F.lit(max_beta))


def schedule(spark: SparkSession, steps: int, beta: Column, v: float = 0.0, kind: str = "eps"):
    """Schedule table: one row per step with cumulative and posterior terms.

    The table has ``steps`` rows, a parameter, so its ordered window is bounded.
    """
    by_step = Window.partitionBy(F.lit(0)).orderBy("t")
    upto = by_step.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = spark.range(steps).withColumnRenamed("id", "t").withColumn("beta", beta)
    bar = base.withColumn("alpha", 1.0 - F.col("beta")).withColumn(
        "alpha_bar", F.product("alpha").over(upto)
    )
    a, prev = F.col("alpha_bar"), F.col("alpha_bar_prev")
    terms = bar.withColumn("alpha_bar_prev", F.lag("alpha_bar", 1, 1.0).over(by_step)).withColumns(
        {
            "sqrt_alpha_bar": F.sqrt(a),
            "sqrt_one_minus": F.sqrt(1.0 - a),
            "log_one_minus": F.log(1.0 - a),
            "sqrt_recip": F.sqrt(1.0 / a),
            "sqrt_recip_minus_one": F.sqrt(1.0 / a - 1.0),
            "posterior_variance": (1.0 - v) * F.col("beta") * (1.0 - prev) / (1.0 - a)
            + v * F.col("beta"),
            "posterior_coef1": F.col("beta") * F.sqrt(prev) / (1.0 - a),
            "posterior_coef2": (1.0 - prev) * F.sqrt("alpha") / (1.0 - a),
        }
    )
    terms = terms.withColumn(
        "posterior_log_variance", F.log(F.greatest("posterior_variance", F.lit(1e-20)))
    )
    if kind == "eps":
        weight = F.when(
            F.col("posterior_variance") > 0,
            F.col("beta") ** 2
            / (2.0 * F.col("posterior_variance") * F.col("alpha") * (1.0 - a)),
        )
    else:
        weight = 0.5 * F.sqrt(a) / (2.0 - a)
    # The first weight is a copy of the second.
    return terms.withColumn("weight", weight).withColumn(
        "weight",
        F.when(F.col("t") == 0, F.lead("weight").over(by_step)).otherwise(F.col("weight")),
    )


def uniform_steps(steps: int, wanted: int) -> list[int]:
    return [t + 1 for t in range(0, steps, steps // wanted)]


def quadratic_steps(steps: int, wanted: int) -> list[int]:
    top = math.sqrt(steps * 0.8)
    return [int((top * i / (wanted - 1)) ** 2) + 1 for i in range(wanted)]


def subsampled(table: DataFrame, chosen: list[int], eta: float) -> DataFrame:
    """Chosen steps with their previous alpha-bar and sigma.

    The first previous value is the head of the full series.
    """
    by_step = Window.partitionBy(F.lit(0)).orderBy("t")
    headed = table.select("t", "alpha_bar", F.first("alpha_bar").over(by_step).alias("__head"))
    steps = headed.filter(F.col("t").isin(chosen))
    prev = F.coalesce(F.lag("alpha_bar").over(by_step), F.col("__head"))
    a, p = F.col("alpha_bar"), F.col("alpha_bar_prev")
    return (
        steps.withColumn("alpha_bar_prev", prev)
        .withColumn("sigma", eta * F.sqrt((1.0 - p) / (1.0 - a) * (1.0 - a / p)))
        .drop("__head")
    )


def at_step(df: DataFrame, table: DataFrame, step: str = "t") -> DataFrame:
    """Rows with the schedule terms of their step.

    The table has one row per step, a parameter of a few thousand at most.
    """
    return df.join(F.broadcast(table), step)


def random_step(key: str, steps: int, seed: int) -> Column:
    return seeded.uniform_int(seed, steps, key)


def noised(x: Column, noise: Column) -> Column:
    """Forward noising with the terms of :func:`at_step`."""
    a, b = F.col("sqrt_alpha_bar"), F.col("sqrt_one_minus")
    return F.zip_with(x, noise, lambda v, e: a * v + b * e)


def denoised(x_t: Column, noise: Column) -> Column:
    """Clean vector from a noised one and its noise."""
    a, b = F.col("sqrt_recip"), F.col("sqrt_recip_minus_one")
    return F.zip_with(x_t, noise, lambda v, e: a * v - b * e)


def implied_noise(x_t: Column, x: Column) -> Column:
    a, b = F.col("sqrt_recip"), F.col("sqrt_recip_minus_one")
    return F.zip_with(x_t, x, lambda v, c: (a * v - c) / b)


def noise_vector(key, length: int, seed: int) -> Column:
    """Standard normal vector of a row, drawn per element."""
    key = F.col(key) if isinstance(key, str) else key
    return F.transform(
        F.sequence(F.lit(0), F.lit(length - 1)), lambda i: seeded.normal(seed, key, i)
    )
