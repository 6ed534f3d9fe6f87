"""Metric aggregates over prediction, loss and vector tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.operators.vectors import summed


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def masked_mean(loss, valid) -> Column:
    """Valid losses summed, divided by all rows."""
    return F.sum(_c(loss) * _c(valid)) / F.count(F.lit(1))


def weighted_mean(value, weight) -> Column:
    return F.sum(_c(value) * _c(weight)) / F.sum(_c(weight))


def text_length_stats(text) -> list[Column]:
    size = F.length(_c(text))
    return [
        F.min(size).cast("long").alias("min_length"),
        F.max(size).cast("long").alias("max_length"),
        F.avg(size).alias("mean_length"),
    ]


def scale_factor(df: DataFrame, vector: str) -> DataFrame:
    """Reciprocal of the sample deviation over all elements of all vectors.

    Deviations of the positions are joined by their means: one row per position.
    """
    flat = summed(df, [], vector, "mean", "variance").select(
        "count", F.explode(F.arrays_zip("mean", "variance")).alias("p")
    )
    inner = F.sum(F.col("p.variance") * (F.col("count") - 1))
    parts = flat.agg(
        inner.alias("inner"), F.var_pop("p.mean").alias("between"),
        F.first("count").alias("rows"), F.count(F.lit(1)).alias("width"),
    )
    total = F.col("rows") * F.col("width")
    std = F.sqrt((F.col("inner") + total * F.col("between")) / F.nullif(total - 1, F.lit(0)))
    return parts.select(std.alias("std"), (1.0 / std).alias("scale_factor"))


def channel_stats(df: DataFrame, vector: str, eps: float = 1e-6) -> DataFrame:
    """Mean, deviation and normaliser of every vector position."""
    both = summed(df, [], vector, "mean", "std").select(
        F.posexplode(F.arrays_zip("mean", "std")).alias("pos", "p")
    )
    return both.select(
        "pos", F.col("p.mean").alias("mean"), F.col("p.std").alias("std"),
        (1.0 / (F.col("p.std") + eps)).alias("scale"),
    )


def parameter_stats(df: DataFrame, name: str, value: str) -> DataFrame:
    return df.groupBy(name).agg(
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.count(F.lit(1)).alias("n"),
    )


def audit(before: DataFrame, after: DataFrame, shard: str) -> DataFrame:
    """Rows per shard before and after a step."""
    b = before.groupBy(shard).agg(F.count(F.lit(1)).alias("before"))
    a = after.groupBy(shard).agg(F.count(F.lit(1)).alias("after"))
    return b.join(a, shard, "left").withColumn("after", F.coalesce("after", F.lit(0)))


def yield_by_shard(df: DataFrame, shard: list[str], kept: Column) -> DataFrame:
    """Rows per shard before and after a filter, in one pass."""
    return df.groupBy(*shard).agg(
        F.count(F.lit(1)).alias("before"), F.count(F.when(kept, 1)).alias("after")
    )


def observed(df: DataFrame, name: str, kept: Column):
    """Attach row counters that cost no extra pass; read them after the action."""
    from pyspark.sql import Observation

    counter = Observation(name)
    counted = df.observe(
        counter, F.count(F.lit(1)).alias("before"), F.count(F.when(kept, 1)).alias("after")
    )
    return counted, counter
