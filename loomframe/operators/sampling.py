"""Exact, repeatable shuffles, splits and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.functions import seeded
from loomframe.operators.ordering import ROWS_PER_TASK, numbered


def shuffled(
    df: DataFrame, key: str, seed: int, into: str = "rank", rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Position of every row in a seeded random order."""
    mixed = df.withColumn("__d", seeded.digest(seed, key))
    return numbered(mixed, ["__d", key], into, rows_per_task=rows_per_task).drop("__d")


def exact_split(
    df: DataFrame, key: str, seed: int, counts: Sequence[tuple[str, int]],
    rest: str = "train", into: str = "split", rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Random split with exact sizes; rows beyond the named counts go to ``rest``."""
    ranked = shuffled(df, key, seed, "__rank", rows_per_task)
    # Names are assigned from the lowest ranks on.
    edges, low = [], 0
    for name, n in counts:
        edges.append((name, low, low + n))
        low += n
    label = F.lit(rest)
    for name, a, b in edges:
        label = F.when((F.col("__rank") >= a) & (F.col("__rank") < b), name).otherwise(label)
    return ranked.withColumn(into, label).drop("__rank")


def ratio_split(df: DataFrame, key: str, seed: int, ratio: float, **kw) -> DataFrame:
    """Train and test parts with exactly ``int(ratio * n)`` training rows."""
    train = int(ratio * df.count())
    return exact_split(df, key, seed, [("train", train)], rest="test", **kw)


def sample_exact(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """Exactly ``n`` random rows (all, if there are fewer), the same ones on every run."""
    ranked = shuffled(df, key, seed, "__rank")
    return ranked.filter(F.col("__rank") < n).drop("__rank")


def sample_fraction(df: DataFrame, key: str, seed: int, fraction: float) -> DataFrame:
    return df.filter(seeded.uniform(seed, key) < fraction)


def every_nth(
    df: DataFrame, order: Sequence[str], parts: int = 50, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Every ``max(1, n // parts)``-th row in order."""
    step = max(1, df.count() // parts)
    placed = numbered(df, order, "__n", rows_per_task=rows_per_task)
    return placed.filter(F.col("__n") % step == 0).drop("__n")


def head_then_stride(df: DataFrame, order: Sequence[str], head: int, window: int, step: int):
    """First ``head`` rows with a flag for every ``step``-th of the first ``window``."""
    first = df.orderBy(*order).limit(head)
    placed = numbered(first, order, "row_no")
    return placed.withColumn(
        "strided", ((F.col("row_no") < window) & (F.col("row_no") % step == 0)).cast("long")
    )


def one_per_group(df: DataFrame, group: Sequence[str], key: str, seed: int) -> DataFrame:
    """One random row per group, by map-side combined aggregation."""
    ids = [F.col(g) for g in group] + [F.col(key)]
    rest = [c for c in df.columns if c not in group]
    picked = F.min_by(F.struct(*rest), F.struct(seeded.digest(seed, *ids), F.col(key)))
    return df.groupBy(*group).agg(picked.alias("__row")).select(*group, "__row.*")


def paired_in_batch(
    df: DataFrame, batch: str, key: str, seed: int, partner_columns: Sequence[str],
) -> DataFrame:
    """Pair every row of a batch with another by a seeded permutation of the batch.

    Batches have a fixed size, so the two rankings inside a batch are bounded.
    """
    from pyspark.sql import Window

    by_key = Window.partitionBy(batch).orderBy(key)
    by_hash = Window.partitionBy(batch).orderBy(seeded.digest(seed, key), F.col(key))
    left = df.withColumn("__slot", F.row_number().over(by_key))
    right = df.select(
        batch,
        F.row_number().over(by_hash).alias("__slot"),
        *[F.col(c).alias(f"ref_{c}") for c in partner_columns],
    )
    return left.join(right, [batch, "__slot"]).drop("__slot")
