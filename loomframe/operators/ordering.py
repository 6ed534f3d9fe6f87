"""Exact numbering and running totals that never sort a table in one task.

``row_number()`` over a whole table, or over one huge group, runs in one task.
Here a larger table is cut into key ranges of bounded size and stored once in the
shared folder with the number of each range, so that counting and numbering see
the same ranges.  The ranges decide only how even the work is, never the result.
Numbers are row numbers inside a range plus the rows of earlier ranges of the
same group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.session import materialise

ROWS_PER_TASK = 2_000_000
_PIECE = "__piece"
_SHIFT = "__shift"


def numbered(
    df: DataFrame,
    order: Sequence[str],
    into: str = "row_no",
    within: Sequence[str] = (),
    start: int = 0,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add the position of every row by ``order``, counted from ``start``.

    ``order`` must be ascending and unique inside a group of ``within``.
    """
    return running_total(
        df, order, F.lit(1), into, within, rows_per_task, offset=start - 1
    )


def running_total(
    df: DataFrame,
    order: Sequence[str],
    value: Column,
    into: str = "running",
    within: Sequence[str] = (),
    rows_per_task: int = ROWS_PER_TASK,
    offset: int = 0,
) -> DataFrame:
    """Add the inclusive running total of an integer ``value`` by ``order``."""
    within, keys = list(within), [*within, *order]
    pieces = -(-df.count() // rows_per_task)
    if pieces <= 1:
        group = [F.col(c) for c in within] or [F.lit(0)]
        window = Window.partitionBy(*group).orderBy(*order)
        return df.withColumn(into, _within_piece(value, window) + F.lit(offset).cast("long"))

    ranges = df.repartitionByRange(pieces, *keys).withColumn(_PIECE, F.spark_partition_id())
    pieced = materialise(ranges, "ranges")
    window = Window.partitionBy(*within, _PIECE).orderBy(*order)
    shifts = _shifts(pieced, within, value)
    totals = pieced.withColumn(into, _within_piece(value, window))
    same = totals[_PIECE] == shifts["__at"]
    for n, column in enumerate(within):
        same = same & totals[column].eqNullSafe(shifts[f"__g{n}"])
    shift = F.coalesce(F.col(_SHIFT), F.lit(0))
    return (
        totals.join(F.broadcast(shifts), same, "left")
        .withColumn(into, F.col(into) + shift + F.lit(offset).cast("long"))
        .select(*df.columns, into)
    )


def _within_piece(value: Column, window) -> Column:
    running = F.sum(value.cast("long")).over(
        window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return running


def _shifts(pieced: DataFrame, within: list[str], value: Column) -> DataFrame:
    """Totals of earlier pieces of the same group; at most two rows per piece.

    A piece can continue a group only if that group is its first, so only groups
    that come first in some piece need totals.
    """
    names = [f"__g{n}" for n in range(len(within))]
    groups = [F.col(c).alias(g) for c, g in zip(within, names)]
    part = pieced.select(*groups, F.col(_PIECE).alias("__at"), value.cast("long").alias("__n"))
    if within:
        first = part.groupBy("__at").agg(F.min(F.struct(*names)).alias("__first"))
        heads = first.select(*[F.col("__first")[g].alias(f"__c{n}") for n, g in enumerate(names)]).distinct()
        same = F.lit(True)
        for n, g in enumerate(names):
            same = same & part[g].eqNullSafe(heads[f"__c{n}"])
        part = part.join(F.broadcast(heads), same, "left_semi")
    before = Window.partitionBy(*(names or [F.lit(0)])).orderBy("__at")
    earlier = F.sum("__n").over(before.rowsBetween(Window.unboundedPreceding, -1))
    totals = part.groupBy(*names, "__at").agg(F.sum("__n").alias("__n"))
    return totals.select(*names, "__at", F.coalesce(earlier, F.lit(0)).alias(_SHIFT))


def batches(
    df: DataFrame, order: Sequence[str], size: int, drop_last: bool = False,
    into: str = "batch", rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Fixed-size batch number of every row, optionally without an incomplete last batch."""
    out = numbered(df, order, into, rows_per_task=rows_per_task)
    if drop_last:
        out = out.filter(F.col(into) < F.lit(df.count() // size * size))
    return out.withColumn(into, F.floor(F.col(into) / size))


def gathered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column,
    into: str, chunk: int = 1000, rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Ordered list of values per group, whole, in chunks of bounded length.

    A group of up to ``chunk`` rows is one list (chunk 0); a larger one continues
    in chunk 1, 2, ... so no task ever holds an unbounded list.
    """
    placed = numbered(df, order, "__pos", within=keys, rows_per_task=rows_per_task)
    item = F.struct(F.col("__pos"), value.alias("v"))
    return (
        placed.groupBy(*keys, F.floor(F.col("__pos") / chunk).alias("chunk"))
        .agg(F.sort_array(F.collect_list(item)).alias("__items"))
        .withColumn(into, F.transform("__items", lambda s: s["v"]))
        .drop("__items")
    )


def trailing(
    df: DataFrame, key: str, order: str, value: str, length: int, into: str = "history",
    block: int = 100_000, rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """The last ``length`` values per key up to each row, oldest first.

    Keys are split into blocks of rows; each block also receives the
    ``length - 1`` rows before it, so one hot key spreads over many tasks.
    """
    placed = numbered(df, [order], "__n", within=[key], rows_per_task=rows_per_task)
    own = F.floor(F.col("__n") / block)
    ahead = F.floor((F.col("__n") + (length - 1)) / block)
    copies = placed.withColumn("__block", F.explode(F.sequence(own, ahead)))
    window = Window.partitionBy(key, "__block").orderBy("__n").rowsBetween(-(length - 1), 0)
    return (
        copies.withColumn(into, F.collect_list(value).over(window))
        .filter(F.col("__block") == own)
        .drop("__n", "__block")
    )


def moving_average(
    df: DataFrame, key: str, order: str, value: str, decay: float,
    into: str = "average", block: int = 4096, rows_per_task: int = ROWS_PER_TASK,
    state: DataFrame | None = None,
) -> DataFrame:
    """Exponential moving average per key after its last row, with warm-up.

    The first value starts the average; update n uses ``min(decay,
    (1+n)/(10+n))``.  Each update is the map ``s -> a*s + b``; maps compose, so
    blocks reduce in parallel and their results reduce again until one is left.
    ``state`` (key, ``n``, ``average``) continues earlier rows.
    """
    placed = numbered(df, [order], "__n", within=[key], rows_per_task=rows_per_task)
    n, first = F.col("__n").cast("double"), F.lit(0.0)
    if state is not None:
        seen = state.select(key, F.col("n").alias("__seen"), F.col("average").alias("__start"))
        placed = placed.join(seen, key, "left")
        n = n + F.coalesce(F.col("__seen"), F.lit(0))
        first = F.when(F.col("__n") == 0, F.coalesce(F.col("__start"), F.lit(0.0))).otherwise(first)
    rate = F.when(n == 0, F.lit(0.0)).otherwise(
        F.least(F.lit(float(decay)), (n + 1.0) / (n + 10.0))
    )
    # Only the first row carries the earlier average; its map then is a constant.
    level = placed.select(
        key, "__n",
        F.when(F.col("__n") == 0, F.lit(0.0)).otherwise(rate).alias("a"),
        (rate * first + (F.lit(1.0) - rate) * F.col(value)).alias("b"),
    )
    steps, rows = 0, df.count()
    while steps == 0 or rows > 1:
        level = (
            level.groupBy(key, F.floor(F.col("__n") / block).alias("__n"))
            .agg(F.sort_array(F.collect_list(F.struct("__n", "a", "b"))).alias("maps"))
            .select(
                key,
                "__n",
                F.aggregate("maps", F.lit(1.0), lambda acc, m: acc * m["a"]).alias("a"),
                F.aggregate("maps", F.lit(0.0), lambda acc, m: m["a"] * acc + m["b"]).alias("b"),
            )
        )
        steps, rows = steps + 1, -(-rows // block)
    return level.select(key, F.col("b").alias(into))
