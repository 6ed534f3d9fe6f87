"""Class labels, lookups, unions and pair joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.operators.ordering import ROWS_PER_TASK, numbered, running_total
from loomframe.session import settled


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def class_index(
    df: DataFrame, column: str, into: str = "class_no", rank: Column | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Dense 0-based number of each distinct class, by ``rank`` and then name."""
    classes = df.select(column).distinct()
    rank = F.lit(0) if rank is None else rank
    ranked = classes.withColumn("__r", rank)
    return numbered(ranked, ["__r", column], into, rows_per_task=rows_per_task).drop("__r")


def special_last(column: str, special: str) -> Column:
    return F.when(F.col(column) == special, 1).otherwise(0)


def numeric_suffix(column: str) -> Column:
    return F.regexp_extract(column, r"(\d+)$", 1).cast("int")


def with_class_index(df: DataFrame, column: str, into: str = "class_no", **kw) -> DataFrame:
    return df.join(settled(class_index(df, column, into, **kw), "classes"), column)


def lookup_or_fail(df: DataFrame, table: DataFrame, on: str, value: str, what: str) -> DataFrame:
    """Left join that raises when a key has no entry."""
    found = table.select(on, value, F.lit(True).alias("__hit"))
    joined = df.join(found, on, "left")
    checked = F.when(F.col("__hit"), F.col(value)).otherwise(
        F.raise_error(F.concat(F.lit(f"no {what} for "), F.col(on).cast("string"))).cast(
            table.schema[value].dataType
        )
    )
    return joined.withColumn(value, checked).drop("__hit")


def remapped(df: DataFrame, mapping: DataFrame, column: str, src: str = "src", dst: str = "dst"):
    """Replace keys found in ``mapping``; others stay."""
    table = mapping.select(F.col(src).alias(column), F.col(dst).alias("__new"))
    return (
        df.join(table, column, "left")
        .withColumn(column, F.coalesce("__new", F.col(column)))
        .select(*df.columns)
    )


def tagged_union(parts: Sequence[DataFrame], into: str = "class") -> DataFrame:
    """Concatenate tables of one shape with the number of their source."""
    out = None
    for n, part in enumerate(parts):
        tagged = part.withColumn(into, F.lit(n).cast("long"))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def concat_positions(
    union: DataFrame, source: str, key: str, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Global row index of a concatenation and the index inside its source."""
    placed = numbered(union, [source, key], "global_index", rows_per_task=rows_per_task)
    sizes = union.groupBy(source).agg(F.count(F.lit(1)).alias("__size"))
    starts = running_total(sizes, [source], F.col("__size"), "__end").select(
        source, (F.col("__end") - F.col("__size")).alias("__start")
    )
    return (
        placed.join(settled(starts, "starts"), source)
        .withColumn("local_index", F.col("global_index") - F.col("__start"))
        .drop("__start")
    )


def chained_lookup(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Chain lookup tables; for a repeated key the later table wins."""
    union = tagged_union(parts, "__part")
    rest = [c for c in parts[0].columns if c != key]
    row = F.max_by(F.struct(*rest), F.col("__part")).alias("__row")
    return union.groupBy(key).agg(row).select(key, "__row.*")


def last_written(df: DataFrame, keys: Sequence[str], position: Sequence[str]) -> DataFrame:
    """The last row per key in write order (combined before the shuffle)."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*position)).alias("__row")
    return df.groupBy(*keys).agg(row).select(*keys, "__row.*")


def latest_by_name(df: DataFrame, name: str) -> DataFrame:
    """The single row whose name is last in natural order (digits as numbers).

    Names are compared part by part, text and numbers in turn.  Numbers may have any
    length: they compare by their count of digits without leading zeros, then by these.
    """
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))

    def ranked(part: Column) -> Column:
        number = F.regexp_replace(part, "^0+(?=.)", "")
        digits = part.rlike("^[0-9]")
        return F.struct(
            F.when(digits, F.lit(0)).otherwise(1).alias("kind"),
            F.when(digits, F.length(number)).otherwise(0).alias("size"),
            F.when(digits, number).otherwise(part).alias("part"),
        )

    order = F.struct(F.transform(parts, ranked), F.col(name))
    return df.groupBy().agg(F.max_by(name, order).alias(name))


def sibling_join(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, how="inner"):
    """Join two file tables on a normalised stem."""
    a = left.withColumn("__stem", left_key)
    b = right.withColumn("__stem", right_key)
    return a.join(b, "__stem", how).drop("__stem")


def tiled(df: DataFrame, key: str, n: int, into: str = "repeat") -> DataFrame:
    """Repeat every row so that the table has ``n`` rows; ``n`` must divide evenly."""
    rows = df.count()
    if rows == 0 or n % rows:
        raise ValueError(f"{n} rows cannot be tiled evenly from {rows} prompts")
    return df.withColumn(into, F.explode(F.sequence(F.lit(0), F.lit(n // rows - 1))))


def repeated(df: DataFrame, epochs: int, into: str = "epoch") -> DataFrame:
    """The table once per epoch."""
    return df.withColumn(into, F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
