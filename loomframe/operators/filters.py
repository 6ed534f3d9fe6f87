"""Row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


SIZE_MODES = ("all_ge", "all_gt", "any_gt", "any_ge")


def large_enough(width, height, size: int, mode: str) -> Column:
    """Image size rule: both or either side, at least or above ``size``."""
    low, high = F.least(_c(width), _c(height)), F.greatest(_c(width), _c(height))
    side = {"all": low, "any": high}[mode.split("_")[0]]
    return side >= size if mode.endswith("ge") else side > size


def tagged_and_described(tags, remark) -> Column:
    return (F.size(_c(tags)) > 0) & (F.length(F.coalesce(_c(remark), F.lit(""))) > 0)


def describable(keywords, remark, script: str) -> Column:
    """:func:`tagged_and_described` on unparsed text, without splitting it.

    Some tag of a script exists exactly when the tag text has one of its letters,
    and so does a parsed remark, so two searches decide and stay in generated code.
    """
    pattern = f"[{script}]"
    return _c(keywords).rlike(pattern) & _c(remark).rlike(pattern)


def on_topic(
    tags, keywords: Sequence[str], veto_part: str, exempt: str, veto_tags: Sequence[str] = ()
) -> Column:
    """Keep rows with a keyword tag unless any tag is vetoed.

    A tag containing ``veto_part`` vetoes the row unless it equals ``exempt``
    untrimmed; vetoed tags match untrimmed; keywords match trimmed tags.
    """
    from loomframe.functions.text import strip

    tags = F.coalesce(_c(tags), F.array().cast("array<string>"))
    vetoed = F.exists(
        tags,
        lambda t: (t.contains(veto_part) & (t != exempt)) | t.isin(list(veto_tags) or [None]),
    )
    wanted = F.exists(tags, lambda t: strip(t).isin(list(keywords)))
    return wanted & ~F.coalesce(vetoed, F.lit(False))


def with_landmarks(points) -> Column:
    """Rows whose landmarks were found: a missing or empty list is none."""
    return F.size(F.coalesce(_c(points), F.array().cast("array<struct<x:double,y:double>>"))) > 0


def has_text(text) -> Column:
    return F.length(F.coalesce(_c(text), F.lit(""))) > 0


# Image file extensions, as written by cameras and tools.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "ppm", "bmp", "tif")


def is_image_file(path, suffixes: Sequence[str] = IMAGE_SUFFIXES, any_case: bool = True) -> Column:
    pattern = r"\.(" + "|".join(suffixes) + ")$"
    return _c(path).rlike(("(?i)" if any_case else "") + pattern)


def keep_listed(df: DataFrame, listed: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(listed.select(*on), list(on), "left_semi")


def drop_listed(df: DataFrame, listed: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(listed.select(*on), list(on), "left_anti")


def groups_with_count(
    df: DataFrame, group: str, order: Sequence[str], low: int, high: int
) -> DataFrame:
    """Rows of groups that hold between ``low`` and ``high`` rows.

    Each group is first cut to ``high + 1`` rows, which Spark applies before the
    shuffle, so an oversized group never travels; a group still longer than
    ``high`` is then known to be too large.  One shuffle serves both windows.
    """
    from pyspark.sql import Window

    by = Window.partitionBy(group)
    cut = df.withColumn("__n", F.row_number().over(by.orderBy(*order))).filter(
        F.col("__n") <= high + 1
    )
    return (
        cut.withColumn("__size", F.count(F.lit(1)).over(by))
        .filter(F.col("__size").between(low, high))
        .drop("__n", "__size")
    )


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Project to the requested columns; an unknown one is an error up front."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}, have {df.columns}")
    return df.select(*names)
