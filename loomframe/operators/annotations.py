"""Box annotations: joins to dimensions, filters and object sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.functions import boxes, seeded
from loomframe.operators import labels
from loomframe.operators.filters import groups_with_count


def box_of(prefix: str = "") -> Column:
    return boxes.box(*[F.col(prefix + c) for c in ("x", "y", "w", "h")])


def usable_categories(
    categories: DataFrame, mapping: DataFrame | None = None, allow: DataFrame | None = None,
) -> DataFrame:
    """Categories allowed by name that are not replaced by the mapping."""
    out = categories
    if allow is not None:
        out = out.join(allow.select("name"), "name", "left_semi")
    if mapping is not None:
        out = out.join(mapping.select(F.col("src").alias("id")), "id", "left_anti")
    return out


def category_numbers(categories: DataFrame, special: str) -> DataFrame:
    """Dense number by id, with one special id forced last."""
    return labels.class_index(
        categories, "id", "category_no", rank=labels.special_last("id", special)
    )


def known_annotations(
    annotations: DataFrame, categories: DataFrame, mapping: DataFrame | None, min_area: float
) -> DataFrame:
    """Remap categories, drop unknown ones and small boxes."""
    large = annotations.filter(F.col("w") * F.col("h") > min_area)
    if mapping is not None:
        large = labels.remapped(large, mapping, "category_id")
    known = categories.select(F.col("id").alias("category_id"), "name")
    return large.join(known, "category_id")


def bounded_images(annotations: DataFrame, low: int, high: int) -> DataFrame:
    """Annotations of images that hold between ``low`` and ``high`` of them."""
    return groups_with_count(annotations, "image_id", ["ann_id"], low, high)


def object_lists(
    annotations: DataFrame, spec: boxes.SequenceSpec, seed: int, label: Column
) -> DataFrame:
    """Per image: the first ``max_objects`` annotations in a seeded random order.

    The row-number cut is applied before the shuffle as well, so lists stay
    bounded whatever the number of annotations of one image.
    """
    first = Window.partitionBy("image_id").orderBy("ann_id")
    capped = annotations.withColumn("__n", F.row_number().over(first)).filter(
        F.col("__n") <= spec.max_objects
    )
    item = F.struct(
        seeded.digest(seed, "ann_id").alias("d"),
        F.col("ann_id").alias("a"),
        label.cast("int").alias("label"),
        box_of().alias("box"),
    )
    return capped.groupBy("image_id").agg(F.sort_array(F.collect_list(item)).alias("objects"))


def object_sequences(
    annotations: DataFrame, crops: DataFrame, spec: boxes.SequenceSpec, seed: int, label: Column
) -> DataFrame:
    """Token sequence per image from annotations and its crop (``crop``, ``flip``)."""
    listed = object_lists(annotations, spec, seed, label)
    return listed.join(crops, "image_id").select(
        "image_id",
        boxes.object_sequence(F.col("objects"), F.col("crop"), F.col("flip"), spec).alias(
            "sequence"
        ),
    )


def top_categories(annotations: DataFrame, categories: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent category names; counts are taken before the name join."""
    counts = annotations.groupBy("category_id").agg(F.count(F.lit(1)).alias("n"))
    names = categories.select(F.col("id").alias("category_id"), "name")
    return (
        counts.join(names, "category_id")
        .groupBy("name").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "name")
        .limit(n)
    )
