"""Readers: shards, annotation and caption files, key/value text, arrays, images."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.functions import paths
from loomframe.functions.text import strip
from loomframe.sources import documents

ANNOTATION_CSV = (
    "ImageID string, Source string, LabelName string, Confidence double, XMin double, "
    "XMax double, YMin double, YMax double, IsOccluded int, IsTruncated int, IsGroupOf int, "
    "IsDepiction int, IsInside int"
)
# The fields of instance and caption documents.
IMAGE_FIELDS = (
    "id long, file_name string, width int, height int, coco_url string, license int, date_captured string, flickr_url string"
)
CATEGORY_FIELDS = "id long, supercategory string, name string"
INSTANCE_FIELDS = "id long, image_id long, category_id long, bbox array<double>, iscrowd int"
CAPTION_FIELDS = "image_id long, caption string"
PIXELS = T.StructType(
    [
        T.StructField("h", T.IntegerType()),
        T.StructField("w", T.IntegerType()),
        T.StructField("c", T.IntegerType()),
        T.StructField("data", T.ArrayType(T.FloatType())),
    ]
)


def manifest(spark: SparkSession, root: str, suffix: str = ".parquet") -> DataFrame:
    """Files under ``root`` with their sizes; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"*{suffix}")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", "length", "modificationTime")
    )


def shards(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Parquet rows with the shard they came from."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path).withColumn("shard", F.col("_metadata.file_path"))


def path_list(spark: SparkSession, file: str, root: str) -> DataFrame:
    """One relative path per line, joined to ``root``."""
    lines = spark.read.text(file).select(strip("value").alias("relpath"))
    return lines.filter(F.length("relpath") > 0).withColumn(
        "file_path", paths.under_root(root, "relpath")
    )


def box_annotations(spark: SparkSession, file: str) -> DataFrame:
    raw = spark.read.csv(file, header=True, schema=ANNOTATION_CSV, mode="FAILFAST")
    width, height = F.col("XMax") - F.col("XMin"), F.col("YMax") - F.col("YMin")
    return raw.select(
        F.col("ImageID").alias("image_id"),
        F.col("Source").alias("source"),
        F.col("LabelName").alias("category_id"),
        F.col("Confidence").alias("confidence"),
        F.col("XMin").alias("x"),
        F.col("YMin").alias("y"),
        width.alias("w"),
        height.alias("h"),
        (width * height).alias("area"),
        *[
            F.col(f"Is{n}").cast("boolean").alias(alias)
            for n, alias in (
                ("Occluded", "is_occluded"), ("Truncated", "is_truncated"),
                ("GroupOf", "is_group_of"), ("Depiction", "is_depiction"),
                ("Inside", "is_inside"),
            )
        ],
    )


def image_ids(spark: SparkSession, file: str) -> DataFrame:
    return spark.read.csv(file, header=True, schema="image_name string", mode="FAILFAST").select(
        paths.stem("image_name").alias("image_id"), "image_name"
    )


def class_names(spark: SparkSession, file: str) -> DataFrame:
    return spark.read.csv(file, schema="id string, name string", mode="FAILFAST")


def instances(spark: SparkSession, file: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, categories and annotations of an instance document, read once by byte ranges."""
    tables = documents.sections(spark, file, {"images": IMAGE_FIELDS, "categories": CATEGORY_FIELDS, "annotations": INSTANCE_FIELDS})
    found = tables["annotations"].select(
        "id", "image_id", "category_id", *[F.element_at("bbox", n + 1).alias(c) for n, c in enumerate("xywh")],
        F.col("iscrowd").cast("boolean").alias("is_group_of"),
    )
    return tables["images"].drop("position"), tables["categories"].drop("position"), found


def captions(spark: SparkSession, file: str) -> tuple[DataFrame, DataFrame]:
    """Images, and captions numbered by their place in the document."""
    tables = documents.sections(spark, file, {"images": "id long, file_name string", "annotations": CAPTION_FIELDS})
    texts = tables["annotations"].withColumnRenamed("position", "caption_id")
    return tables["images"].drop("position"), texts


def index_to_class(spark: SparkSession, file: str) -> DataFrame:
    """``idx: name`` lines."""
    parts = F.split("value", ":", 2)
    return spark.read.text(file).filter(F.col("value").rlike(r"^\W*\d+\s*:")).select(
        F.regexp_extract(parts[0], r"(\d+)", 1).cast("int").alias("idx"),
        strip(parts[1]).alias("name"),
    )


def index_to_label(spark: SparkSession, file: str) -> DataFrame:
    """``idx: 'label, label'`` lines, braces and quotes removed."""
    table = index_to_class(spark, file)
    label = F.regexp_replace("name", r"^[{'\"]+|['\"},]+$", "")
    return table.select("idx", label.alias("label"))


def first_word_map(spark: SparkSession, file: str, key: str, value: str) -> DataFrame:
    """Lines cut once at white space: an id, then the rest."""
    parts = F.split(strip("value"), r"\s+", 2)
    return spark.read.text(file).filter(F.length(strip("value")) > 0).select(
        parts[0].alias(key), parts[1].alias(value)
    )


def image_tree(spark: SparkSession, root: str, suffixes=None, class_pattern: str = r"([^/]+)/[^/]+$"):
    """Image files below ``root`` with their folder class; contents on demand."""
    from loomframe.operators.filters import IMAGE_SUFFIXES, is_image_file

    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    )
    base = "file:" + root.rstrip("/") if "://" not in root and root.startswith("/") else root
    return files.filter(is_image_file("path", suffixes or IMAGE_SUFFIXES)).select(
        "path",
        F.regexp_replace("path", "^" + base.rstrip("/") + "/*", "").alias("relpath"),
        F.regexp_extract("path", class_pattern, 1).alias("folder"),
        "content",
    )


def write_file_list(tree: DataFrame, out: str) -> None:
    """Sorted relative paths, one per line."""
    tree.select(F.col("relpath").alias("value")).orderBy("value").write.mode("overwrite").text(out)


def decoded(
    df: DataFrame, key: str, column: str, decode: Callable[[bytes], np.ndarray]
) -> DataFrame:
    """Encoded image column as pixel rows, by a decoder the caller supplies."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for k, raw in zip(part[key], part[column]):
                arr = np.asarray(decode(bytes(raw)))
                arr = arr[:, :, None] if arr.ndim == 2 else arr
                rows.append((k, *arr.shape, arr.astype("f4").ravel()))
            yield pd.DataFrame(rows, columns=[key, "h", "w", "c", "data"])

    schema = T.StructType([df.schema[key], *PIXELS.fields])
    return df.select(key, column).mapInPandas(run, schema)
