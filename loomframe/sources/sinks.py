"""Sinks, yield gates, resume and output names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.operators.ordering import ROWS_PER_TASK, numbered
from loomframe.session import settled


def append(df: DataFrame, path: str, rows_per_file: int = 65_536) -> None:
    """Append all rows, in files of at most ``rows_per_file`` rows."""
    df.write.mode("append").option("maxRecordsPerFile", rows_per_file).parquet(path)


def shards_with_yield(df: DataFrame, shard: str, min_rows: int) -> DataFrame:
    """Rows of shards that still hold at least ``min_rows`` rows.

    The list of good shards is written first, so its join is planned by true size.
    """
    good = df.groupBy(shard).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= min_rows)
    return df.join(settled(good.select(shard), "shards"), shard, "left_semi")


def unprocessed(manifest: DataFrame, processed: DataFrame, on: str = "path") -> DataFrame:
    return manifest.join(processed.select(on), on, "left_anti")


def outputs_present(spark: SparkSession, folder: str, suffix: str = ".png") -> int:
    """How many outputs a folder holds already; their contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    return files.select("path").count()


def output_names(
    df: DataFrame, order: list[str], already: int, width: int = 6, suffix: str = ".png",
    into: str = "out_name", rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Zero-padded sequential names that continue after existing outputs."""
    placed = numbered(df, order, "__n", start=already, rows_per_task=rows_per_task)
    digits = F.col("__n").cast("string")
    name = F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0"))
    return placed.withColumn(into, F.concat(name, F.lit(suffix))).drop("__n")
