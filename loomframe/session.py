"""Session helpers: a local session for tests and the shared working folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", name: str = "loomframe", **conf) -> SparkSession:
    """A local session for tests and the bench.  Clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, else a folder below the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"


def fresh_path(spark: SparkSession, stem: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def materialise(df: DataFrame, stem: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back (cuts lineage)."""
    spark = df.sparkSession
    path = fresh_path(spark, stem)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, stem: str) -> DataFrame:
    """A derived lookup table, written once so that the planner knows its size.

    Joins with it are broadcast only when the written table is below Spark's
    broadcast threshold; otherwise they shuffle, with skewed keys split by AQE.
    """
    return materialise(df, stem)


def fits(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows, reading no more than needed."""
    return df.limit(max_rows + 1).count() <= max_rows
