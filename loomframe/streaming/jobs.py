"""Incremental jobs: read what is new, process it once, keep state in tables.

State lives in versioned tables in a shared folder.  Version n is a function of
version n-1 and of micro-batch n, and writing it again gives the same table, so a
repeated batch after a failure does no harm.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from loomframe.operators import matching, vectors
from loomframe.operators.ordering import moving_average, trailing
from loomframe.session import fresh_path


def incoming(spark: SparkSession, path: str, schema=None, files_per_batch: int = 100) -> DataFrame:
    """Parquet shards as a stream, a bounded number of files per batch.

    The path is given as a pattern, which stands for a folder as well as for one file.
    """
    schema = schema if schema is not None else spark.read.parquet(path).schema
    head, _, tail = path.rstrip("/").rpartition("/")
    path = f"{head}/{{{tail}}}" if not set(tail) & set("*?[{") else path
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def dealt(df: DataFrame, order: str, folder: str, parts: int = 3) -> str:
    """``df`` written to ``folder`` as ``parts`` files of ascending ranges of the number ``order``, one after the other.

    Read with one file per batch, they are micro-batches in order.
    """
    low, high = df.agg(F.min(order), F.max(order)).first()
    part = F.least(F.floor((F.col(order) - F.lit(low)) * parts / F.lit(max(1, (high or 0) - (low or 0) + 1))), F.lit(parts - 1))
    for n in range(parts):
        df.filter(F.coalesce(part, F.lit(0)) == n).coalesce(1).write.mode("append").parquet(folder)
    return folder


def append_new(stream: DataFrame, out: str, checkpoint: str, rows_per_file: int = 65_536) -> None:
    """Append the rows of all shards that have not been processed yet."""
    (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("maxRecordsPerFile", rows_per_file)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def filter_append(
    spark: SparkSession, source: str, keep: Column, out: str, checkpoint: str, **kw
) -> None:
    append_new(incoming(spark, source, **kw).filter(keep), out, checkpoint)


def fold_batches(
    stream: DataFrame, state_dir: str, checkpoint: str, start: DataFrame,
    step: Callable[[DataFrame, DataFrame], DataFrame],
    emit: Callable[[DataFrame, DataFrame], DataFrame] | None = None, out: str | None = None,
) -> DataFrame:
    """Fold micro-batches into a state table; returns the newest version.

    ``emit`` makes rows of a batch and the state before it, which go to a folder of their own below
    ``out``.  Of the versions the last two stay: a batch that is repeated reads the one before it.
    """
    spark = start.sparkSession
    root, system = _place(spark, state_dir)
    if not system.exists(root):
        start.write.parquet(f"{state_dir}/version=-1")

    def absorb(batch: DataFrame, number: int) -> None:
        session, batch = batch.sparkSession, batch.persist()
        state = session.read.schema(start.schema).parquet(f"{state_dir}/version={number - 1}")
        if emit is not None:
            emit(state, batch).write.mode("overwrite").parquet(f"{out}/batch={number}")
        step(state, batch).write.mode("overwrite").parquet(f"{state_dir}/version={number}")
        batch.unpersist()
        _removed(session, f"{state_dir}/version={number - 2}")

    query = (
        stream.writeStream.foreachBatch(absorb)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(start.schema).parquet(_newest_version(spark, state_dir))


def _place(spark: SparkSession, path: str):
    """The path and its file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _removed(spark: SparkSession, path: str) -> None:
    place, system = _place(spark, path)
    system.delete(place, True)


def _newest_version(spark: SparkSession, state_dir: str) -> str:
    """Folder of the newest state, by name; the data of older ones isn't read."""
    root, system = _place(spark, state_dir)
    names = [entry.getPath().getName() for entry in system.listStatus(root)]
    newest = max(int(name.partition("=")[2]) for name in names if name.startswith("version="))
    return f"{state_dir}/version={newest}"


def moving_averages(
    stream: DataFrame, key: str, order: str, value: str, decay: float, state_dir: str,
    checkpoint: str,
) -> DataFrame:
    """Exponential moving average per key over micro-batches in stream order.

    Every batch is composed in parallel, so a hot key is no bottleneck.
    """
    spark = stream.sparkSession
    kind = stream.schema[key].dataType.simpleString()
    start = spark.createDataFrame([], f"{key} {kind}, n bigint, average double")

    def step(state: DataFrame, batch: DataFrame) -> DataFrame:
        counts = batch.groupBy(key).agg(F.count(F.lit(1)).alias("m"))
        new = moving_average(batch, key, order, value, decay, into="average", state=state)
        grown = state.select(key, "n").join(counts, key, "full").select(
            key, (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n")
        )
        old = state.select(key, F.col("average").alias("__old"))
        return grown.join(new, key, "left").join(old, key, "left").select(
            key, "n", F.coalesce("average", "__old").alias("average")
        )

    return fold_batches(stream, state_dir, checkpoint, start, step)


def trailing_histories(
    stream: DataFrame, key: str, order: str, value: str, length: int, state_dir: str, checkpoint: str, out: str,
    into: str = "history", block: int = 100_000,
) -> DataFrame:
    """The rows of a stream with the last ``length`` values of their key, oldest first, from micro-batches.

    The state is a bounded list for each key: its last ``length`` - 1 rows.  A batch is numbered
    after them and cut into blocks of rows, each with the few rows before it, so that a hot key
    spreads over many tasks.  Rows have to come in their order, as numbers or times do.
    """
    spark = stream.sparkSession
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    start = spark.createDataFrame([], fields)

    def emit(state: DataFrame, batch: DataFrame) -> DataFrame:
        both = state.withColumn("__new", F.lit(False)).unionByName(batch.withColumn("__new", F.lit(True)))
        return trailing(both, key, order, value, length, into, block).filter("__new").drop("__new")

    def step(state: DataFrame, batch: DataFrame) -> DataFrame:
        last = Window.partitionBy(key).orderBy(F.desc(order))
        both = state.unionByName(batch).withColumn("__back", F.row_number().over(last))  # cut before the shuffle, too
        return both.filter(F.col("__back") < length).drop("__back")

    fold_batches(stream, state_dir, checkpoint, start, step, emit, out)
    values = next(f.dataType.simpleString() for f in stream.schema if f.name == value)
    # batches that brought nothing new leave what is there as it is
    return spark.read.schema(f"{fields}, `{into}` array<{values}>").option("basePath", out).parquet(f"{out}/batch=*").select(*stream.columns, into)


def online_codebook(
    stream: DataFrame, codebook: DataFrame, codes: int, decay: float, eps: float,
    state_dir: str, checkpoint: str, key: str = "id", vector: str = "z",
) -> DataFrame:
    """Codebook state updated by every micro-batch of vectors."""

    def step(state: DataFrame, batch: DataFrame) -> DataFrame:
        assigned = matching.nearest_code(batch, state.select("code", "e"), key, vector, keep_vector=True)
        return vectors.codebook_update(state, assigned, decay, eps, codes, vector)

    return fold_batches(stream, state_dir, checkpoint, vectors.fresh_state(codebook), step)


def running_means(stream: DataFrame, key: str, value: str, out: str, checkpoint: str) -> DataFrame:
    """Mean of each metric over everything seen, kept by streaming aggregation.

    Each batch publishes a version of its own below ``out``; readers of the one before aren't disturbed.
    """
    spark = stream.sparkSession
    means = stream.groupBy(key).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))

    def publish(table: DataFrame, number: int) -> None:
        table.write.mode("overwrite").parquet(f"{out}/version={number}")
        _removed(table.sparkSession, f"{out}/version={number - 2}")

    (
        means.writeStream.outputMode("complete")
        .foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.schema(means.schema).parquet(_newest_version(spark, out))


class Meter(StreamingQueryListener):
    """Rows, seconds and rows per second of every micro-batch of the streams that :meth:`watched` marks.

    Rows are counted by an observation inside the stream, so that they are those that passed it.
    """

    fields = "query string, batch long, rows long, seconds double, rows_per_second double"

    def __init__(self, name: str):
        self.name, self.rows, self._done = name, [], threading.Condition()
        self._ended: set[str] = set()

    def watched(self, stream: DataFrame) -> DataFrame:
        return stream.observe(self.name, F.count(F.lit(1)).alias("rows"))

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        seen = progress.observedMetrics.get(self.name)
        if seen is not None and seen["rows"]:
            seconds = progress.batchDuration / 1000
            self.rows.append((str(progress.runId), progress.batchId, seen["rows"], seconds, seen["rows"] / max(seconds, 1e-3)))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self._done:
            self._ended.add(str(event.runId))
            self._done.notify_all()

    def write(self, spark: SparkSession, out: str, queries: int = 1, wait: float = 30.0) -> DataFrame:
        """Append what was measured to a table once so many queries have ended; reports come after the end."""
        with self._done:
            self._done.wait_for(lambda: len(self._ended) >= queries, wait)
        spark.createDataFrame(self.rows, self.fields).write.mode("append").parquet(out)
        self.rows = []
        return spark.read.schema(self.fields).parquet(out)


def folders(spark: SparkSession, stem: str) -> tuple[str, str]:
    """Fresh output and checkpoint folders below the shared folder."""
    base = fresh_path(spark, stem)
    return f"{base}/out", f"{base}/checkpoint"
