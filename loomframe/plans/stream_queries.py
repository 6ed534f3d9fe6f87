"""Streaming queries, run over all available files and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.functions.arrays import doubles, mean
from loomframe.plans import views
from loomframe.plans.registry import ORACLE, query, rounded
from loomframe.streaming import jobs


@query(
    "stream_filter_append",
    "select event_id, event_type, value from events where value > 20 and event_type <> 'error'",
)
def stream_filter_append(t):
    out, checkpoint = jobs.folders(t.spark, "filtered")
    keep = (F.col("value") > 20) & (F.col("event_type") != "error")
    jobs.filter_append(t.spark, t.path("events"), keep, out, checkpoint)
    return t.spark.read.parquet(out).select("event_id", "event_type", "value")


def _in_three(t, name, order):
    """A given table as a stream of three micro-batches, by ranges of its key."""
    table = getattr(t, name)
    base, _ = jobs.folders(t.spark, "dealt")
    return jobs.incoming(t.spark, jobs.dealt(table, order, base), table.schema, files_per_batch=1)


@query("stream_ema", ORACLE["ema"])
def stream_ema(t):
    """The moving average of :func:`ema`, from micro-batches."""
    out, checkpoint = jobs.folders(t.spark, "averages")
    events = _in_three(t, "events", "event_id")
    params = events.select(F.col("event_type").alias("name"), F.col("event_id").alias("step"), "value")
    done = jobs.moving_averages(params, "name", "step", "value", 0.999, out, checkpoint)
    return done.select("name", rounded("average").alias("average"))


@query(
    "epoch_metric_mean",
    "select event_type, round(avg(value), 6) as mean, count(*) as n from events group by event_type",
)
def epoch_metric_mean(t):
    out, checkpoint = jobs.folders(t.spark, "means")
    events = _in_three(t, "events", "event_id")
    means = jobs.running_means(events.select("event_type", "value"), "event_type", "value", out, checkpoint)
    return means.select("event_type", rounded("mean").alias("mean"), "n")


@query("stream_codebook", ORACLE["codebook_ema"])
def stream_codebook(t):
    """The codebook update of :func:`codebook_ema`, from micro-batches."""
    out, checkpoint = jobs.folders(t.spark, "codes")
    # one batch: the twin updates the codebook once, with all vectors
    stream = jobs.incoming(t.spark, t.path("embeddings"), t.embeddings.schema).select(
        F.col("vec_id").alias("id"), doubles("embedding").alias("z")
    )
    state = jobs.online_codebook(stream, views.codebook(t), 16, 0.99, 1e-5, out, checkpoint)
    flat = state.select("code", "cluster_size", F.posexplode("e").alias("pos", "x"))
    return flat.select(
        "code", F.col("pos").cast("long").alias("pos"),
        rounded("cluster_size").alias("cluster_size"), rounded("x", 5).alias("v"),
    )


@query("stream_trailing", ORACLE["trailing_history"])
def stream_trailing(t):
    """The trailing history of :func:`trailing_history`, from three micro-batches."""
    state, checkpoint = jobs.folders(t.spark, "trailing")
    out, _ = jobs.folders(t.spark, "histories")
    events = _in_three(t, "events", "event_id")
    params = events.select(F.col("event_type").alias("name"), F.col("event_id").alias("step"), "value")
    held = jobs.trailing_histories(params, "name", "step", "value", 10, state, checkpoint, out)
    return held.select(
        "name", "step", F.size("history").cast("long").alias("n"), rounded(F.col("history")[0]).alias("oldest"),
        rounded(F.element_at("history", -1)).alias("newest"), rounded(mean("history")).alias("mean"),
    )
