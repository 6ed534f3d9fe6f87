"""Vector-table jobs: codebooks, k-means, codebook updates, drawn and checked vectors.

Sums of vectors are taken whole by Spark's summariser, which combines before the
shuffle; elements are never exploded into rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.functions import seeded
from loomframe.functions.arrays import doubles
from loomframe.operators.matching import nearest_code, shippable
from loomframe.session import materialise


def with_code_vector(df: DataFrame, codebook: DataFrame, code: str = "code") -> DataFrame:
    """Attach the vector of each code.

    Codes are few and often skewed: a codebook of checked size is broadcast, a
    larger one is joined by shuffle, where AQE splits hot codes.
    """
    table = codebook.select(F.col("code").alias(code), "e")
    return df.join(F.broadcast(table) if shippable(codebook) else table, code)


def code_usage(df: DataFrame, code: str = "code") -> DataFrame:
    """Rows and share of every used code.  The total is taken over the counts, one row per code."""
    counts = df.groupBy(code).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("share", F.col("n") / total)


def perplexity(usage: DataFrame) -> DataFrame:
    """Perplexity of the code distribution and the number of used codes."""
    p = F.col("share")
    return usage.agg(
        F.exp(-F.sum(p * F.log(p + 1e-10))).alias("perplexity"),
        F.count(F.when(p > 0, 1)).alias("used"),
    )


def with_perplexity(usage: DataFrame) -> DataFrame:
    """:func:`perplexity` next to every code, without counting the codes again."""
    whole = Window.partitionBy(F.lit(0))
    p = F.col("share")
    entropy = -F.sum(p * F.log(p + 1e-10)).over(whole)
    return usage.withColumns(
        {"perplexity": F.exp(entropy), "used": F.count(F.when(p > 0, 1)).over(whole)}
    )


def remap_codes(
    df: DataFrame, used: DataFrame, code: str = "code", unknown: str | int = "extra",
    key: str = "id", seed: int = 0, into: str = "compact",
) -> DataFrame:
    """Code to its position in the stored table ``used`` (``code``, ``position``).

    Unknown codes become a random position, one extra position, or a given one.
    """
    size = used.count()
    table = used.select(F.col("code").alias(code), F.col("position").alias("__p"))
    if unknown == "random":
        other = seeded.uniform_int(seed, size, key)
    else:
        other = F.lit(size if unknown == "extra" else int(unknown))
    joined = df.join(table, code, "left")
    return joined.withColumn(into, F.coalesce("__p", other).cast("long")).drop("__p")


def unmap_codes(df: DataFrame, used: DataFrame, compact: str = "compact", into: str = "code"):
    """Inverse of :func:`remap_codes`; the extra position becomes the first code."""
    size = used.count()
    table = used.select(F.col("position").alias("__q"), F.col("code").alias(into))
    slot = F.when(F.col(compact) >= size, F.lit(0)).otherwise(F.col(compact))
    return df.withColumn("__q", slot.cast("long")).join(table, "__q").drop("__q")


def summed(df: DataFrame, groups: Sequence[str], vector: str, *metrics: str) -> DataFrame:
    """Element-wise ``metrics`` of the vectors per group, as arrays, and their ``count``.

    Vectors of a group have one length; missing ones are left out.
    """
    present = df.filter(F.col(vector).isNotNull())
    stats = Summarizer.metrics(*metrics, "count").summary(array_to_vector(doubles(vector)))
    return present.groupBy(*groups).agg(stats.alias("__s")).select(
        *groups, *[vector_to_array(F.col("__s")[m]).alias(m) for m in metrics],
        F.col("__s")["count"].alias("count"),
    )


def element_means(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean vector per group as rows ``(group, pos, mean, n)``."""
    means = summed(df, [group], vector, "mean")
    return means.select(group, F.col("count").alias("n"), F.posexplode("mean").alias("pos", "mean")).select(
        group, "pos", "mean", "n"
    )


def initial_codebook(vectors: DataFrame, k: int, seed: int, key: str = "id", vector: str = "z"):
    """``k`` random rows as a codebook numbered by their seeded order."""
    picked = vectors.orderBy(seeded.digest(seed, key), F.col(key)).limit(k)
    order = Window.partitionBy(F.lit(0)).orderBy(seeded.digest(seed, key), F.col(key))
    return picked.select(
        (F.row_number().over(order) - 1).alias("code"), doubles(vector).alias("e")
    )


def kmeans(
    vectors: DataFrame, k: int, iterations: int, seed: int, key: str = "id", vector: str = "z",
    start: DataFrame | None = None,
) -> DataFrame:
    """K-means codebook: assign, take means, re-seed empty codes from random rows.

    The loop keeps only ``k`` codes between its jobs, written to the shared folder.
    """
    codebook = start if start is not None else initial_codebook(vectors, k, seed, key, vector)
    codebook = materialise(codebook.select(F.col("code").cast("long"), "e"), "codebook")
    data = vectors.select(key, doubles(vector).alias(vector))
    for step in range(iterations):
        assigned = nearest_code(data, codebook, key, vector, keep_vector=True)
        means = summed(assigned, ["code"], vector, "mean").select("code", F.col("mean").alias("e"))
        moved = materialise(means, "codebook")
        dead = codebook.select("code").join(moved, "code", "left_anti")
        if dead.isEmpty():
            codebook = moved
            continue
        spare = initial_codebook(data, k, seed + step + 1, key, vector).withColumnRenamed(
            "code", "__slot"
        )
        order = Window.partitionBy(F.lit(0)).orderBy("code")
        reseeded = (
            dead.withColumn("__slot", F.row_number().over(order) - 1)
            .join(spare, "__slot")
            .select("code", "e")
        )
        codebook = materialise(moved.select("code", "e").unionByName(reseeded), "codebook")
    return codebook


def codebook_update(
    state: DataFrame, assigned: DataFrame, decay: float, eps: float, codes: int,
    vector: str = "z",
) -> DataFrame:
    """One decayed update of a codebook state.

    State rows: ``code, cluster_size, e_sum (array), e (array)``; ``assigned`` rows
    hold ``code`` and the vector.  Codes without rows only decay.
    """
    batch = summed(assigned, ["code"], vector, "sum").select(
        "code", F.col("count").alias("__n"), F.col("sum").alias("__sum")
    )
    keep, add = F.lit(float(decay)), F.lit(1.0 - decay)
    zero = F.transform("e_sum", lambda _: F.lit(0.0))
    joined = state.join(batch, "code", "left").select(
        "code",
        (keep * F.col("cluster_size") + add * F.coalesce("__n", F.lit(0))).alias("cluster_size"),
        F.zip_with(
            "e_sum", F.coalesce("__sum", zero), lambda a, b: keep * a + add * b
        ).alias("e_sum"),
    )
    # The state holds one row per code, so its total is one bounded aggregate.
    total = F.sum("cluster_size").over(Window.partitionBy(F.lit(0)))
    smoothed = (F.col("cluster_size") + eps) / (F.col("__total") + codes * eps) * F.col("__total")
    return (
        joined.withColumn("__total", total)
        .withColumn("__size", smoothed)
        .select(
            "code", "cluster_size", "e_sum",
            F.transform("e_sum", lambda x: x / F.col("__size")).alias("e"),
        )
    )


def fresh_state(codebook: DataFrame) -> DataFrame:
    """State before the first update: zero counts, sums equal to the codes."""
    e = doubles("e")
    return codebook.select(
        F.col("code").cast("long"), F.lit(0.0).alias("cluster_size"),
        e.alias("e_sum"), e.alias("e"),
    )


def embed(
    df: DataFrame, ids: str, mask: str, make_encoder, width: int, batch_size: int = 64,
    into: str = "embedding",
) -> DataFrame:
    """Encode token rows with a model the caller supplies.

    ``make_encoder()`` runs once per Python task and returns a function
    ``(ids, mask) -> float array (n, length, width)``.  It is given rows of one length at a time, at
    most ``batch_size``; rows may differ in length.  The vector, flattened, is added to the row; it is
    null where the ids are.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        encode = make_encoder()
        for tokens, masks in parts:
            out: list = [None] * len(tokens)
            sizes = np.array([-1 if x is None else len(x) for x in tokens])
            for size in np.unique(sizes[sizes >= 0]):
                same = np.flatnonzero(sizes == size)
                for low in range(0, len(same), batch_size):
                    some = same[low : low + batch_size]
                    found = np.asarray(encode(np.stack(tokens.iloc[some].tolist()), np.stack(masks.iloc[some].tolist())), dtype=np.float32)
                    for row, vector in zip(some, found.reshape(len(some), int(size) * width)):
                        out[row] = vector
            yield pd.Series(out)

    return df.withColumn(into, run(F.col(ids), F.col(mask)))


def largest_difference(stored: Column, fresh: Column) -> Column:
    """Largest absolute difference over all rows; the check of stored vectors."""
    return F.max(F.array_max(F.zip_with(stored, fresh, lambda a, b: F.abs(a - b))))


def gaussian_sample(
    mean: Column, log_var: Column, key, seed: int, deterministic: bool = False
) -> Column:
    """Draw from a diagonal Gaussian with repeatable noise; a deterministic one has no spread."""
    if deterministic:
        return mean
    key = F.col(key) if isinstance(key, str) else key
    pair = F.arrays_zip(mean.alias("m"), log_var.alias("l"))
    return F.transform(
        pair, lambda p, i: p["m"] + F.exp(p["l"] * 0.5) * seeded.normal(seed, key, i)
    )


def sometimes_noised(vector, key: str, std: float, p: float, seed: int) -> Column:
    """Noise on every second row, and there only with probability ``p``."""
    key_col = F.col(key)
    on = (key_col % 2 == 0) & (seeded.uniform(seed, key_col) < p)
    v = F.col(vector) if isinstance(vector, str) else vector
    noisy = F.transform(v, lambda x, i: x + F.lit(std) * seeded.normal(seed + 1, key_col, i))
    return F.when(on, noisy).otherwise(v)
