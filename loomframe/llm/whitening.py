"""Embedding whitening by Chebyshev-filtered subspace iteration.

The leading components of a covariance V are found without forming V.  A block Q of columns is
driven through a Chebyshev polynomial of V that damps the unwanted end of the spectrum; each step of
the polynomial's recurrence is one distributed pass that sums X'(XQ) over centred rows.  After each
filter the block is made orthonormal (QR) and rotated to Ritz vectors, until the residuals certify
the wanted ones.  Only sums of the size of Q move; rows never leave their tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import settle

#: Entries become floor(SCALE * c); beyond LIMIT they don't fit in a long and count as non-finite.
SCALE, LIMIT = 256, 2.0**62
#: Columns of the block besides the wanted ones, most steps of a filter, and what it may part the block's ends by.
SPARE, STEPS, GROWTH = 28, 40, 1e9
#: Certified when the residual is below this share of the gap to its neighbours, or of the largest value;
#: one that no longer falls is accepted below ROUNDING, as sums of doubles give no more.
ANGLE, FLOOR, ROUNDING = 1e-12, 4e-15, 1e-12
#: A component whose eigenvalue is below this share of the trace has no variance but rounding.
NOTHING = 1e-13
PASSES = 5_000


def usable(vector: Column, length: int | None = None) -> Column:
    """Whether the vector has no null, non-finite or too large entry (and so many entries)."""
    fine = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) * SCALE < LIMIT))
    fine = vector.isNotNull() & F.coalesce(fine, F.lit(False))
    return fine if length is None else fine & (F.size(vector) == length)


def quantised(vector: Column) -> Column:
    """array<long> of floor(256 * c)."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE))


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch with its column x as a matrix of longs."""
    for batch in batches:
        yield batch, batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _summed(rows: DataFrame, width: int, size: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of ``part`` (matrix of a batch -> ``size`` doubles), combined by Spark.

    A task sends ``size`` numbers, which are added place by place; as many come to the driver.
    """
    def run(batches):
        total = np.zeros(size)
        for _, x in _matrices(batches, width):
            total += part(x).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["at", "value"])

    sums = rows.select("x").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
    out = np.zeros(size)
    for r in sums.collect():  # ``size`` rows
        out[r.at] = r.value
    return out


def _exact_sums(rows: DataFrame, width: int) -> list[int]:
    """Sum of each dimension, exact at any size."""
    def run(batches):
        total = [0] * width
        for _, x in _matrices(batches, width):
            safe = not len(x) or int(np.abs(x).max()) * len(x) < 2**62
            total = [t + int(s) for t, s in zip(total, x.sum(axis=0) if safe else x.astype(object).sum(axis=0))]
        values = pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int64()), values], ["at", "value"])

    sums = rows.select("x").mapInArrow(run, "at long, value decimal(38,0)").groupBy("at").agg(F.sum("value").alias("value"))
    out = [0] * width
    for r in sums.collect():  # ``width`` rows
        out[r.at] = int(r.value)
    return out


@dataclass
class Whitening:
    """A fitted whitening: counts, exact sums, components by columns with their eigenvalues."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def projection(self) -> np.ndarray:
        """Columns that project centred rows on whitened coordinates; NaN where there is no variance."""
        safe = np.where(self.values > NOTHING * self.trace, self.values, np.nan)
        return self.components / np.sqrt(safe)


def _orthonormal(block: np.ndarray) -> np.ndarray:
    return np.linalg.qr(block)[0]


def _ritz(basis: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values (falling), their vectors and V times the vectors, from an orthonormal basis."""
    small = basis.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    turn = turn[:, ::-1]
    return values[::-1], basis @ turn, image @ turn


def leading(times: Callable[[np.ndarray], np.ndarray], width: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the ``wanted`` largest eigenvalues of the operator ``times``.

    The unwanted interval is from zero to the smallest Ritz value of the block, which has SPARE
    columns more than wanted.  Certified vectors are locked: the block stays orthogonal to them, and
    they no longer hold back the degree, which is chosen so that a filter parts the block's ends by
    GROWTH at most.  The start is seeded, so that runs repeat.
    """
    size, passes = min(width, wanted + SPARE), 1
    basis = _orthonormal(np.random.default_rng(width).standard_normal((width, size)))
    values, vectors, images = _ritz(basis, times(basis))
    largest, last, done = max(float(values[0]), 0.0), np.inf, 0
    while True:
        rest = np.linalg.norm(images - vectors * values, axis=0)
        beside = np.abs(np.diff(values, append=0.0))  # to the next value; to the one before
        gap = np.minimum(beside, np.append(np.inf, beside[:-1]))
        fine = (rest <= ANGLE * gap) | (rest <= FLOOR * largest)
        while done < wanted and fine[done]:
            done, last = done + 1, np.inf
        worst = float(rest[done:wanted].max(initial=0))
        if done == wanted or size == width or last / 2 < worst <= ROUNDING * largest:
            return values[:wanted], vectors[:, :wanted]  # certified, whole, or as near as rounding allows
        if passes > PASSES:
            raise ArithmeticError("the components weren't certified")
        last = worst
        locked, half = vectors[:, :done], max(float(values[-1]), 1e-300) / 2
        top = max((float(values[done]) - half) / half, 1 + 1e-12)
        steps = int(np.clip(np.log(2 * GROWTH) / np.arccosh(top), 1, STEPS))
        # scaled so that the filter is one at the block's largest value: no step can overflow
        sigma = first = 1 / top
        old, new = vectors[:, done:], (images[:, done:] - half * vectors[:, done:]) * (sigma / half)
        for _ in range(steps - 1):
            turn = 1 / (2 / first - sigma)
            old, new = new, (times(new) - half * new) * (2 * turn / half) - old * (sigma * turn)
            new -= locked @ (locked.T @ new)
            sigma = turn
        basis = _orthonormal(np.column_stack([locked, new]))[:, done:]
        found = _ritz(basis, times(basis))
        passes += steps
        values = np.concatenate([values[:done], found[0]])
        vectors, images = (np.column_stack([a[:, :done], b]) for a, b in ((vectors, found[1]), (images, found[2])))


def fit(rows: DataFrame, width: int, wanted: int = 4) -> Whitening:
    """Whitening of the settled table ``rows`` (x array<long>, ``width`` entries each, no two equal)."""
    n, sums = rows.count(), _exact_sums(rows, width)
    mean, passes = np.array([s / max(n, 1) for s in sums]), 0

    def times(block: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def part(x):
            centred = x - mean
            return centred.T @ (centred @ block)

        return _summed(rows, width, block.size, part).reshape(block.shape) / n

    trace = float(_summed(rows, width, 1, lambda x: np.square(x - mean).sum())[0]) / max(n, 1)
    wanted = min(wanted, width)
    if not trace > 0:  # one vector, or none
        return Whitening(n, sums, np.eye(width)[:, :wanted], np.zeros(wanted), 0.0, 0.0, 0)
    values, vectors = leading(times, width, wanted)
    out = Whitening(n, sums, vectors, np.maximum(values, 0), trace, 0.0, passes)
    used = ~np.isnan(out.projection[0])
    projection = out.projection[:, used]

    def moments(x):
        white = (x - mean) @ projection
        return np.concatenate([white.sum(axis=0), (white.T @ white).reshape(-1)])

    k = projection.shape[1]
    got = _summed(rows, width, k + k * k, moments) / n
    covariance = got[k:].reshape(k, k) - np.outer(got[:k], got[:k])
    out.identity_error = float(np.abs(covariance - np.eye(k)).max()) if k else 0.0
    return out


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", wanted: int = 4) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error), ``wanted`` rows a vector.

    Vectors that are null or hold null or non-finite entries are left out, also entries whose 256-fold
    is beyond a long.  Of vectors of several lengths those of the most frequent length count (the
    longest of ties), others are left out.  With fewer dimensions than ``wanted`` there are as many
    components.  A component without variance has whitened null and explained 0; a deviation beyond a
    long is null.  Null and repeated keys stay, other columns are ignored, an empty table or vectors
    of no entries give an empty result.  Equal eigenvalues leave the choice of their vectors open.
    """
    spark = table.sparkSession
    kind = table.schema[key].dataType.simpleString()
    shape = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    source = table.select(F.col(key).alias("id"), F.col(vector).alias("v"))
    lengths = source.filter(usable(F.col("v"))).groupBy(F.size("v").alias("width")).count()
    commonest = lengths.orderBy(F.desc("count"), F.desc("width")).first()
    if commonest is None or not commonest.width:
        return spark.createDataFrame([], shape)
    width = commonest.width
    rows = source.filter(usable(F.col("v"), width)).select("id", quantised(F.col("v")).alias("x"))
    # equal vectors meet after each task has dropped its own repeats, so that a hot one is no burden
    fitted = fit(settle(rows.select("x").distinct(), "vectors"), width, wanted)
    shipped = spark.sparkContext.broadcast(fitted)

    def run(batches):
        white = shipped.value
        projection, mean, n, sums = white.projection, white.mean, white.n, np.array(white.sums, object)
        k = projection.shape[1]
        explained = white.values / white.trace if white.trace else np.zeros(k)
        most = max(map(abs, white.sums))
        for batch, x in _matrices(batches, width):
            scores = (x - mean) @ projection
            reach = n * int(np.abs(x).max(initial=0)) + most
            if width * reach * reach < 2**63:
                deviation = np.square(x * n - sums.astype(np.int64)).sum(axis=1)
            else:
                deviation = [int(d) if d < 2**63 else None for d in np.square(x.astype(object) * n - sums).sum(axis=1)]
            m = len(x)
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, n)), pa.array(deviation, pa.int64()).take(pa.array(each)),
                    pa.array(scores.reshape(-1), pa.float64(), from_pandas=True), pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, white.identity_error)),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    shape = shape.replace(f"`{key}`", "id", 1)
    return rows.mapInArrow(run, shape).withColumnRenamed("id", key)
