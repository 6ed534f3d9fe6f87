"""Helpers of the text operators: settled tables, words of an Arrow batch as flat arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.session import materialise

# The white space of the contracts, [\x20\x09-\x0D].
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
UPPER_TO_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

#: Texts are worked on in slices of about so many bytes, which bounds the arrays made from them.
SLICE_BYTES = 1 << 18


def settle(df: DataFrame, stem: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later steps don't compute it again."""
    return materialise(df, stem)


#: A settled table is broadcast up to so many bytes, counted as BROADCAST_CELL bytes a value.
BROADCAST_BYTES, BROADCAST_CELL = 64 << 20, 40


def sized(df: DataFrame) -> DataFrame:
    """A settled narrow table with a hint: broadcast if its counted size allows, else merged by key.

    The choice rests on this count alone, so that the other side, which may hold texts, isn't
    shuffled at one size of the input and broadcast to at another without need.
    """
    fits = df.count() * len(df.columns) * BROADCAST_CELL <= BROADCAST_BYTES
    return F.broadcast(df) if fits else df.hint("merge")


def looked_up(rows: DataFrame, table: DataFrame, key: str, spread: str, copies: int = 16) -> DataFrame:
    """``rows`` left-joined with a settled table of unique keys, which any share of the rows may hold.

    The table is broadcast if its counted size allows; else each of its rows has ``copies``, and a row
    asks the one that a hash of its column ``spread`` names, so that a hot key is met by many tasks.
    """
    if table.count() * len(table.columns) * BROADCAST_CELL <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), key, "left")
    each = table.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    asked = rows.withColumn("__copy", F.pmod(F.xxhash64(spread), F.lit(copies)).cast("int"))
    return asked.join(each.hint("merge"), [key, "__copy"], "left").drop("__copy")


def below(key: Column, wanted: int, of: int) -> Column:
    """Rows for a sample of ``wanted`` among ``of``: a hash of the key under a cut that passes about
    twice as many, so that sorting and limiting them moves a bounded number of rows."""
    share = 2.0 * (wanted + 50) / max(1, of)
    cut = min(2.0**63 - 2**11, -(2.0**63) + share * 2.0**64)
    return F.xxhash64(key) <= F.lit(int(cut))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut by rows so that a slice has about ``most`` bytes of text, one row at least."""
    for batch in batches:
        size = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0)
        ends = np.cumsum(size.to_numpy(zero_copy_only=False))
        begin, n = 0, batch.num_rows
        while begin < n:
            base = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end
    pa.default_memory_pool().release_unused()  # the worker lives on


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column as one array, and the n+1 offsets of its rows; null is empty."""
    column = pa.compute.fill_null(column.cast(pa.large_string()), "")
    # taking it anew drops what a slice doesn't show
    column = pa.concat_arrays([column, pa.array([""], pa.large_string())])
    n = len(column) - 1
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of many texts: byte spans, the text each is in, and a 64-bit hash of its bytes."""

    _step = 0x9E3779B97F4A7C15
    _up = np.ones(1, np.uint64)
    _down = np.ones(1, np.uint64)
    _codes = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        n = len(raw)
        inside = ~SPACE[raw]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: words of text i are those from bounds[i] to bounds[i + 1]
        self.bounds = np.searchsorted(self.starts, offsets)
        self._sum(raw)
        self.hashes = self._between(self.ends)

    def prefixes(self, size: int) -> np.ndarray:
        """Hashes of the first ``size`` bytes of each word, other ones than those of whole words."""
        return mixed(self._between(np.minimum(self.ends, self.starts + size)) + np.uint64(size))

    def _sum(self, raw: np.ndarray) -> None:
        cls, n = type(self), len(raw)
        if len(cls._up) < n + 1:
            size = max(n + 1, SLICE_BYTES + 1)
            step, back = np.full(size, cls._step, np.uint64), np.full(size, pow(cls._step, -1, 1 << 64), np.uint64)
            step[0] = back[0] = 1
            cls._up, cls._down = np.multiply.accumulate(step), np.multiply.accumulate(back)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(cls._codes[raw] * cls._up[:n], out=total[1:])
        self._total = total

    def _between(self, ends: np.ndarray) -> np.ndarray:
        return mixed((self._total[ends] - self._total[self.starts]) * self._down[self.starts])


def shingle_hashes(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of each text, and the bounds of each text's run.

    A text with fewer words has one shingle, its whole sequence; one without words has none.
    """
    counts = np.diff(words.bounds)
    shingles = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(shingles)])
    # where each shingle begins among the words
    at = np.arange(bounds[-1]) + np.repeat(words.bounds[:-1] - bounds[:-1], shingles)
    stop = np.repeat(words.bounds[1:], shingles)
    padded = np.concatenate([words.hashes, np.zeros(size, np.uint64)])
    h = np.zeros(len(at), np.uint64)
    for k in range(size):
        one = padded[at + k]
        if k:
            one = np.where(at + k < stop, one, np.uint64(0x5BD1E995))  # beyond a short text
        h = h * np.uint64(0xC2B2AE3D27D4EB4F) + one
    return mixed(h), bounds
