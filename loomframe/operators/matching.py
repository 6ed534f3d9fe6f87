"""Nearest and most similar vectors, exactly, for tables of any size.

One kernel compares left and right vectors in tiles of bounded bytes.  A matrix
product rules out all but the closest few of a tile; those are settled by their
exact cost and then by the lower code, so neither the tiling nor the way the rows
met changes a result.  Right vectors up to a number of bytes are shipped to the
workers; blocks of a larger table meet slices of the left one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.functions.arrays import doubles

#: Bytes of one tile of costs in a task.
TILE_BYTES = 32 << 20
#: Right vectors of up to so many bytes are shipped; larger tables are cut into blocks of this size.
SHIP_BYTES = 64 << 20


def matrix(column) -> np.ndarray:
    """A list column of equal lengths as a 2-D float64 array, without copies per row."""
    chunk = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = chunk.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = len(chunk)
    if rows == 0:
        return flat.reshape(0, 0)
    if chunk.null_count or flat.size % rows or len(set(np.diff(chunk.offsets.to_numpy()))) > 1:
        raise ValueError("vectors must be present and of one length")
    if not np.isfinite(flat).all():
        raise ValueError("vectors must be finite")
    return flat.reshape(rows, -1)


def list_array(values: np.ndarray) -> pa.Array:
    """A 2-D array as a list column."""
    rows, width = values.shape
    offsets = np.arange(rows + 1, dtype=np.int32) * width
    return pa.ListArray.from_arrays(offsets, np.ascontiguousarray(values).ravel())


def unit(values: np.ndarray) -> np.ndarray:
    """Rows of length one; a zero row stays zero and so is similar to nothing."""
    size = np.sqrt((values * values).sum(1, keepdims=True))
    return values / np.where(size == 0, 1.0, size)


def least(
    z: np.ndarray, e: np.ndarray, codes: np.ndarray, k: int, cosine: bool = False,
    tile_bytes: int = TILE_BYTES,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` right rows of least cost for every left row: row numbers, codes and costs, in order.

    The cost is the squared distance, or with ``cosine`` the negative similarity.
    """
    if cosine:
        z, e = unit(z), unit(e)
    width = max(1, z.shape[1], e.shape[1])
    left_step = max(1, min(4096, tile_bytes // (8 * width)))
    right_step = max(1, tile_bytes // (8 * max(left_step, width)))
    parts = [
        _least_of(z[at : at + left_step], e, codes, k, cosine, right_step, tile_bytes // (8 * width) + 1, at)
        for at in range(0, len(z), left_step)
    ]
    none = (np.zeros(0, np.int64), np.zeros(0, codes.dtype), np.zeros(0))
    return tuple(np.concatenate(column) for column in zip(none, *parts))


def _least_of(z, e, codes, k, cosine, right_step, pair_step, first):
    rows, found, costs = np.zeros(0, np.int64), np.zeros(0, codes.dtype), np.zeros(0)
    bound = np.full(len(z), np.inf)
    for at in range(0, len(e), right_step):
        tile = e[at : at + right_step]
        rough, slack = _rough(z, tile, cosine)
        limit = bound + slack
        if len(tile) > k:
            limit = np.minimum(limit, np.partition(rough, k - 1, axis=1)[:, k - 1] + slack)
        left, right = np.nonzero(rough <= limit[:, None])
        exact = np.concatenate([np.zeros(0)] + [
            _exact(z[left[p : p + pair_step]], tile[right[p : p + pair_step]], cosine)
            for p in range(0, len(left), pair_step)
        ])
        rows, found = np.concatenate([rows, left]), np.concatenate([found, codes[at + right]])
        costs = np.concatenate([costs, exact])
        order = np.lexsort((found, costs, rows))
        rows, found, costs = rows[order], found[order], costs[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        bound[rows[rank == k - 1]] = costs[rank == k - 1]
        rows, found, costs = rows[rank < k], found[rank < k], costs[rank < k]
    return rows + first, found, costs


def _rough(z: np.ndarray, e: np.ndarray, cosine: bool) -> tuple[np.ndarray, np.ndarray]:
    """Costs by matrix product, and twice the most that each row's may be wrong by."""
    unsure = 16 * (z.shape[1] + 4) * np.finfo(float).eps
    if cosine:
        return -(z @ e.T), np.full(len(z), unsure)
    centre = e.mean(0)
    z, e = z - centre, e - centre
    zz, ee = (z * z).sum(1), (e * e).sum(1)
    return zz[:, None] + ee[None, :] - 2.0 * (z @ e.T), unsure * (zz + ee.max())


def _exact(z: np.ndarray, e: np.ndarray, cosine: bool) -> np.ndarray:
    return -(z * e).sum(1) if cosine else ((z - e) ** 2).sum(1)


def measured(df: DataFrame, vector: str) -> tuple[int, int]:
    """Rows of a vector table and the bytes of one vector."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("width")).first()
    return row["n"], 8 * max(1, row["width"] or 1)


def shippable(right: DataFrame, ship_bytes: int = SHIP_BYTES, vector: str = "e") -> bool:
    """Whether a vector table is small enough, in bytes, to be sent to every worker."""
    rows, size = measured(right, vector)
    return rows * size <= ship_bytes


def _shipped(right: DataFrame):
    """``code`` and ``e`` of a table of checked size, broadcast."""
    table = right.select(F.col("code").cast("long").alias("code"), doubles("e").alias("e")).toArrow()
    codes = table["code"].to_numpy()
    return right.sparkSession.sparkContext.broadcast((codes, matrix(table["e"])))


def _in_blocks(
    left: DataFrame, right: DataFrame, key: str, vector: str, block_bytes: int, block_rows: int,
    meet: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType,
) -> DataFrame:
    """``meet`` of every slice of the left table with every block of the right one."""

    def pieces(df: DataFrame, column: str) -> int:
        rows, size = measured(df, column)
        return max(1, -(-rows // max(1, min(block_rows, block_bytes // size))))

    blocks, slices = pieces(right, "e"), pieces(left, vector)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    a = left.select(
        F.col(key).alias("k"), doubles(vector).alias("z"),
        part(key, slices).alias("slice"), each(blocks).alias("block"),
    )
    b = right.select(
        F.col("code").cast("long").alias("code"), doubles("e").alias("e"),
        part("code", blocks).alias("block"), each(slices).alias("slice"),
    )
    return a.groupBy("slice", "block").cogroup(b.groupBy("slice", "block")).applyInArrow(meet, schema)


def closest(
    left: DataFrame, right: DataFrame, k: int, key: str = "id", vector: str = "z",
    cosine: bool = False, ship_bytes: int = SHIP_BYTES, tile_bytes: int = TILE_BYTES,
    keep_vector: bool = False,
) -> DataFrame:
    """The ``k`` right vectors (``code``, ``e``) of least cost for every left one.

    Rows ``(key, code, cost, rank)``, ranks from 1, ties to the lower code.  ``key``
    must be unique.  An empty right table gives no rows.
    """
    kind = left.schema[key]
    found = [
        T.StructField("code", T.LongType()), T.StructField("cost", T.DoubleType()),
        T.StructField("rank", T.LongType()),
    ]

    def ranked(z: np.ndarray, codes: np.ndarray, e: np.ndarray):
        rows, best, costs = least(z, e, codes, k, cosine, tile_bytes)
        return rows, [pa.array(best), pa.array(costs), pa.array(np.arange(len(rows)) - np.searchsorted(rows, rows) + 1)]

    if shippable(right, ship_bytes):
        shared = _shipped(right)
        columns = [key, vector] if keep_vector else [key]

        def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                if part.num_rows:
                    rows, best = ranked(matrix(part.column(1)), *shared.value)
                    own = [part.column(n).take(pa.array(rows)) for n in range(len(columns))]
                    yield pa.RecordBatch.from_arrays([*own, *best], names=[*columns, "code", "cost", "rank"])

        schema = T.StructType([left.schema[c] for c in columns] + found)
        return left.select(key, vector).mapInArrow(scan, schema)

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        z, e = matrix(a["z"]), matrix(b["e"])
        rows, best = ranked(z, b["code"].to_numpy(), e) if len(z) and len(e) else ([], [[], [], []])
        own = a["k"].take(pa.array(rows, pa.int64()))
        types = [own.type, pa.int64(), pa.float64(), pa.int64()]
        return pa.table([pa.chunked_array(own.chunks, own.type), *[pa.array(c, t) for c, t in zip(best, types[1:])]],
                        names=["k", "code", "cost", "rank"])

    schema = T.StructType([T.StructField("k", kind.dataType), *found])
    by = Window.partitionBy("k").orderBy("cost", "code")
    merged = (
        _in_blocks(left, right, key, vector, ship_bytes, 1 << 30, meet, schema)
        .withColumn("rank", F.row_number().over(by).cast("long"))
        .filter(F.col("rank") <= k)
        .withColumnRenamed("k", key)
    )
    return left.select(key, vector).join(merged, key) if keep_vector else merged


def nearest_code(
    vectors: DataFrame, codebook: DataFrame, key: str = "id", vector: str = "z",
    ship_bytes: int = SHIP_BYTES, tile_bytes: int = TILE_BYTES, keep_vector: bool = False,
) -> DataFrame:
    """Nearest codebook entry of every vector: ``code`` and squared ``dist``."""
    found = closest(vectors, codebook, 1, key, vector, False, ship_bytes, tile_bytes, keep_vector)
    return found.withColumnRenamed("cost", "dist").drop("rank")


def top_matches(
    left: DataFrame, right: DataFrame, k: int, key: str = "id", vector: str = "z",
    ship_bytes: int = SHIP_BYTES, tile_bytes: int = TILE_BYTES,
) -> DataFrame:
    """The ``k`` most similar right vectors of each left vector: ``code``, ``score`` and ``rank``."""
    found = closest(left, right, k, key, vector, True, ship_bytes, tile_bytes)
    return found.select(key, "code", (-F.col("cost")).alias("score"), "rank")


def similarity(
    left: DataFrame, right: DataFrame, scale: float = 0.0, key: str = "id", vector: str = "z",
    ship_bytes: int = SHIP_BYTES, part_rows: int = 2048,
) -> DataFrame:
    """Scaled cosine similarity of every left vector to all right vectors.

    Rows ``(key, codes, logits)``: the lists of a left vector are cut into rows of
    about ``part_rows`` right vectors, so no list grows with the table.  Rows per
    right item come from swapping the two tables.
    """
    kind, factor = left.schema[key], float(np.exp(scale))
    lists = [T.StructField("codes", T.ArrayType(T.LongType())), T.StructField("logits", T.ArrayType(T.DoubleType()))]

    def scored(z: np.ndarray, codes: np.ndarray, e: np.ndarray) -> list[pa.Array]:
        logits = unit(z) @ (unit(e) * factor).T
        return [list_array(np.broadcast_to(codes, logits.shape)), list_array(logits)]

    if shippable(right, ship_bytes):
        shared = _shipped(right)

        def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes, e = shared.value
            for part in parts:
                for at in range(0, part.num_rows, part_rows):
                    some = part.slice(at, part_rows)
                    z = matrix(some.column(1))
                    for low in range(0, len(e), part_rows):
                        both = scored(z, codes[low : low + part_rows], e[low : low + part_rows])
                        yield pa.RecordBatch.from_arrays([some.column(0), *both], names=[key, "codes", "logits"])

        return left.select(key, vector).mapInArrow(scan, T.StructType([kind, *lists]))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            a = a.slice(0, 0)
            none = pa.array([], pa.list_(pa.int64())), pa.array([], pa.list_(pa.float64()))
            return pa.table([a["k"], *none], names=["k", "codes", "logits"])
        return pa.table([a["k"], *scored(matrix(a["z"]), b["code"].to_numpy(), matrix(b["e"]))],
                        names=["k", "codes", "logits"])

    schema = T.StructType([T.StructField("k", kind.dataType), *lists])
    met = _in_blocks(left, right, key, vector, ship_bytes, part_rows, meet, schema)
    return met.withColumnRenamed("k", key)
