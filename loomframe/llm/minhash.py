"""MinHash near-duplicates with tensored banding.

Two collections of M hashes are computed for a text, each the join of A minhashes.  A table is a
pair (i, j): its key joins hash i of the first collection and hash j of the second, so 2 * M * A
minhashes serve M * M tables of 2 * A rows each.  Texts that share a key of any table are
candidates; every candidate is settled on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import Words, flat, looked_up, mixed, settle, shingle_hashes, sized, slices
from loomframe.llm.components import components
from loomframe.operators.ordering import running_total

#: Documents of a bucket that are compared in one task at a time, with up to BLOCK shingles each on
#: average; larger buckets meet block by block.
BLOCK = 512


def _sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    words = Words(raw.copy(), offsets)
    hashes, bounds = shingle_hashes(words, size)
    for begin, end in zip(bounds[:-1], bounds[1:]):
        yield np.unique(hashes[begin:end])


def _lower(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw).astype(np.uint8)


def sketches(docs: DataFrame, key: str, text: str, size: int, rows: int, hashes: int) -> DataFrame:
    """(key, n_shingles, digest, left, right): set size, set digest and both collections' hashes."""
    seeds = mixed(np.arange(1, 4 * rows * hashes + 1, dtype=np.uint64))
    factor, shift = seeds[: 2 * rows * hashes] | np.uint64(1), seeds[2 * rows * hashes :]
    out = pa.schema([("n_shingles", pa.int64()), ("digest", pa.binary()), ("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64()))])

    def one(values: np.ndarray) -> np.ndarray:
        least = np.full(2 * rows * hashes, np.iinfo(np.uint64).max, np.uint64)
        for part in range(0, len(values), 4096):
            x = values[part : part + 4096, None]
            np.minimum(least, (x * factor + shift).min(axis=0), out=least)
        joined = np.zeros(2 * hashes, np.uint64)
        for k in range(rows):
            joined = mixed(joined * np.uint64(0x100000001B3) + least[k :: rows])
        return joined.view(np.int64)

    def run(batches):
        for part in slices(batches):
            raw, offsets = flat(part.column("text"))
            n, digest, left, right = [], [], [], []
            for values in _sets(_lower(raw), offsets, size):
                n.append(len(values))
                if len(values):
                    joined = one(values)
                    left.append(joined[:hashes])
                    right.append(joined[hashes:])
                    spread = mixed(values ^ np.uint64(0xA5A5A5A5A5A5A5A5))
                    digest.append(np.array([values.sum(), spread.sum(), np.bitwise_xor.reduce(spread * values), len(values)], np.uint64).tobytes())
                else:
                    left.append(None)
                    right.append(None)
                    digest.append(None)
            columns = [part.column("id"), pa.array(n, pa.int64()), *(pa.array(x, f.type) for x, f in zip((digest, left, right), list(out)[1:]))]
            yield pa.RecordBatch.from_arrays(columns, ["id", *out.names])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(
        run, f"id {kind}, n_shingles long, digest binary, left array<long>, right array<long>"
    )


def _roots(links: Iterator[tuple[int, int]], n: int) -> np.ndarray:
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in links:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(n)])


def linked_pairs(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Pairs (i, j), i < j, with 100 * intersection >= percent * union, by exact counts."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[0, 1]] if 100 * both >= percent * (sizes.sum() - both) else [], np.int64).reshape(-1, 2)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[column] > 1  # a shingle of one set adds to no intersection
    number = np.cumsum(counts > 1) - 1
    owner, column = owner[shared], number[column[shared]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):  # bounded memory for any set size
        lo, hi = np.searchsorted(column, [begin, begin + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[lo:hi], column[lo:hi] - begin] = 1
        both += part @ part.T
    both = np.rint(both).astype(np.int64)
    good = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    return np.argwhere(np.triu(good, 1))


def _verified(percent: int, size: int):
    """Groups of texts, in key order, to (u, v): each linked text with the least of its group's component."""

    def settle_group(ids: list, texts: list) -> tuple[list, list]:
        raw, offsets = flat(pa.array(texts, pa.large_string()))
        sets = list(_sets(_lower(raw), offsets, size))
        order = sorted(range(len(ids)), key=lambda i: tuple(ids[i].values()) if isinstance(ids[i], dict) else ids[i])
        ids, sets = [ids[i] for i in order], [sets[i] for i in order]
        root = _roots(map(tuple, linked_pairs(sets, percent).tolist()), len(ids))
        moved = [i for i in range(len(ids)) if root[i] != i]
        return [ids[i] for i in moved], [ids[root[i]] for i in moved]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, texts = None, [], []
        for part in slices(batches):
            us, vs = [], []
            rows = zip(*(part.column(c).to_pylist() for c in ("bucket", "p", "q", "id", "text")))
            for bucket, p, q, key, text in rows:
                if (bucket, p, q) != now:
                    if len(ids) > 1:
                        u, v = settle_group(ids, texts)
                        us += u
                        vs += v
                    now, ids, texts = (bucket, p, q), [], []
                ids.append(key)
                texts.append(text)
            kind = part.schema.field("id").type
            yield pa.RecordBatch.from_arrays([pa.array(us, kind), pa.array(vs, kind)], ["u", "v"])
        if len(ids) > 1:
            us, vs = settle_group(ids, texts)
            yield pa.RecordBatch.from_arrays([pa.array(us, kind), pa.array(vs, kind)], ["u", "v"])

    return run


def _keys(classes: DataFrame, hashes: int) -> DataFrame:
    """(rep, weight, bucket): the keys of the tables in which a class may meet another one.

    A class lists only hashes of either collection that a second class has too, and only from these
    are the pairs formed, so that a text without likeness takes ``2 * hashes`` rows and no more.
    """
    halves = classes.select("rep", "n_shingles", F.posexplode(F.concat("left", "right")).alias("k", "h"))
    halves = halves.select("rep", "n_shingles", "k", F.xxhash64("k", "h").alias("x"))
    shared = halves.groupBy("x").agg(F.count("*").alias("n")).filter("n > 1").select("x")
    own = halves.join(sized(settle(shared, "shared")), "x", "left_semi")
    own = own.groupBy("rep", "n_shingles").agg(F.collect_list(F.struct("k", "x")).alias("s"))  # 2 * hashes entries
    side = lambda first: F.filter("s", lambda e: (e["k"] < hashes) == F.lit(first))
    pairs = own.select("rep", "n_shingles", F.explode(side(True)).alias("a"), side(False).alias("right"))
    pairs = pairs.select("rep", "n_shingles", "a", F.explode("right").alias("b"))
    return pairs.select("rep", F.greatest("n_shingles", F.lit(BLOCK)).alias("weight"), F.xxhash64("a.x", "b.x").alias("bucket"))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 85, rows: int = 4, hashes: int = 8
) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row of ``docs``.

    Two texts are linked if 100 * intersection >= ``percent`` * union of their word shingles; the
    component is the least key that links reach.  At a similarity of 0.85, ``rows`` = 4 and
    ``hashes`` = 8 miss a pair in 200, at 0.9 one in 2,500.

    Equal sets are one class with one representative, so that thousands of copies cost one row in
    all that follows.  A bucket of more than BLOCK representatives, or fewer of large sets, is compared
    block by block, in tasks of two blocks; only each text's link to the least of its component leaves a task, never
    the pairs.  Buckets with the same members in several tables are compared once.

    Null or empty texts, and texts of white space, have no shingles and are linked with nothing.
    A row with a null key is its own: component null, kept true.  Rows that repeat a key are one
    node; all of them get its component.  Other columns are ignored, whatever their names.
    An empty table gives an empty result.
    """
    drawn = settle(sketches(docs, key, text, size, rows, hashes), "sketches")
    classes = settle(
        drawn.filter("digest is not null and id is not null").groupBy("digest").agg(
            F.min("id").alias("rep"), F.min("n_shingles").alias("n_shingles"), F.min("left").alias("left"), F.min("right").alias("right")
        ),
        "classes",
    )
    keyed = settle(_keys(classes, hashes), "keyed")
    mark = F.xxhash64("rep").cast("decimal(38,0)")
    buckets = keyed.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(mark).alias("mark"), F.sum("weight").alias("whole"))
    # buckets of the same members are compared once
    chosen = buckets.filter("n > 1").groupBy("n", "mark").agg(F.min("bucket").alias("bucket"), F.min("whole").alias("whole"))
    crowded = keyed.join(sized(settle(chosen.select("bucket", "whole"), "chosen")), "bucket")
    crowded = running_total(settle(crowded, "crowded"), ["rep"], F.col("weight"), "upto", within=["bucket"])
    blocks = F.ceil(F.col("whole") / (BLOCK * BLOCK)).cast("int")
    mine = F.floor((F.col("upto") - F.col("weight")) / (BLOCK * BLOCK)).cast("int")
    others = F.when(blocks == 1, F.array(F.lit(0))).otherwise(F.array_except(F.sequence(F.lit(0), blocks - 1), F.array(mine)))
    placed = (
        crowded.select("bucket", "rep", mine.alias("mine"), F.explode(others).alias("other"))
        .select("bucket", "rep", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"))
    )
    placed = settle(placed, "placed")
    # texts that are candidates of nothing stay where they are while the candidates' keys are few enough
    wanted = sized(settle(placed.select(F.col("rep").alias("id")).distinct(), "wanted"))
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(wanted, "id", "left_semi")
    grouped = placed.join(texts.hint("merge"), F.col("rep") == F.col("id")).select("bucket", "p", "q", "id", "text")
    kind = docs.schema[key].dataType.simpleString()
    edges = (
        grouped.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q")
        .mapInArrow(_verified(percent, size), f"u {kind}, v {kind}")
    )
    # a row that repeats a key with another text belongs to several classes: tie them by the key
    own = drawn.filter("id is not null and digest is not null").select("id", "digest").join(
        classes.select("digest", "rep"), "digest"
    )
    repeated = own.filter("id <> rep").groupBy("id").agg(F.min("rep").alias("u"), F.max("rep").alias("v")).filter("u <> v")
    chained = own.join(repeated.select("id"), "id", "left_semi").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    reached = components(edges.union(chained), "u", "v")
    named = classes.join(reached, F.col("rep") == F.col("node"), "left").select(
        "digest", F.coalesce("component", "rep").alias("component_id")
    )
    # a group of copies may be a third of all rows, and so may rows without a digest: both are spread
    rows = drawn.select("id", "n_shingles", F.coalesce("digest", F.unhex(F.hex(F.xxhash64("id")))).alias("digest"), F.col("digest").isNull().alias("none"))
    result = looked_up(rows, settle(named, "named"), "digest", "id").withColumn("digest", F.when(~F.col("none"), F.col("digest")))
    component = F.when(F.col("digest").isNull(), F.col("id")).when(F.col("id").isNotNull(), F.col("component_id"))
    return result.select(
        F.col("id").alias(key), F.col("n_shingles"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
