"""Toxicity by a classifier chain.

Categories are predicted in order.  Each has a linear model over word features and the
probabilities of the categories before it.  In training these probabilities are out of fold: each
comes from a model that hasn't seen the document, as will be the case in prediction.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomframe.llm.common import Words, below, flat, settle, slices

#: Labelled documents that a fit reads at most; they are chosen by a hash of their key.
SAMPLE = 6_000
#: Distinct words and word beginnings that the sampled documents have in all at most.
MENTIONS = 8_000_000
FOLDS = 3
#: A word becomes a feature while what the model doesn't explain differs by so many standard errors
#: among its documents; up to NEW words enter in each of ROUNDS rounds.
APART, NEW, ROUNDS = 6.0, 48, 10
#: Words in fewer sampled documents carry no weight.
LEAST_DOCS = 4


def _lowered(raw: np.ndarray) -> np.ndarray:
    """ASCII letters lower-cased and kept, with digits and bytes of other scripts; the rest is blank."""
    table = np.full(256, 32, np.uint8)
    for b in range(256):
        if b >= 128 or chr(b).isalnum():
            table[b] = b + 32 if 65 <= b <= 90 else b
    return table[raw]


def word_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text and of their beginnings, and the bounds of each run."""
    raw, offsets = flat(texts)
    words = Words(_lowered(raw), offsets)
    each = np.stack([words.hashes, words.prefixes(4), words.prefixes(6)], axis=1)
    return each.reshape(-1).view(np.int64), words.bounds * 3


def presence(hashes: np.ndarray, bounds: np.ndarray, features: np.ndarray) -> np.ndarray:
    """(texts, features) 0/1: which of the sorted ``features`` each text has."""
    out = np.zeros((len(bounds) - 1, len(features)))
    if len(features) and len(hashes):
        at = np.minimum(np.searchsorted(features, hashes), len(features) - 1)
        hit = np.flatnonzero(features[at] == hashes)
        out[np.searchsorted(bounds, hit, side="right") - 1, at[hit]] = 1
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_linear(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regression by Newton steps: the bias, then a weight for each column of ``x``."""
    design = np.column_stack([np.ones(len(y)), x])
    weights, n = np.zeros(design.shape[1]), max(1, len(y))
    if not y.sum():  # nothing is known of such documents
        weights[0] = -20
        return weights
    penalty = np.full(len(weights), ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = _sigmoid(design @ weights)
        slope = design.T @ (p - y) / n + penalty * weights
        curve = (design * (p * (1 - p) / n)[:, None]).T @ design + np.diag(penalty)
        move = np.linalg.solve(curve, slope)
        weights -= move * min(1, 2 / max(1e-12, np.abs(move).max()))
        if np.abs(move).max() < 1e-6:
            break
    return weights


def fit_words(at: np.ndarray, bounds: np.ndarray, width: int, before: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, weights): words are taken in by the score test of what is still unexplained.

    ``at`` has the numbers (below ``width``) of each row's words, ``bounds`` the rows' runs.
    """
    owner = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(bounds))
    enough = np.bincount(at, minlength=width) >= LEAST_DOCS
    features = np.zeros(0, np.int64)
    weights = fit_linear(before, y)
    for _ in range(ROUNDS if 0 < y.sum() < len(y) else 0):
        p = _sigmoid(weights[0] + np.column_stack([presence(at, bounds, features), before]) @ weights[1:])
        score = np.bincount(at, (y - p)[owner], width)
        score = np.abs(score) / np.sqrt(np.bincount(at, (p * (1 - p))[owner], width) + 1e-12) * enough
        score[features] = 0
        best = np.lexsort((np.arange(width), -score))[:NEW]
        best = best[score[best] >= APART]
        if not len(best):
            break
        features = np.sort(np.concatenate([features, best]))
        weights = fit_linear(np.column_stack([presence(at, bounds, features), before]), y)
    return features, weights


@dataclass
class Chain:
    """A fitted chain: for each category its sorted features and its weights, in order."""

    names: list[str]
    models: list[tuple[np.ndarray, np.ndarray]]

    def predict(self, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(texts, categories) probabilities; earlier ones are features of later ones."""
        out = np.zeros((len(bounds) - 1, len(self.names)))
        for k, (features, weights) in enumerate(self.models):
            x = np.column_stack([presence(hashes, bounds, features), out[:, :k]])
            out[:, k] = _sigmoid(weights[0] + x @ weights[1:])
        return out


def fit_chain(at: np.ndarray, bounds: np.ndarray, hashes: np.ndarray, labels: np.ndarray, names: list[str], folds: np.ndarray) -> Chain:
    """Fit a chain on rows of distinct words, given by their numbers ``at`` among the sorted ``hashes``,
    and ``labels`` (rows, categories)."""
    before, models = np.zeros((len(labels), 0)), []

    def fit(which: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """On the rows that ``which`` marks."""
        sizes = np.diff(bounds)
        own = np.concatenate([[0], np.cumsum(sizes[which])])
        return fit_words(at[np.repeat(which, sizes)], own, len(hashes), before[which], y[which])

    for k in range(len(names)):
        y, unseen = labels[:, k], np.zeros(len(labels))
        features, weights = fit(np.ones(len(labels), bool), y)
        models.append((hashes[features], weights))
        for fold in np.unique(folds):
            features, weights = fit(folds != fold, y)
            out = folds == fold
            x = np.column_stack([presence(at, bounds, features), before])[out]
            unseen[out] = _sigmoid(weights[0] + x @ weights[1:])
        before = np.column_stack([before, unseen])
    return Chain(names, models)


def train(docs: DataFrame, labels: DataFrame, categories: dict, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, mentions: int = MENTIONS) -> Chain:
    """A chain fitted on at most ``sample`` labelled documents, chosen by a hash of their key.

    ``categories`` maps names, in the chain's order, to SQL conditions over ``labels``; null counts
    as false.  Words are counted by Spark over the sample; only those of LEAST_DOCS documents come to
    the driver, as 4-byte numbers.  The documents have ``mentions`` distinct words in all at most, in the
    order of the hash, so that the driver holds 4 * ``mentions`` bytes of them whatever the texts; one
    with over 1/64 of that isn't used for fitting.
    """
    names = list(categories)
    marks = F.array(*[F.coalesce(F.expr(c).cast("int"), F.lit(0)) for c in categories.values()])
    # a key that labels repeat counts once: a category holds if any of its rows says so
    known = labels.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.posexplode(marks).alias("k", "y"))
    known = known.groupBy("id").agg(*[F.max(F.when(F.col("k") == i, F.col("y"))).alias(f"y{i}") for i in range(len(names))])
    chosen = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    # the sample's size is known before texts move: ids first, then their texts
    some = chosen.select("id").join(known, "id").filter(below(F.col("id"), sample, known.count()))
    some = some.dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(sample)

    def words(batches):
        for part in slices(batches):
            hashes, bounds = word_features(part.column("text"))
            rows = pa.array([np.unique(hashes[a:b]) for a, b in zip(bounds, bounds[1:])], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("turn", "labels", "fold")), rows], ["turn", "labels", "fold", "places"])

    ready = chosen.join(F.broadcast(some), "id").select(
        "text", F.sha2(F.concat_ws(":", F.xxhash64("id"), F.sha2(F.col("text").cast("binary"), 256)), 256).alias("turn"),
        F.array(*[f"y{i}" for i in range(len(names))]).alias("labels"),
        F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold"),
    )
    rows = settle(ready.mapInArrow(words, "turn string, labels array<int>, fold int, places array<long>"), "sampled")
    sizes = rows.select("turn", F.size("places").alias("n")).filter(F.col("n") <= mentions // 64)
    so_far = Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)  # ``sample`` narrow rows or so
    used = sizes.withColumn("total", F.sum("n").over(so_far)).filter(F.col("total") <= mentions).select("turn").distinct()
    rows = rows.join(F.broadcast(used), "turn")
    seen = rows.select(F.explode("places").alias("p")).groupBy("p").agg(F.count("*").alias("docs")).filter(F.col("docs") >= LEAST_DOCS)
    hashes = np.sort(seen.select("p").toArrow().column("p").to_numpy())  # mentions / LEAST_DOCS at most

    def numbers(batches):
        for part in batches:
            places = part.column("places")
            values, cuts = places.values.to_numpy(), places.offsets.to_numpy()
            spot = np.searchsorted(hashes, values).astype(np.int32)
            hit = hashes[np.minimum(spot, len(hashes) - 1)] == values if len(hashes) else np.zeros(len(values), bool)
            cuts = np.concatenate([[0], np.cumsum(hit)])[cuts]
            first, last = cuts[0], cuts[-1]
            kept = pa.ListArray.from_arrays(pa.array(cuts - first, pa.int32()), pa.array(spot[hit][first:last]))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("turn", "labels", "fold")), kept], ["turn", "labels", "fold", "places"])

    # in an order that doesn't depend on partitions
    got = rows.mapInArrow(numbers, "turn string, labels array<int>, fold int, places array<int>").orderBy("turn").drop("turn").toArrow()
    y = np.array(got.column("labels").to_pylist(), float).reshape(-1, len(names))
    folds = np.array(got.column("fold").to_pylist(), int)
    places = got.column("places").combine_chunks()
    at, bounds = np.array(places.flatten()), np.array(places.offsets, np.int64)
    del got, places
    return fit_chain(at, bounds - bounds[0], hashes, y, names, folds)


def scored(docs: DataFrame, chain: Chain, reject: list[str], key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(key, p_<category> ..., kept) for every row of ``docs``.

    A document is rejected (``kept`` false) if the probability of a category of ``reject`` is at
    least ``threshold``.  A text without words, null or empty ones too, has probabilities of 0 and is
    kept.  Whole texts count.  Null and repeated keys stay as they are, other columns are ignored,
    and an empty table gives an empty result.  A chain fitted without labels keeps everything.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(chain)
    columns = [f"p_{n}" for n in chain.names]
    which = [chain.names.index(n) for n in reject]

    def run(batches):
        chain = shipped.value
        for part in slices(batches):
            hashes, bounds = word_features(part.column("text"))
            odds = chain.predict(hashes, bounds) * (np.diff(bounds) > 0)[:, None]
            kept = ~(odds[:, which] >= threshold).any(axis=1)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), *(pa.array(odds[:, k]) for k in range(odds.shape[1])), pa.array(kept)], ["id", *columns, "kept"]
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, {', '.join(f'`{c}` double' for c in columns)}, kept boolean").withColumnRenamed("id", key)
