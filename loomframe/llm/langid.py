"""Language identification by a bidirectional gated recurrent network over bytes.

Two GRUs read the bytes of a piece of text in both directions; at every position their states give
a distribution over the labels, and the mean over all positions of all pieces is the document's.
The network is trained in numpy by backpropagation through time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.llm.common import below, flat, slices

#: Units of each direction, and bytes that are read in one go; every byte of a text is in one piece.
UNITS, PIECE = 4, 128
#: Bytes of labelled texts that training reads at most, whole texts chosen by a hash of their key.
SAMPLE_BYTES = 1_000_000
_PARTS = 3


@dataclass
class Network:
    """Weights of both directions (byte table, recurrent matrix) and of the output layer."""

    labels: list[str]
    table: np.ndarray  # (2, 256, 3 * UNITS): what a byte adds to both gates and the candidate
    recurrent: np.ndarray  # (2, 3 * UNITS, UNITS)
    output: np.ndarray  # (labels, 2 * UNITS)
    bias: np.ndarray

    @classmethod
    def fresh(cls, labels: list[str], seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls(
            labels, draw(2, 256, 3 * UNITS, scale=0.3), draw(2, 3 * UNITS, UNITS, scale=0.3),
            draw(len(labels), 2 * UNITS, scale=0.3), np.zeros(len(labels), np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.table, self.recurrent, self.output, self.bias]

    def states(self, data: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """(steps, 2 * UNITS, pieces) states over data (steps, pieces); ``keep`` also returns the gates.

        With z, r the update and reset gates and c the candidate: h' = h + z * (c - h), where c sees
        the reset state through its recurrent weights.  Gates use tanh, sigmoid(x) = (1 + tanh(x / 2)) / 2.
        """
        steps, n = data.shape
        out, gates = np.empty((steps, 2 * UNITS, n), np.float32), []
        for way in (0, 1):
            mine, table, matrix = slice(way * UNITS, (way + 1) * UNITS), self.table[way], self.recurrent[way]
            by_gate = np.ascontiguousarray(table.T)
            h = np.zeros((UNITS, n), np.float32)
            kept = []
            for step in range(steps) if way == 0 else range(steps - 1, -1, -1):
                x = np.take(by_gate, data[step], axis=1, mode="clip")
                zr = x[: 2 * UNITS]
                zr += matrix[: 2 * UNITS] @ h
                zr *= 0.5
                np.tanh(zr, out=zr)
                zr += 1
                zr *= 0.5
                c = x[2 * UNITS :]
                c += matrix[2 * UNITS :] @ (zr[UNITS:] * h)
                np.tanh(c, out=c)
                if keep:
                    kept.append((step, h, zr, c))
                h = h + zr[:UNITS] * (c - h)
                out[step, mine] = h
            gates.append(kept)
        return out, gates

    def positions(self, states: np.ndarray) -> np.ndarray:
        """(steps, labels, pieces) probabilities."""
        odds = np.matmul(self.output, states) + self.bias[:, None]
        odds -= odds.max(axis=1, keepdims=True)
        np.exp(odds, out=odds)
        odds /= odds.sum(axis=1, keepdims=True)
        return odds

    def slopes(self, data: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Cross entropy of every position with its piece's label, and its slope for each parameter."""
        states, gates = self.states(data, keep=True)
        odds = self.positions(states)
        total = max(1e-9, float(weight.sum()))
        columns = np.arange(data.shape[1])
        loss = -float((np.log(odds[:, target, columns] + 1e-9) * weight).sum()) / total
        off = odds
        off[:, target, columns] -= 1
        off *= (weight / total)[:, None, :]
        d_output = np.einsum("tln,tun->lu", off, states, optimize=True)
        d_states = np.matmul(self.output.T, off)
        d_table, d_recurrent = np.zeros_like(self.table), np.zeros_like(self.recurrent)
        for way in (0, 1):
            matrix, back = self.recurrent[way], np.zeros((UNITS, data.shape[1]), np.float32)
            for step, h, zr, c in reversed(gates[way]):
                z, r = zr[:UNITS], zr[UNITS:]
                back = back + d_states[step, way * UNITS : (way + 1) * UNITS]
                d_c = back * z * (1 - c * c)
                d_reset = matrix[2 * UNITS :].T @ d_c
                d_zr = np.concatenate([back * (c - h) * z * (1 - z), d_reset * h * r * (1 - r)])
                d_x = np.concatenate([d_zr, d_c])
                np.add.at(d_table[way], data[step], d_x.T)
                d_recurrent[way, : 2 * UNITS] += d_zr @ h.T
                d_recurrent[way, 2 * UNITS :] += d_c @ (r * h).T
                back = back * (1 - z) + d_reset * r + matrix[: 2 * UNITS].T @ d_zr
        return loss, [d_table, d_recurrent, d_output, off.sum(axis=(0, 2))]

    def document_odds(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(documents, labels) mean probabilities over all positions of each document; none gives 0."""
        sizes = np.diff(offsets)
        pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(sizes)), pieces)
        first = np.repeat(offsets[:-1], pieces) + (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
        length = np.minimum(PIECE, offsets[owner + 1] - first)
        total = np.zeros((len(sizes), len(self.labels)))
        order = np.argsort(-length, kind="stable")
        for part in range(0, len(order), 1024):
            some = order[part : part + 1024]
            steps = np.arange(int(length[some[0]]))[:, None]
            inside = steps < length[some]
            data = np.where(inside, raw[np.minimum(first[some] + steps, len(raw) - 1)], 0)
            odds = self.positions(self.states(data)[0])
            summed = np.einsum("tln,tn->nl", odds, inside.astype(np.float32), optimize=True)
            np.add.at(total, owner[some], summed)
        return total / np.maximum(1, sizes)[:, None]


def train_network(texts: list[bytes], labels: list[str], passes: int = 6, batch: int = 128, rate: float = 0.02, seed: int = 5) -> Network:
    """Fit a network on pieces of the texts by Adam; the same texts in the same order give the same one."""
    names = sorted(set(labels))
    net = Network.fresh(names, seed)
    pieces = [(t[k : k + PIECE // 2], names.index(y)) for t, y in zip(texts, labels) for k in range(0, len(t), PIECE // 2)]
    if not pieces:
        return net
    data = np.zeros((PIECE // 2, len(pieces)), np.uint8)
    weight = np.zeros((PIECE // 2, len(pieces)), np.float32)
    for i, (piece, _) in enumerate(pieces):
        data[: len(piece), i] = np.frombuffer(piece, np.uint8)
        weight[: len(piece), i] = 1
    target = np.array([y for _, y in pieces])
    weight *= (len(pieces) / (len(names) * np.bincount(target, minlength=len(names))))[target].astype(np.float32)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    rng, turn = np.random.default_rng(seed), 0
    for _ in range(passes):
        order = rng.permutation(len(pieces))
        for part in range(0, len(order), batch):
            some, turn = order[part : part + batch], turn + 1
            _, slopes = net.slopes(data[:, some], target[some], weight[:, some])
            for p, slope, (m, v) in zip(net.parameters(), slopes, moments):
                slope = np.clip(slope, -1, 1)
                m += 0.1 * (slope - m)
                v += 0.01 * (slope * slope - v)
                p -= (rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)).astype(np.float32)
    return net


def held_out(key: Column, parts: int = _PARTS) -> Column:
    """Whether crc32 of the key as text leaves 1 on division by ``parts``; null keys do not."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(parts)) == 1, F.lit(False))


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE_BYTES, passes: int = 6) -> Network | None:
    """A network fitted on at most ``sample`` bytes of labelled documents outside the held-out part, or None.

    Whole texts are taken in the order of a hash of their key, in like shares of bytes for each
    label.  A text of more than a sixteenth of its label's share isn't used for fitting.  This bounds what
    training holds, not what prediction reads.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id"))).filter("text rlike '\\\\p{L}'")
    rows = rows.withColumn("size", F.octet_length("text").cast("long"))
    names = [r["lang"] for r in rows.select("lang").distinct().collect()]
    if not names:
        return None
    share = sample // len(names)
    rows = rows.filter(F.col("size") <= share // 16)
    known = {r["lang"]: r for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.avg("size").alias("mean")).collect()}
    # a hash of the key passes about twice the rows that are wanted, so that few texts move
    chosen = F.lit(False)
    for name, r in known.items():
        chosen = F.when(F.col("lang") == name, below(F.col("id"), int(share / r["mean"]) + 1, r["n"])).otherwise(chosen)
    so_far = Window.partitionBy("lang").orderBy("turn", "id", "text").rowsBetween(Window.unboundedPreceding, 0)
    some = rows.filter(chosen).withColumn("turn", F.xxhash64("id")).withColumn("total", F.sum("size").over(so_far))
    got = some.filter(F.col("total") <= share).orderBy("lang", "turn", "id", "text").select("text", "lang").collect()
    return train_network([r["text"].encode() for r in got], [r["lang"] for r in got], passes)


def identify(docs: DataFrame, network: Network | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) for every row of ``docs``; only the text decides.

    ``score`` is the label's mean probability over all bytes of the text.  A null text, an empty one
    or one without a letter is ``und`` with a score of 0, and so is everything without a network.
    Whole texts are read, in pieces of PIECE bytes.  Null and repeated keys stay, other columns are
    ignored, an empty table gives an empty result.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        net = shipped.value
        for part in slices(batches):
            raw, offsets = flat(part.column("text"))
            letters = part.column("letters").to_numpy(zero_copy_only=False)
            if net is None:
                names, score = ["und"] * part.num_rows, np.zeros(part.num_rows)
            else:
                odds = net.document_odds(raw, offsets)
                best = odds.argmax(axis=1)
                names = [net.labels[b] if ok else "und" for b, ok in zip(best, letters)]
                score = np.where(letters, np.clip(odds.max(axis=1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(names, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), letters.alias("letters"))
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", key)
