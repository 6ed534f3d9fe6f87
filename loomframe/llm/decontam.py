"""Benchmark decontamination by edit distance.

A CGK random walk reads a window with steps of 0 or 1 decided by shared random bits of (walk, step,
byte), so that two strings of small edit distance give outputs of small Hamming distance.  Bit
sampling then hashes a few outputs of a walk.  A window and an item that meet in a table of some
walk are a candidate, and what meets is settled by an exact edit distance.  WALKS independent
walks, of windows as long as the item and shorter and longer by its distance, meet a pair at the
largest distance with the target recall; a window takes further walks only while it has met nothing.

Of all places where a window could begin, only those are walked where a match is possible at all,
which loses none: an item is cut into p pieces of seven characters or more, of which d edits leave
p - d whole, shifted against each other by d at most (pigeonhole); and d edits leave all but 3 d of
its trigrams.  Both only bound how much is walked, walks find the items.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import mixed, settle, slices

PIECE = 7
#: A piece that more items share is passed over where an item has enough others.
SHARED = 16
#: Independent walks; tables of each, and outputs that a table samples, from the first ENDING of the steps.
#: Measured over the given items at exactly a tenth of edits, these find 99 of 100 pairs or more of each kind.
WALKS, PER_WALK, SAMPLED, ENDING = 96, 4, 3, 0.9
#: Walks taken at once: what met before isn't walked again.
ROUNDS = (1, 3, 4, 8, 16, 32, 32)
#: Bytes of item texts that one task holds at a time; more items are met block by block, of which
#: BLOCKS_AT_ONCE are broadcast at a time.
ITEM_BYTES, BLOCKS_AT_ONCE = 4 << 20, 8
#: Bytes of text searched in one go, entries of pieces that are listed, and outputs that are kept at a time.
SEARCH_BYTES, ENTRIES, OUTPUTS = 1 << 20, 1 << 21, 1 << 22
_FILTER_BITS, _GRAM_BITS = 20, 10


def normalised(text: str) -> str:
    """Lower case, runs of white space as one blank."""
    return " ".join(text.replace("\0", " ").lower().split())


def folded(text: str) -> np.ndarray:
    """One byte for each character: the code point, or a hash of it from 256 on; 0 only for NUL."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(points < 256, points, 1 + (points * np.uint32(0x9E3779B1) >> np.uint32(16)) % 255).astype(np.uint8)


def allowed(length: int, share: float) -> int:
    return int(length * share)


def edit_distance_within(item: str, region: str, most: int) -> int | None:
    """Least edit distance of ``item`` to any part of ``region`` if it is at most ``most``.

    Bit-parallel columns of the dynamic programme, one step for each character of the region.
    """
    if item in region:
        return 0
    m = len(item)
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for c in region:
        eq = peq.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(diagonal | up) & full, up & diagonal
        score += 1 if plus & top else -1 if minus & top else 0
        best = score if score < best else best
        plus, minus = plus << 1 & full, minus << 1 & full  # a match may begin anywhere
        up, down = minus | ~(diagonal | plus) & full, plus & diagonal
    return best if best <= most else None


class Walks:
    """The outputs of walks that are sampled, the same everywhere."""

    def __init__(self, seed: int = 7):
        self.seed = seed
        self.picks = np.random.default_rng([seed, 0]).random((WALKS, PER_WALK, SAMPLED)) * ENDING

    def moves(self, walk: int, steps: int) -> np.ndarray:
        """(steps, 256) 0 or 1: whether a byte is left behind at a step; nothing is left at once."""
        bits = np.random.default_rng([self.seed, 1, walk]).integers(0, 2, (steps, 256), np.int8)
        bits[:, 0] = 1
        return bits

    def keys(self, walks: range, data: np.ndarray, starts: np.ndarray, stops: np.ndarray, sizes: np.ndarray, lengths: list[np.ndarray]) -> np.ndarray:
        """(lengths, windows, walks * PER_WALK) hashes of the windows data[start : start + length], empty beyond ``stops``.

        A walk has two steps for each character of the item, whose size decides which are sampled.
        """
        out = np.zeros((len(lengths), len(starts), len(walks) * PER_WALK), np.uint64)
        if not len(starts):
            return out
        steps, column, padded = 2 * int(sizes.max()), np.arange(len(starts)), np.append(data, np.uint8(0))
        ends = [np.minimum(starts + n, stops) for n in lengths]
        last = np.max(ends, axis=0)
        for w, walk in enumerate(walks):
            moves, at, read = self.moves(walk, steps), starts.copy(), np.empty((steps, len(starts)), np.uint8)
            inside = [np.zeros(len(starts), np.int64) for _ in lengths]
            for step in range(steps):
                byte = padded[np.where(at < last, at, len(data))]
                read[step] = byte
                for count, end in zip(inside, ends):
                    count += at < end
                at += moves[step][byte]
            for k in range(PER_WALK):
                for pick in self.picks[walk, k]:
                    step = (pick * 2 * sizes).astype(np.int64)
                    seen = read[step, column].astype(np.uint64)
                    for n, count in enumerate(inside):
                        byte = np.where(step < count, seen, np.uint64(0))
                        out[n, :, w * PER_WALK + k] = mixed(out[n, :, w * PER_WALK + k] * np.uint64(257) + byte + np.uint64(1))
        return out


class Items:
    """A block of items ready to be searched for: pieces and their filter, trigrams, keys of walks."""

    def __init__(self, ids: list, texts: list[str], share: float):
        self.ids, self.texts = ids, texts
        self.most = np.array([allowed(len(t), share) for t in texts], np.int64)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        if (self.sizes // PIECE <= self.most).any():
            raise ValueError("share must leave a piece of seven characters whole")
        signs = [folded(t) for t in texts]
        pieces: dict[int, list[tuple[int, int]]] = {}
        cuts = [[len(t) * k // (len(t) // PIECE) for k in range(len(t) // PIECE)] for t in texts]
        words = [[int.from_bytes(sign[c : c + PIECE].tobytes(), "little") for c in cut] for sign, cut in zip(signs, cuts)]
        held: dict[int, int] = {}
        for own in words:
            for word in set(own):
                held[word] = held.get(word, 0) + 1
        #: of the pieces that are looked for, how many a match has
        self.need = np.zeros(len(texts), np.int64)
        for number, (own, cut) in enumerate(zip(words, cuts)):
            rare = [k for k, word in enumerate(own) if held[word] <= SHARED]
            used = rare if len(rare) > self.most[number] else range(len(own))
            self.need[number] = len(used) - self.most[number]
            for k in used:
                pieces.setdefault(own[k], []).append((number, cut[k]))
        self.words = np.array(sorted(pieces), np.uint64)
        found = [pieces[int(w)] for w in self.words]
        self.bounds = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
        self.owner = np.array([o for x in found for o, _ in x], np.int64)
        self.offset = np.array([o for x in found for _, o in x], np.int64)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self._slot(self.words)] = True
        self.data, self.ends = np.concatenate(signs), np.cumsum(self.sizes)
        self.walks, self._keys = Walks(), {}
        self.grams = np.stack([self._grams(s) for s in signs])
        #: trigrams, by their hashes, that a match has at least
        self.least = np.where(self.sizes < 1 << 16, self.sizes - 2 - 3 * self.most, 0)

    @staticmethod
    def _slot(words: np.ndarray) -> np.ndarray:
        return (words * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _FILTER_BITS)

    @staticmethod
    def _grams(sign: np.ndarray) -> np.ndarray:
        """How often each hash of a trigram occurs, up to 65,535."""
        x = sign.astype(np.uint32)
        code = (x[:-2] | x[1:-1] << 8 | x[2:] << 16) * np.uint32(0x9E3779B1) >> np.uint32(32 - _GRAM_BITS)
        return np.minimum(np.bincount(code, minlength=1 << _GRAM_BITS), (1 << 16) - 1).astype(np.uint16)

    def keys(self, walks: range) -> np.ndarray:
        """(items, walks * PER_WALK) hashes of the items."""
        if walks not in self._keys:
            begins = self.ends - self.sizes
            self._keys[walks] = self.walks.keys(walks, self.data, begins, self.ends, self.sizes, [self.sizes])[0]
        return self._keys[walks]

    def _hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, piece) of every piece in ``data``, by place."""
        hits, low = [], np.uint64((1 << 8 * PIECE) - 1)
        for shift in range(8):
            words = np.frombuffer(data, "<u8", max(0, (len(data) - shift) // 8), shift) & low if len(data) >= shift + 8 else np.zeros(0, "<u8")
            some = np.flatnonzero(self.filter[self._slot(words)])
            if len(some) and len(self.words):
                at = np.minimum(np.searchsorted(self.words, words[some]), len(self.words) - 1)
                good = self.words[at] == words[some]
                hits.append((some[good] * 8 + shift, at[good]))
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place, piece = (np.concatenate(x) for x in zip(*hits))
        order = np.argsort(place, kind="stable")
        return place[order], piece[order]

    def windows(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, items): where pieces put the begin of an item in ``data``.

        Hits are taken a stretch at a time, so that shared pieces can't list more than ENTRIES entries
        or those of one stretch; stretches overlap by the longest item.
        """
        place, piece = self._hits(data)
        counts = self.bounds[piece + 1] - self.bounds[piece]
        total, wide = np.concatenate([[0], np.cumsum(counts)]), int(self.sizes.max() + 2 * self.most.max())
        out, begin = [], 0
        while begin < len(place):
            end = max(begin + 1, int(np.searchsorted(total, total[begin] + ENTRIES, side="right")) - 1)
            upto = int(np.searchsorted(place, place[end - 1] + wide, side="right"))
            out.append(self._spots(place[begin:upto], piece[begin:upto], len(data)))
            begin = end
        spot = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
        return (spot & ((1 << 40) - 1)) - len(data), spot >> 40

    def _spots(self, place: np.ndarray, piece: np.ndarray, shift: int) -> np.ndarray:
        counts = self.bounds[piece + 1] - self.bounds[piece]
        entry = np.arange(counts.sum()) + np.repeat(self.bounds[piece] - np.cumsum(counts) + counts, counts)
        starts = np.repeat(place, counts) - self.offset[entry]
        spot = np.sort((self.owner[entry] << 40) + starts + shift)
        items = spot >> 40
        upto = np.searchsorted(spot, spot + self.most[items], side="right")
        enough = np.flatnonzero(upto - np.arange(len(spot)) >= self.need[items])
        marks = np.zeros(len(spot) + 1, np.int64)
        np.add.at(marks, enough, 1)
        np.add.at(marks, upto[enough], -1)
        return np.unique(spot[np.cumsum(marks[:-1]) > 0])

    def _alike(self, data: np.ndarray, low: np.ndarray, high: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Which regions data[low : high] have trigrams enough for their items."""
        good = np.ones(len(low), bool)
        order = np.lexsort((high, low))
        change = np.flatnonzero((np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)) + 1
        for same in np.split(order, change):
            if len(same):
                grams = self._grams(data[max(0, low[same[0]]) : max(0, high[same[0]])])
                for part in range(0, len(same), 1 << 12):
                    now = same[part : part + (1 << 12)]
                    good[now] = np.minimum(self.grams[items[now]], grams).sum(axis=1, dtype=np.int64) >= self.least[items[now]]
        return good

    def search(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text, item, distance) of the items found in the texts."""
        data = folded("\0".join([*texts, "\0" * 8]))
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        begins = np.concatenate([[0], ends[:-1] + 1])
        starts, items = self.windows(data)
        # the text a match is in: that of its middle, which d edits don't move beyond the text's ends
        owner = np.minimum(np.searchsorted(ends, starts + self.sizes[items] // 2), len(texts) - 1)
        order = np.lexsort((starts, items, owner))
        starts, items, owner = starts[order], items[order], owner[order]
        # a match begins within d of its spots and has n + d characters at most; spots of one stretch of
        # 4 d + 1 places are one region, and any region that holds a spot of a match holds the match
        low, high = starts - 2 * self.most[items], starts + self.sizes[items] + 2 * self.most[items]
        stretch, first = starts // (4 * self.most[items] + 1), np.ones(len(starts), bool)
        first[1:] = (owner[1:] != owner[:-1]) | (items[1:] != items[:-1]) | (stretch[1:] != stretch[:-1])
        opens, region = np.flatnonzero(first), np.cumsum(first) - 1
        closes = np.append(opens[1:], len(starts)) - 1 if len(opens) else opens
        item_of, owner_of = items[opens], owner[opens]
        low, high = np.maximum(low[opens], begins[owner_of]), np.minimum(high[closes], ends[owner_of])
        open_regions = self._alike(data, low, high, item_of)
        found: dict[tuple[int, int], int] = {}
        walked = 0
        for count in ROUNDS:
            walks = range(walked, walked + count)
            walked += count
            left = np.flatnonzero(open_regions[region])
            if not len(left):
                break
            left = left[np.argsort(self.sizes[items[left]], kind="stable")]  # windows walked together take as many steps
            for which in np.unique(region[self._met(data, starts[left], items[left], begins[owner[left]], ends[owner[left]], walks, left)]):
                open_regions[which] = False  # settled, either way
                pair = int(owner_of[which]), int(item_of[which])
                if found.get(pair) == 0:
                    continue
                base = int(begins[pair[0]])
                part = texts[pair[0]][int(low[which]) - base : max(0, int(high[which]) - base)]
                distance = edit_distance_within(self.texts[pair[1]], part, int(self.most[pair[1]]))
                if distance is not None:
                    found[pair] = min(distance, found.get(pair, distance))
        return [(text, item, d) for (text, item), d in sorted(found.items())]

    def _met(self, data, starts, items, begins, ends, walks: range, names: np.ndarray) -> np.ndarray:
        """The ``names`` of windows that meet their item in a table of the walks."""
        out, keys, at = [], self.keys(walks), 0
        while at < len(starts):
            upto = at + max(1, OUTPUTS // (2 * int(self.sizes[items[at:]].max())))  # bounds what the walks record
            now, own = slice(at, upto), items[at:upto]
            size, d = self.sizes[own], self.most[own]
            seen = self.walks.keys(walks, data, np.maximum(starts[now], begins[now]), ends[now], size, [size - d, size, size + d])
            out.append(names[now][(seen == keys[own][None]).any(axis=(0, 2))])
            at = upto
        return np.concatenate(out) if out else np.zeros(0, np.int64)


class ShortItems:
    """Items too short for an edit distance: found where their words stand in a row."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids = ids
        self.number = {}
        for k, text in enumerate(texts):
            self.number.setdefault(text, []).append(k)
        self.sizes = sorted({t.count(" ") + 1 for t in self.number})

    def search(self, texts: list[str]) -> list[tuple[int, int, int]]:
        out = []
        for row, text in enumerate(texts):
            words, seen = text.split(" "), set()
            for size in self.sizes:
                for k in range(len(words) - size + 1):
                    seen.update(self.number.get(words[k] if size == 1 else " ".join(words[k : k + size]), ()))
            out += [(row, k, 0) for k in sorted(seen)]
        return out


def contaminated(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    share: float = 0.1, short: int = 24,
) -> DataFrame:
    """(key, n_items, item_ids, distances, kept) for every row of ``docs``.

    A document is contaminated (``kept`` false) if some part of it is within ``share`` * n edits of
    an item of n characters; both sides are compared in lower case with single blanks.  ``item_ids``
    lists the items found in ascending order with the distances beside them.

    Walks find a pair at the largest distance in 99 of 100 cases, closer ones more often; distances
    are exact.  An item under ``short`` characters has room for no edits that say anything: it counts
    where its words stand in a row as they are.  Null or empty items, and those of white space, match
    nothing; items that repeat an id count once with their least distance.  Null or empty documents
    are kept.  Null and repeated keys stay as they are, other columns are ignored, empty tables are fine.

    Items are read in blocks of ITEM_BYTES at most, each held by every task while it passes over the
    documents; a longer item table takes several blocks and nothing is left out.  Of the blocks
    BLOCKS_AT_ONCE are broadcast at a time, then what they found is stored and they are dropped.
    """
    wanted = items.select(F.col(item_key).alias("id"), F.col(item_text).alias("text")).filter("id is not null and text is not null")
    total = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * total // ITEM_BYTES))
    spark = docs.sparkSession
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    out = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.lit(None).cast(f"array<struct<item:{item_kind},distance:int>>").alias("found"))

    alive = []
    for block in range(blocks):
        part = wanted.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).collect()
        rows = sorted((r.id, t) for r in part if (t := normalised(r.text)))
        if not rows:
            continue
        if len(alive) == BLOCKS_AT_ONCE:
            out = settle(out, "found")
            while alive:
                alive.pop().destroy()
        alive.append(spark.sparkContext.broadcast(rows))

        def run(batches, shipped=alive[-1]):
            kinds = [[r for r in shipped.value if len(r[1]) >= short], [r for r in shipped.value if len(r[1]) < short]]
            ways = [make(*map(list, zip(*k)), *more) for make, k, more in ((Items, kinds[0], [share]), (ShortItems, kinds[1], [])) if k]
            for part in slices(batches, most=SEARCH_BYTES):
                hits: dict[int, list] = {}
                texts = [normalised(t or "") for t in part.column("text").to_pylist()]
                for way in ways:
                    for row, item, distance in way.search(texts):
                        hits.setdefault(row, []).append({"item": way.ids[item], "distance": distance})
                before = part.column("found").to_pylist()
                found = [(before[i] or []) + hits.get(i, []) or None for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("text"), pa.array(found, part.schema.field("found").type)], part.schema.names
                )

        out = out.mapInArrow(run, f"id {kind}, text string, found array<struct<item:{item_kind},distance:int>>")
    ids = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["item"])))
    least_of = lambda i: F.array_min(F.transform(F.filter("found", lambda x: x["item"] == i), lambda x: x["distance"]))
    found = F.coalesce(ids, F.array().cast(f"array<{item_kind}>"))
    return out.select(
        F.col("id").alias(key), F.size(found).cast("long").alias("n_items"), found.alias("item_ids"),
        F.transform(found, least_of).alias("distances"), (F.size(found) == 0).alias("kept"),
    )
