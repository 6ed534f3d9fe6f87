"""Byte pair encoding by a pair occurrence index, and decoding.

All new words of a batch are encoded together.  Their symbols lie in one linked list, and an index
maps every mergeable pair to all its positions there.  Active ranks are taken in ascending order;
each merges all its positions at once and moves only the neighbours' entries in the index.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import slices

#: Words that a task remembers; when full, it forgets all and goes on.
KNOWN_WORDS = 200_000

# White space (Unicode White_Space), the pattern of a word, printable signs of bytes.
WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{WHITE}\p{{L}}\p{{N}}]+"
# The same for lower-case Latin-1 texts, whose letters and numbers are few enough to list.
LETTER, NUMBER = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_WORD = rf"[{LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[{NUMBER}]|[^{WHITE}{LETTER}{NUMBER}]+"


def byte_signs() -> list[str]:
    """The sign of each byte: printable Latin-1 stands for itself, the rest is numbered from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


class PairEncoder:
    """Vocabulary and merges of a word-end BPE file, with a bounded memory of encoded words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = {i: t for t, i in (vocab | self.special).items()}
        self.merges, self.rank = [], {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.append((vocab[a], vocab[b], vocab[a + b]))
            self.rank.setdefault(vocab[a] << 20 | vocab[b], rank)  # ids are below 2**20
        signs = byte_signs()
        self._inner = np.array([vocab[s] for s in signs], np.int64)
        self._final = np.array([vocab[s + suffix] for s in signs], np.int64)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.word, self.latin_word = regex.compile(WORD), re.compile(LATIN_WORD)
        #: of a word: its ids joined by spaces, and their decoded text
        self.known: dict[str, tuple[str, str]] = {}

    def _index(self, words: list[str]) -> tuple[list, list, list, list, dict[int, list[int]]]:
        """Symbols of all words in one linked list, and for each rank the positions of its pair."""
        raws = [w.encode() for w in words]
        sizes = np.array([len(r) for r in raws], np.int64)
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(raws), np.uint8)
        symbols = self._inner[data]
        symbols[ends - 1] = self._final[data[ends - 1]]
        after, before = np.arange(1, len(data) + 1), np.arange(-1, len(data) - 1)
        after[ends - 1] = -1
        before[ends - sizes] = -1
        pairs = symbols[:-1] << 20 | symbols[1:]
        pairs[ends[:-1] - 1] = -1
        kinds, which = np.unique(pairs, return_inverse=True)
        ranks = np.array([self.rank.get(k, -1) for k in kinds.tolist()], np.int64)[which]
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0) :]
        cuts = np.flatnonzero(np.diff(ranks[order])) + 1
        places = {int(ranks[x[0]]): x.tolist() for x in np.split(order, cuts) if len(x)}
        return symbols.tolist(), after.tolist(), before.tolist(), (ends - sizes).tolist(), places

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, all merged together through the pair occurrence index."""
        if not words:
            return []
        symbols, after, before, starts, places = self._index(words)
        rank_of, merges = self.rank.get, self.merges
        active = list(places)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            here = places.pop(rank)
            left, right, joined = merges[rank]
            low, high = joined << 20, joined
            here.sort()  # leftmost first, as runs of one symbol overlap
            for turn, at in enumerate(here):
                following = after[at]
                if symbols[at] != left or following < 0 or symbols[following] != right:
                    continue  # an earlier merge took one of its symbols
                beyond, ahead, lowest = after[following], before[at], rank
                symbols[at], symbols[following], after[at] = joined, -1, beyond
                if beyond >= 0:
                    before[beyond] = at
                    new = rank_of(low | symbols[beyond])
                    if new is not None:
                        if new in places:
                            places[new].append(at)
                        else:
                            places[new] = [at]
                            heapq.heappush(active, new)
                        lowest = new if new < lowest else lowest
                if ahead >= 0:
                    new = rank_of(symbols[ahead] << 20 | high)
                    if new is not None:
                        if new in places:
                            places[new].append(ahead)
                        else:
                            places[new] = [ahead]
                            heapq.heappush(active, new)
                        lowest = new if new < lowest else lowest
                if lowest < rank:  # a lower rank became active: it goes first
                    if rank not in places:
                        heapq.heappush(active, rank)
                    places[rank] = here[turn + 1 :] + places.get(rank, [])
                    break
        out = []
        for at in starts:
            ids = []
            while at >= 0:
                ids.append(symbols[at])
                at = after[at]
            out.append(ids)
        return out

    def pieces(self, text: str) -> list[str]:
        """Words of a text in order; special tokens stand as they are."""
        if self.cut and "<|" in text:
            out = []
            for part in self.cut.split(text):
                out += [part] if part in self.special else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        text = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.word.findall(text)
        return self.latin_word.findall(text)

    def learn(self, words: set[str]) -> None:
        """Encode the words that aren't known yet."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > KNOWN_WORDS:
            self.known.clear()
            new = list(words)
        plain = [w for w in new if w not in self.special]
        for word, ids in zip(plain, self.encode_words(plain)):
            self.known[word] = " ".join(map(str, ids)), self.decode(ids)
        for word in set(new) - set(plain):
            self.known[word] = str(self.special[word]), word

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces, special ones too; ids outside the vocabulary are left out."""
        return " ".join(self.text_of[i] for i in ids if i in self.text_of)

    def encode(self, text: str) -> list[int]:
        pieces = self.pieces(text)
        self.learn(set(pieces))
        return [int(i) for w in pieces for i in self.known[w][0].split(" ")]


@lru_cache(maxsize=2)
def encoder(path: str) -> PairEncoder:
    return PairEncoder(path)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column ``ids`` array<int>: the whole text's tokens; null gives none.

    A column of that name is replaced; all others and all rows stay.
    """
    def run(batches):
        known = encoder(path)
        for part in slices(batches, "__text"):
            split = [known.pieces(t or "") for t in part.column("__text").to_pylist()]
            known.learn({w for words in split for w in words})
            rows = pa.array([[int(i) for w in words for i in known.known[w][0].split(" ")] for words in split], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], rows], [*part.schema.names[:-1], ids])
        known.known.clear()  # the worker lives on

    kept = docs.drop(ids)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return docs.select(*kept.columns, F.col(text).alias("__text")).mapInArrow(run, f"{kinds}, `{ids}` array<int>")


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with a column ``text``: the tokens of ``ids`` joined; a null array gives null."""
    def run(batches):
        known = encoder(path)
        for part in batches:
            rows = [None if x is None else known.decode(x) for x in part.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(rows, pa.string())], [*part.schema.names[:-1], text])

    kept = docs.drop(text)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return docs.select(*kept.columns, F.col(ids).alias("__ids")).mapInArrow(run, f"{kinds}, `{text}` string")


def token_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) for every row of ``docs``.

    The digests are those of the decimal ids joined by a space, and of the decoded text.  Null
    counts as empty: no tokens, the digests of an empty text.  Null and repeated keys stay as they
    are, other columns are ignored, an empty table gives an empty result.  Memory is bounded by a
    slice of texts, or one text, and KNOWN_WORDS words.
    """
    def run(batches):
        known = encoder(path)
        for part in slices(batches):
            split = [known.pieces(t or "") for t in part.column("text").to_pylist()]
            known.learn({w for words in split for w in words})
            counts, ids, decoded = [], [], []
            for words in split:
                rows = [known.known[w] for w in words]
                joined = " ".join([x for x, _ in rows])
                counts.append(joined.count(" ") + 1 if joined else 0)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(" ".join([x for _, x in rows]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        known.known.clear()  # the worker lives on

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", key)
