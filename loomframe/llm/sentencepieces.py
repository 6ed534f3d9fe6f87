"""SentencePiece encoding by a table of distinct chunks, and decoding.

No piece of the vocabulary goes on beyond a whitespace marker, so a text's tokens are those of its
chunks: runs of markers with the signs up to the next marker.  The chunks of many texts become one
table of distinct ones; each is segmented once, all side by side in flat arrays, and the ids are
joined back to the texts by position.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import flat, slices

#: Texts whose chunks share one table, and chunks that a task remembers; when full, it forgets all.
TABLE_BYTES, KNOWN_CHUNKS = 1 << 21, 400_000
#: Chunks of more signs are segmented one by one, in time n log n instead of n merges of all.
LONG = 48

# The whitespace marker, what an unknown piece and an undecodable byte become.
MARK, UNKNOWN_TEXT, BAD_BYTE = "▁", " ⁇ ", "�"
_NONE = np.iinfo(np.int64).max


class Pieces:
    """Vocabulary of a BPE model with byte fallback that leaves texts as they are."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize("  a  ｆ") != MARK * 3 + "a" + MARK * 2 + "ｆ":
            raise ValueError("the model changes texts before it segments them")
        n = model.get_piece_size()
        names, self.unk = [model.id_to_piece(i) for i in range(n)], model.unk_id()
        self.byte_of = {i: int(names[i][3:5], 16) for i in range(n) if model.is_byte(i)}
        silent = {i for i in range(n) if model.is_control(i)}
        plain = {names[i]: i for i in range(n) if i not in silent | self.byte_of.keys() | {self.unk}}
        if any(MARK in p.lstrip(MARK) for p in plain) or len(self.byte_of) != 256 or any(model.is_unused(i) for i in range(n)):
            raise ValueError("pieces cross whitespace markers, or bytes aren't covered")
        #: surface of an id; None stands for a byte
        self.surface = ["" if i in silent else UNKNOWN_TEXT if i == self.unk else None if i in self.byte_of else names[i].replace(MARK, " ") for i in range(n)]
        self.size, byte_ids = n, {b: i for i, b in self.byte_of.items()}
        self._byte_ids = np.array([byte_ids[b] for b in range(256)], np.int64)
        # symbols: ids of pieces, then signs that occur in pieces only, then any other sign
        signs = sorted({c for p in plain for c in p} - plain.keys())
        symbols = plain | {c: n + k for k, c in enumerate(signs)}
        self._beyond = n + len(signs)
        self._symbol_of = np.arange(0x110000, dtype=np.int64) + self._beyond
        for c, s in symbols.items():
            if len(c) == 1:
                self._symbol_of[ord(c)] = s
        self._sign_of = np.array([0] * n + [ord(c) for c in signs], np.int64)
        scores = sorted({-model.get_score(i) for i in plain.values()})
        level = {s: k for k, s in enumerate(scores)}  # 0 goes first; equal scores share a level
        joins = sorted(
            (symbols[p[:k]] << 24 | symbols[p[k:]], level[-model.get_score(i)], i)
            for p, i in plain.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols
        )
        self._pairs, self._levels, self._joined = (np.array(x, np.int64) for x in zip(*joins))
        self._join_of = {pair: (lv, i) for pair, lv, i in joins}
        #: of a chunk: how many ids, the ids joined by commas, their text
        self.known: dict[str, tuple[int, str, str]] = {}

    def _looked_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Level (_NONE if the two don't join) and joined symbol of each pair."""
        pair = left << 24 | right
        at = np.minimum(np.searchsorted(self._pairs, pair), len(self._pairs) - 1)
        return np.where(self._pairs[at] == pair, self._levels[at], _NONE), self._joined[at]

    def _one(self, symbols: list[int]) -> list[int]:
        """Segment one long chunk: the best level first, the leftmost of equal ones."""
        n, join = len(symbols), self._join_of.get
        after, before, heap = [*range(1, n), -1], [*range(-1, n - 1)], []

        def offer(a: int, b: int) -> None:
            found = join(symbols[a] << 24 | symbols[b]) if a >= 0 <= b else None
            if found:
                heapq.heappush(heap, (found[0], a, b, symbols[a], symbols[b], found[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, was_a, was_b, joined = heapq.heappop(heap)
            if symbols[a] != was_a or symbols[b] != was_b or after[a] != b:
                continue
            symbols[a], symbols[b], after[a] = joined, -1, after[b]
            if after[a] >= 0:
                before[after[a]] = a
            offer(before[a], a)
            offer(a, after[a])
        out, i = [], 0
        while i >= 0:
            out.append(symbols[i])
            i = after[i]
        return out

    def _many(self, symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segment short chunks side by side: in each round every chunk makes its next merge.

        Returns all symbols and the bounds of each chunk's run.
        """
        counts = np.diff(np.concatenate([[0], ends]))
        owner = np.repeat(np.arange(len(ends)), counts)
        done_owner, done_symbols = [], []
        level, joined = self._looked_up(symbols, np.append(symbols[1:], 0))
        level[ends - 1] = _NONE
        while len(symbols):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sizes = np.diff(np.append(first, len(owner)))
            # the level above, the place below: the least one is the next merge of its chunk
            key = np.where(level == _NONE, _NONE, level << 32 | np.arange(len(level)))
            best = np.minimum.reduceat(key, first)
            over = np.repeat(best == _NONE, sizes)
            done_owner.append(owner[over])
            done_symbols.append(symbols[over])
            at = best[best != _NONE] & 0xFFFFFFFF
            symbols[at] = joined[at]
            keep = ~over
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            symbols, owner, level, joined = symbols[keep], owner[keep], level[keep], joined[keep]
            at = moved[at]
            for place in (at, (at - 1)[at > 0]):
                right = np.minimum(place + 1, len(symbols) - 1)
                level[place], joined[place] = self._looked_up(symbols[place], symbols[right])
                level[place[(owner[right] != owner[place]) | (right == place)]] = _NONE
        owner, symbols = np.concatenate(done_owner), np.concatenate(done_symbols)
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.searchsorted(owner[order], np.arange(len(ends) + 1))

    def _as_ids(self, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no pieces become the ids of their bytes in UTF-8."""
        sign = np.where(symbols >= self._beyond, symbols - self._beyond, self._sign_of[np.minimum(symbols, len(self._sign_of) - 1)])
        other = symbols >= self.size
        wide = np.where(other, 1 + (sign > 0x7F) + (sign > 0x7FF) + (sign > 0xFFFF), 1)
        start = np.concatenate([[0], np.cumsum(wide)])
        ids = np.repeat(symbols, wide)
        for which in np.flatnonzero(other):
            ids[start[which] : start[which + 1]] = self._byte_ids[list(chr(sign[which]).encode())]
        return ids, start[bounds]

    def segment(self, chunks: list[str]) -> list[np.ndarray]:
        """Ids of each chunk, markers written as they are; no chunk may be empty."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(chunks)
        short = [i for i, c in enumerate(chunks) if len(c) <= LONG]
        for i in set(range(len(chunks))) - set(short):
            symbols = np.array(self._one(self._symbols(chunks[i]).tolist()), np.int64)
            out[i] = self._as_ids(symbols, np.array([0, len(symbols)]))[0]
        if short:
            ends = np.cumsum([len(chunks[i]) for i in short])
            ids, bounds = self._as_ids(*self._many(self._symbols("".join([chunks[i] for i in short])), ends))
            for k, i in enumerate(short):
                out[i] = ids[bounds[k] : bounds[k + 1]]
        return out

    def _symbols(self, text: str) -> np.ndarray:
        return self._symbol_of[np.frombuffer(text.encode("utf-32-le"), np.uint32)]

    def text_of(self, ids: list[int]) -> str:
        """Surfaces joined, the first marker of the text kept; bytes that make no sign become U+FFFD."""
        out, run = [], bytearray()
        for i in ids:
            if (surface := self.surface[i]) is None:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_signs(bytes(run)))
                run.clear()
            out.append(surface)
        out.append(_signs(bytes(run)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """As ``text_of``, without the marker that encoding puts before a text."""
        for k, i in enumerate(ids):
            if self.surface[i] is None or i == self.unk:
                break
            if self.surface[i]:  # the first piece that shows
                text = self.text_of(ids[k:])
                return text[1:] if text.startswith(" ") else text
        return self.text_of(ids)

    def learn(self, chunks: list[str]) -> None:
        """Segment the chunks that aren't known yet."""
        new = [c for c in chunks if c not in self.known]
        if len(self.known) + len(new) > KNOWN_CHUNKS:
            self.known.clear()
            new = chunks
        for chunk, ids in zip(new, self.segment(new)):
            row = ids.tolist()
            self.known[chunk] = len(row), ",".join(map(str, row)), self.text_of(row)


def _signs(run: bytes) -> str:
    try:
        return run.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(run[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append(BAD_BYTE)
            at += 1
    return "".join(out)


def chunk_table(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct chunks of all texts; which of them stand in the texts, in order; each text's bounds."""
    texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), " ", MARK)
    texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar(MARK, pa.large_string()), texts, pa.scalar("", pa.large_string())))
    raw, offsets = flat(texts)
    a, b, c = MARK.encode()
    mark = np.zeros(len(raw), bool)
    if len(raw) > 2:
        mark[:-2] = (raw[:-2] == a) & (raw[1:-1] == b) & (raw[2:] == c)
    begins = mark.copy()
    begins[3:] &= ~mark[:-3]
    begins[offsets[:-1][offsets[:-1] < len(raw)]] = True
    starts = np.flatnonzero(begins)
    bounds = np.searchsorted(starts, offsets)
    ends = np.append(starts, len(raw)).astype(np.int64)
    chunks = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw)))
    coded = chunks.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), bounds


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column ``ids`` array<int>: the whole text's tokens, without begin or end; null gives none.

    A column of that name is replaced; all others and all rows stay.
    """
    def run(batches):
        known = pieces(path)
        for part in slices(batches, "__text", TABLE_BYTES):
            chunks, places, bounds = chunk_table(part.column("__text"))
            found = known.segment(chunks)
            sizes = np.array([len(f) for f in found], np.int64)
            starts, every = np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([*found, np.zeros(0, np.int64)])
            mine = sizes[places]
            cuts = np.concatenate([[0], np.cumsum(mine)])
            take = np.arange(cuts[-1]) + np.repeat(starts[places] - cuts[:-1], mine)
            rows = pa.ListArray.from_arrays(pa.array(cuts[bounds], pa.int32()), pa.array(every[take], pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], rows], [*part.schema.names[:-1], ids])

    kept = docs.drop(ids)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return docs.select(*kept.columns, F.col(text).alias("__text")).mapInArrow(run, f"{kinds}, `{ids}` array<int>")


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with a column ``text``, the decoded ``ids``; a null array gives null."""
    def run(batches):
        known = pieces(path)
        for part in batches:
            rows = [None if x is None else known.decode(x) for x in part.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(rows, pa.string())], [*part.schema.names[:-1], text])

    kept = docs.drop(text)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return docs.select(*kept.columns, F.col(ids).alias("__ids")).mapInArrow(run, f"{kinds}, `{text}` string")


def piece_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) for every row of ``docs``.

    The digests are those of the decimal ids joined by commas, and of the decoded text.  Null counts
    as empty: no tokens, the digests of an empty text.  Null and repeated keys stay as they are, other
    columns are ignored, an empty table gives an empty result.  Memory is bounded by a slice of
    texts, or one text, and KNOWN_CHUNKS chunks.
    """
    def run(batches):
        known = pieces(path)
        for part in slices(batches, most=TABLE_BYTES):
            chunks, places, bounds = chunk_table(part.column("text"))
            known.learn(chunks)
            table = [known.known[c] for c in chunks]
            sizes, names, texts = (list(x) for x in zip(*table)) if table else ([], [], [])
            counts = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64)[places])])[bounds]
            places, ids, decoded = places.tolist(), [], []
            for begin, end in zip(bounds, bounds[1:]):
                mine = places[begin:end]
                ids.append(hashlib.sha256(",".join([names[i] for i in mine]).encode()).hexdigest())
                decoded.append(hashlib.sha256("".join([texts[i] for i in mine])[1:].encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(np.diff(counts)), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        known.known.clear()  # the worker lives on

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", key)
