"""Token counts by section: whole documents are encoded once, and tokens go to sections by offsets.

A byte-level vocabulary gives each token the bytes it stands for, so that token spans are running
sums.  They are joined with the section spans as intervals.  A token that crosses a boundary goes
whole to the section that has most of its bytes, the earlier one in a tie.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import slices


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> tuple:
    """A tiktoken encoding of a rank file, and the number of bytes of each token."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def attribute(token_ends: np.ndarray, section_ends: np.ndarray) -> np.ndarray:
    """The section of each token, both given by the ends of spans that tile the same bytes from 0."""
    starts = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, token_ends - 1, side="right")
    for k in np.flatnonzero(first != last):
        inside = np.arange(first[k], last[k] + 1)
        begin = np.maximum(starts[k], np.where(inside > 0, section_ends[inside - 1], 0))
        first[k] = inside[np.argmax(np.minimum(token_ends[k], section_ends[inside]) - begin)]
    return first


def token_counts(
    docs: DataFrame, path: str, pattern: str, key: str = "doc_id", fields: tuple[str, ...] = ("text",), separator: str = "\n", by_line: bool = True
) -> DataFrame:
    """(key, n_tokens, n_crossing, sections) for every row of ``docs``.

    The document is ``fields`` joined by ``separator``; each field is a section, or with ``by_line``
    each line of it.  A separator and a line's end belong to the section before.  ``sections`` lists
    (field, start, end, n_tokens) in order, start and end in code points of the joined document; the
    counts add up to ``n_tokens``.  ``n_crossing`` counts the tokens that crossed a boundary.

    A null field counts as empty.  Empty fields, and thus documents without text, have no sections of
    their own; the separators' tokens then go by the same rule to what there is.  Null and repeated
    keys stay as they are, other columns are ignored, an empty table gives an empty result.
    """
    section = pa.struct([("field", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("n_tokens", pa.int32())])

    def spans(values: list[str]) -> list[tuple[str, str]]:
        """Sections of a document that tile it: their field and text."""
        out: list[tuple[str, str]] = []
        for k, (name, value) in enumerate(zip(fields, values)):
            lines = value.split("\n") if by_line else [value]
            parts = [x + "\n" for x in lines[:-1]] + [lines[-1]]
            out += [(name, x) for x in parts if x]
            if k + 1 < len(fields) and separator:
                out[-1:] = [(out[-1][0], out[-1][1] + separator)] if out else [(name, separator)]
        return out

    def run(batches):
        coder, sizes = vocabulary(path, pattern)
        for part in slices(batches, "f0"):
            totals, crossing, listed = [], [], []
            for values in zip(*(part.column(f"f{k}").to_pylist() for k in range(len(fields)))):
                tiles = spans([v or "" for v in values])
                tokens = np.array(coder.encode_ordinary("".join(t for _, t in tiles)), np.int64)
                ends = np.cumsum([len(t.encode()) for _, t in tiles]).astype(np.int64)
                points = np.concatenate([[0], np.cumsum([len(t) for _, t in tiles])]).astype(np.int64)
                token_ends = np.cumsum(sizes[tokens])
                counts = np.bincount(attribute(token_ends, ends), minlength=len(tiles)) if len(tokens) else np.zeros(len(tiles), np.int64)
                inner = np.searchsorted(token_ends, ends[:-1]) if len(tokens) else np.zeros(0, np.int64)
                totals.append(len(tokens))
                crossing.append(len(np.unique(inner[token_ends[inner] != ends[:-1]])) if len(inner) else 0)
                listed.append([(tiles[k][0], int(points[k]), int(points[k + 1]), int(n)) for k, n in enumerate(counts)])
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(totals, pa.int64()), pa.array(crossing, pa.int64()), pa.array(listed, pa.list_(section))],
                ["id", "n_tokens", "n_crossing", "sections"],
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), *[F.col(f).cast("string").alias(f"f{k}") for k, f in enumerate(fields)])
    return rows.mapInArrow(
        run, f"id {kind}, n_tokens long, n_crossing long, sections array<struct<field:string,start:int,end:int,n_tokens:int>>"
    ).withColumnRenamed("id", key)
