"""Secrets in texts, with corpus-wide ownership of each credential.

A candidate that many repositories or owners share is an example out of some manual; one that stays
with a single owner looks live.  Ownership is counted over the whole corpus, by hash.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import looked_up, settle, slices

# The patterns of the contract, with the group that is the secret and its least length.
KINDS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?((?-i:[A-Za-z0-9+/_.=-]+))""", re.A | re.I), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
#: A hex run is found by its minimum, which gives the same runs and passes over short ones at once.
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Texts without any of these have no assignment.
_WORDS = re.compile(r"passw(?:or)?d|secret|token|api_?key", re.A | re.I)

Span = tuple[int, int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, kind number, end, value): leftmost non-overlapping matches of each kind, in order."""
    out: list[Span] = []
    for number, (_, pattern, group, least) in enumerate(KINDS):
        if number == 0 and not _WORDS.search(text) or number == 1 and "AKIA" not in text:
            continue
        for m in (_HEX if number == 2 else pattern).finditer(text):
            if len(m[group]) >= least:
                out.append((m.start(), number, m.end(), m[group]))
    return sorted(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k][0]}:{a}:{b}" for a, k, b, _ in spans)


def candidates(docs: DataFrame, key: str, text: str, owner: str, repository: str | None) -> DataFrame:
    """(row, id, owner, repository, counts, base, base_sha256, found) by one pass over the texts.

    ``found`` lists each candidate: where its value lies, and the value's SHA-256 (never the value).
    """
    def run(batches):
        for part in slices(batches):
            columns: list[list] = [[], [], [], [], [], []]
            for t in part.column("text").to_pylist():
                t = t or ""
                spans = base_spans(t)
                base = joined(spans)
                found = []
                for start, _, end, value in spans:
                    at = end - len(value)
                    found.append({"at": at, "end": end, "start": start, "hash": hashlib.sha256(value.encode()).digest()})
                for k in range(3):
                    columns[k].append(sum(s[1] == k for s in spans))
                columns[3].append(base)
                columns[4].append(hashlib.sha256(base.encode()).hexdigest())
                columns[5].append(found)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.list_(pa.struct([("at", pa.int32()), ("end", pa.int32()), ("start", pa.int32()), ("hash", pa.binary())]))]
            names = ["n_assign", "n_access", "n_hex", "base", "base_sha256", "found"]
            kept = [part.column(c) for c in ("row", "id", "owner", "repository")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, k) for c, k in zip(columns, kinds))], ["row", "id", "owner", "repository", *names])

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.col(owner).cast("string").alias("owner"),
        (F.md5(F.col(text).cast("binary")) if repository is None else F.col(repository).cast("string")).alias("repository"), F.col(text).alias("text"),
    )
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(
        run,
        f"row long, id {kind}, owner string, repository string, n_assign long, n_access long, n_hex long, base string, "
        "base_sha256 string, found array<struct<at:int,end:int,start:int,hash:binary>>",
    )


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repositories) of a table (hash, owner, repository); null names count as one.

    Distinct names are formed before anything is counted, and each step combines rows before its
    shuffle, so that a hash in a third of all rows is no hot key.
    """
    pairs = found.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    owners = pairs.groupBy("hash", "owner").agg(F.count("*").alias("k"))
    repositories = pairs.groupBy("hash", "repository").agg(F.count("*").alias("k"))
    return owners.groupBy("hash").agg(F.count("*").alias("n_owners")).join(
        repositories.groupBy("hash").agg(F.count("*").alias("n_repositories")), "hash"
    )


def find_secrets(
    docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", repository: str | None = None, most_owners: int = 1,
    most_repositories: int = 3,
) -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied) for every row of ``docs``.

    Base spans are those of KINDS, written as kind:start:end in code points with an exclusive end.
    Without a column that names the repository, each distinct text is one, so that copies of a
    document count once.  A candidate whose value belongs to at most ``most_owners`` owners and ``most_repositories``
    repositories of the corpus looks live: ``spans`` also has ``live:start:end`` of its value, in
    order of start, base spans first.  ``n_copied`` counts the other candidates.

    Null texts count as empty: no spans, the digest of an empty text.  Null owners are one owner, as
    are null repositories.  Null and repeated keys stay, each row is judged by itself; other columns
    are ignored; an empty table gives an empty result.
    """
    drawn = settle(candidates(docs, key, text, owner, repository), "secrets")
    each = drawn.filter(F.size("found") > 0).select("row", "owner", "repository", F.explode("found").alias("f"))
    each = each.select("row", "owner", "repository", "f.at", "f.end", "f.hash")
    owned = ownership(each.select("hash", "owner", "repository"))
    single = settle(owned.filter((F.col("n_owners") <= most_owners) & (F.col("n_repositories") <= most_repositories)).select("hash"), "live")
    # the live spans of a row: a text's own candidates, whose number its length bounds
    known = looked_up(each, single.withColumn("yes", F.lit(True)), "hash", "row").filter("yes")  # a hash may be in any share of the rows
    live = known.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("at", "end"))).alias("live"), F.count("*").alias("n_live"))
    rows = drawn.withColumn("n", F.size("found")).drop("owner", "repository", "found").join(live, "row", "left")

    place = lambda s: F.split(s, ":")
    listed = F.transform(
        F.filter(F.split("base", ","), lambda s: s != ""),
        lambda s, i: F.struct(place(s)[1].cast("int").alias("at"), F.lit(0).alias("late"), i.alias("turn"), s.alias("span")),
    )
    added = F.transform(
        F.coalesce("live", F.array().cast("array<struct<at:int,end:int>>")),
        lambda x, i: F.struct(x["at"].alias("at"), F.lit(1).alias("late"), i.alias("turn"), F.concat_ws(":", F.lit("live"), x["at"], x["end"]).alias("span")),
    )
    spans = F.array_join(F.transform(F.array_sort(F.concat(listed, added)), lambda x: x["span"]), ",")
    n_live = F.coalesce("n_live", F.lit(0)).cast("long")
    return rows.select(
        F.col("id").alias(key), "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"), n_live.alias("n_live"),
        (F.col("n") - n_live).cast("long").alias("n_copied"),
    )
