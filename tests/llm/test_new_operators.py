"""Whitening, the prefix trie and SentencePiece against brute force, the library and odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from loomframe.llm import prefix_trie, queries, sentencepieces, whitening
from tests.llm.test_llm import ODD, SF, none, odd  # noqa: F401


def test_pieces_equal_the_library():
    lib, mine = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES), sentencepieces.pieces(queries.PIECES)
    rng = random.Random(1)
    signs = "ab e▁ \n\tthe ing é日本ゼ梦😀ｆ́\x00 ünd  .,"
    texts = ["", " ", "  a  b ", "x" * 3000, "=" * 500, " " * 400 + "a" + " " * 50, "▁x", "<s></s><unk><0x41>", None]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 200))) for _ in range(1500)]
    chunks, places, bounds = sentencepieces.chunk_table(pa.array(texts))
    found = mine.segment(chunks)
    assert len(set(chunks)) == len(chunks)
    for i, text in enumerate(texts):
        ids = [k for p in places[bounds[i] : bounds[i + 1]] for k in found[p].tolist()]
        assert ids == lib.encode(text or "") and mine.decode(ids) == lib.decode(ids)
    for _ in range(5000):  # any ids, broken bytes too
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(3), rng.randrange(259, 32000), 0xE6, 0x84, 29871]) for _ in range(rng.randrange(9))]
        assert mine.decode(ids) == lib.decode(ids)


def test_piece_digests(spark, odd, none, monkeypatch):  # noqa: F811
    lib = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + [t for _, t, *_ in ODD]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in sentencepieces.piece_digests(df, queries.PIECES).collect()}
    both = {r.doc_id: r for r in sentencepieces.decode(sentencepieces.encode(df, queries.PIECES), queries.PIECES).collect()}
    for i, text in enumerate(texts):
        want = lib.encode(text or "")
        plain = lib.decode(want)
        assert (both[i].ids, both[i].decoded) == (want, plain) and got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(plain.encode()).hexdigest()
    assert sentencepieces.piece_digests(odd, queries.PIECES).count() == len(ODD) and sentencepieces.piece_digests(none, queries.PIECES).count() == 0


def slow_whitening(vectors, k=4):
    x = np.floor(256 * np.array(vectors, float)).astype(np.int64)
    u = np.unique(x, axis=0)
    n, sums = len(u), u.sum(axis=0)
    z = u - sums / n
    cov = z.T @ z / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ axes / np.sqrt(values), values / np.trace(cov)


def check_whitening(rows, keys, vectors, tolerance=1e-9):
    n, deviation, white, explained = slow_whitening(vectors)
    got = np.zeros(white.shape)
    at = {k: i for i, k in enumerate(keys)}
    for r in rows:
        i, c = at[r.vec_id], r.component - 1
        got[i, c] = r.whitened
        assert (r.n, r.deviation) == (n, deviation[i]) and abs(r.explained / explained[c] - 1) < 1e-9 and 0 <= r.identity_error < 1e-9
    got *= np.sign((got * white).sum(axis=0))  # either sign, the same for all rows
    assert len(rows) == white.size and np.abs(got - white).max() < tolerance


def test_whitening_of_the_given_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    data = table.select("vec_id", "embedding").collect()
    check_whitening(whitening.whiten(table).collect(), [r.vec_id for r in data], [r.embedding for r in data])


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    shape = "vec_id long, embedding array<float>, n string, x string, id string"
    fine = [(i, (rng.standard_normal(40) * np.linspace(3, 1, 40)).astype(np.float32).tolist()) for i in range(200)]
    fine += [(200 + i, fine[i % 3][1]) for i in range(30)] + [(None, fine[5][1]), (207, fine[8][1])]
    bad = [(900, None), (901, []), (902, [None] * 40), (903, [float("nan")] + [0.0] * 39), (904, [float("inf")] + [0.0] * 39), (905, [1.0] * 3), (906, [1e30] * 40)]
    rows = whitening.whiten(spark.createDataFrame([(*r, "c", "c", "c") for r in fine + bad], shape)).collect()
    assert {r.vec_id for r in rows} == {k for k, _ in fine} and len(rows) == 4 * len(fine)
    once = [r for r in fine if r[0] not in (None, 207)]
    by = [r for r in rows if r.vec_id not in (None, 207)]
    check_whitening(by, [k for k, _ in once], [v for _, v in once])
    frame = spark.createDataFrame([(*r, "c", "c", "c") for r in bad[:5]], shape)
    assert whitening.whiten(frame).count() == whitening.whiten(frame.limit(0)).count() == 0
    # one vector has no variance; two dimensions have two components; a constant dimension has none of its own
    alone = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained) for r in alone if r.vec_id == 1] == [(1, 1, 0, None, 0.0), (2, 1, 0, None, 0.0)]
    flat = whitening.whiten(spark.createDataFrame([(1, [0.0, 1.0]), (2, [2.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert sorted(abs(r.whitened) for r in flat if r.component == 1) == [1, 1] and all(r.whitened is None for r in flat if r.component == 2)


def test_large_entries_are_exact(spark):
    rows = [(i, [1e15 * i, -3e15, 7.0]) for i in range(3)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in got if r.vec_id == 1} == {0} and {r.deviation for r in got if r.vec_id == 0} == {None}


@pytest.mark.parametrize("values", [[9, 8, 7, 6, 5, 4, 3, 2] + [1] * 92, [1000] + [1.0 - k / 1e4 for k in range(99)], [5, 5, 5, 5] + [0] * 96])
def test_filtered_iteration_finds_the_leading_pairs(values):
    axes = np.linalg.qr(np.random.default_rng(1).standard_normal((100, 100)))[0]
    operator = axes * np.array(values, float) @ axes.T
    got, vectors = whitening.leading(lambda q: operator @ q, 100, 4)
    assert np.abs(got - sorted(values)[::-1][:4]).max() < 1e-10 * max(values)
    assert np.abs(operator @ vectors - vectors * got).max() < 1e-10 * max(values)


def slow_nodes(rows):
    convs, members, kids, ends = (defaultdict(list) for _ in range(4))
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    paths = {}
    for own in convs.values():
        own.sort()
    for c, own in convs.items():
        h, first = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c >= 0 else -1)
        paths[c] = tuple(t[1:] for t in convs.get(first, [])[:h] + own[h:])
        ends[paths[c]].append(c)
        for d in range(len(paths[c]) + 1):
            members[paths[c][:d]].append(c)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
        if p:
            kids[p[:-1]].append(p)
    name = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return {(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], name(p)) for p, m in members.items()}


def talks():
    rng, said = random.Random(5), [("u", "hi"), ("a", "x"), ("u", "yy"), ("u", "hi")] * 4
    for c in [*range(60), *range(100, 130), *range(-105, -95), 205, 206, 300]:
        for k in range(rng.choice([1, 2, 3, 4, 6, 8, 12, 13])):
            role, text = said[k] if rng.random() < 0.9 else (rng.choice("ua"), rng.choice(["q", "hi", None]))
            yield c, k if k else None, role, text, "clash", "clash"


TALK = "conv_id long, turn long, role string, text string, pos string, c string"


@pytest.mark.parametrize(("long", "shard", "cells"), [(1024, 50_000, 64 << 20), (1024, 20, 0), (4, 20, 64 << 20), (2, 3, 64 << 20)])
def test_trie_equals_brute_force(spark, monkeypatch, long, shard, cells):
    monkeypatch.setattr(prefix_trie, "LONG", long)
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", shard)
    monkeypatch.setattr("loomframe.llm.common.BROADCAST_BYTES", cells)
    rows = list(talks())
    got = [tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, TALK)).collect()]
    assert len(got) == len(set(got)) and set(got) == slow_nodes(rows)


def test_trie_of_odd_rows(spark):
    rows = [(None, 1, "u", "x"), (5, None, None, None), (5, 1, "u", ""), (5, 1, "u", ""), (7, 1, "u", "y" * 200_000), (99, 3, "a", "z"), (99, 3, "b", "a"), (100, 1, "", "")]
    rows = [(*r, "clash", "clash") for r in rows]
    frame = spark.createDataFrame(rows, TALK)
    got = [tuple(r) for r in prefix_trie.prefix_trie(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == slow_nodes(rows)
    assert prefix_trie.prefix_trie(frame.limit(0)).count() == prefix_trie.prefix_trie(frame.filter("conv_id is null")).count() == 0


def test_double_array_holds_exactly_the_given_edges():
    rng = np.random.default_rng(2)
    for _ in range(60):
        paths = sorted({tuple(rng.integers(0, rng.integers(1, 40), rng.integers(1, 6)).tolist()) for _ in range(rng.integers(1, 80))})
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in paths])])
        base, check = prefix_trie.pack(*prefix_trie.edges(np.array([t for p in paths for t in p]), bounds))
        known = {p[:d] for p in paths for d in range(len(p) + 1)}
        state, seen = {(): 0}, {0}
        for p in sorted(known, key=len):
            for t in range(40):
                at = base[state[p]] + t
                hit = 0 <= at < len(check) and check[at] == state[p]
                assert hit == ((*p, t) in known)
                if hit:
                    assert at not in seen
                    state[(*p, t)] = at
                    seen.add(at)
        assert len(seen) == len(known)


def test_new_queries_keep_whole_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert queries.op13_sentencepiece(spark, SF).select("doc_id").exceptAll(docs.select("doc_id")).isEmpty()
    assert queries.op11_whitening(spark, SF).groupBy("vec_id").count().filter(F.col("count") != 4).isEmpty()
