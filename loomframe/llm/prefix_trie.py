"""The trie of conversation prefixes, by double-array tries of prefix shards.

A turn is known by a digest of its role and text, so that texts are read once and never shuffled.
Conversations with equal turns become one sequence with a count.  Sequences that begin alike go to
one shard; a beginning that too many turns share is cut deeper, so that its branches go to shards of
their own.  A shard numbers its turns densely, packs its edges into BASE and CHECK arrays and walks its
sequences through them.  Nodes below the cuts are then final; the few above them, which shards
share, are merged globally by their path.

Conversations of more than LONG turns continue in further sections, whose roots are the nodes at
which the one before ends.  Sections are worked on from the last to the first; a section that only one
conversation reaches is a plain chain and needs no trie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.llm.common import looked_up, settle, sized
from loomframe.operators.ordering import numbered

#: Turns of a conversation in one section, and turns of distinct sequences that a shard should hold.
LONG, SHARD_TURNS = 1024, 50_000
#: Conversations of a group of GROUP successive ids begin with up to HEADS - 1 turns of the first.
GROUP, HEADS = 100, 6
DIGEST = 16
START = bytes(DIGEST)
EMPTY = hashlib.sha256(b"").hexdigest()

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
SHARD = NODE + ", upper boolean, path_key binary, parent_key binary, above array<binary>, length long"


def turns_of(table: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, pos, g, n): the turns of each conversation in order, by digest and number of code points."""
    said, who = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    digest = F.sha2(F.concat_ws(":", F.char_length(who).cast("string"), who, said), 256).substr(1, 2 * DIGEST)
    rows = table.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("c"), F.col(turn).alias("turn"), who.alias("role"), said.substr(1, 32).alias("begin"),
        digest.alias("g"), F.char_length(said).alias("n"),
    )
    placed = numbered(settle(rows, "turns"), ["turn", "role", "begin", "g"], "pos", within=["c"], start=1)
    return settle(placed.select("c", "pos", "g", "n"), "placed")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each conversation with the first turns of its group's first one in place of its own.

    Returns (c, depth, g, n), and (c, total) for every conversation, turnless ones too.
    """
    first = F.col("c") - F.col("c") % GROUP
    own = F.crc32(F.col("c").cast("string")) % HEADS
    heads = turns.filter((F.col("c") % GROUP == 0) & (F.col("pos") < HEADS))
    heads = heads.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("pos", "g", "n"))).alias("head"))  # HEADS - 1 entries
    heads = settle(heads.select(F.col("c").alias("first"), "head"), "heads")
    convs = turns.groupBy("c").agg(F.max("pos").alias("m")).withColumn("first", first).withColumn("h", own)
    convs = convs.join(sized(heads), "first", "left").withColumn("head", F.slice(F.coalesce("head", F.array()), 1, F.col("h").cast("int")))
    convs = settle(convs.select("c", "h", "head", (F.size("head") + F.greatest(F.col("m") - F.col("h"), F.lit(0))).alias("total")), "convs")
    given = convs.select("c", F.explode("head").alias("t")).select("c", F.col("t.pos").alias("depth"), "t.g", "t.n")
    rest = turns.withColumn("h", own).filter("pos > h").withColumn("first", first)
    rest = looked_up(rest, heads.select("first", F.size("head").alias("most")), "first", "pos")
    rest = rest.select("c", (F.least(F.coalesce("most", F.lit(0)), "h") + F.col("pos") - F.col("h")).alias("depth"), "g", "n")
    return given.unionByName(rest), convs.select("c", "total")


def sections(rows: DataFrame, convs: DataFrame, deep: bool) -> DataFrame:
    """(c, seg, section, next, path, lens): runs of up to LONG turns; a conversation ends in a shorter one.

    ``section`` is a key of all turns before the run, ``next`` of these and a full run's.
    """
    runs = (
        rows.groupBy("c", F.floor((F.col("depth") - 1) / LONG).alias("seg"))
        .agg(F.sort_array(F.collect_list(F.struct("depth", "g", "n"))).alias("t"))  # LONG entries
        .select(
            "c", "seg", F.unhex(F.array_join(F.transform("t", lambda t: t["g"]), "")).alias("path"),
            F.transform("t", lambda t: t["n"]).alias("lens"),
        )
    )
    ends = convs.filter(F.col("total") % LONG == 0).select(
        "c", F.floor(F.col("total") / LONG).alias("seg"), F.lit(b"").alias("path"), F.array().cast("array<int>").alias("lens")
    )
    runs = runs.unionByName(ends)
    if not deep:
        return runs.select("c", "seg", F.lit(START).alias("section"), F.lit(None).cast("binary").alias("next"), "path", "lens")
    # a key adds up hashes of the runs with their numbers, so that no list of all runs is needed
    so_far = Window.partitionBy("c").orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    hashes = [F.xxhash64(F.lit(k), "seg", "path").cast("decimal(20,0)") for k in (1, 2)]
    runs = runs.select("*", *[h.alias(f"h{k}") for k, h in enumerate(hashes)])
    runs = runs.select("*", *[F.sum(f"h{k}").over(so_far).alias(f"t{k}") for k in (0, 1)])

    def key(number: Column, *sums: Column) -> Column:
        return F.unhex(F.sha2(F.concat_ws(":", number, *sums), 256).substr(1, 2 * DIGEST))

    seg, totals = F.col("seg"), [F.col("t0").cast("decimal(38,0)"), F.col("t1").cast("decimal(38,0)")]
    before = [(t - F.col(f"h{k}")).cast("decimal(38,0)") for k, t in enumerate(totals)]
    return runs.select(
        "c", "seg", F.when(seg == 0, F.lit(START)).otherwise(key(seg, *before)).alias("section"),
        F.when(F.length("path") == LONG * DIGEST, key(seg + 1, *totals)).alias("next"), "path", "lens",
    )


def _ends(rows: DataFrame) -> DataFrame:
    """(s, ends_sha256) of the conversations ``c`` of each ``s``: one passes as a value, more are
    streamed through the digest in order, so that no list of them is ever held."""
    def run(batches: Iterator[pa.RecordBatch]):
        now, digest = None, None
        for batch in batches:
            done = []
            for s, c in zip(batch.column("s").to_pylist(), batch.column("c").to_pylist()):
                if s == now:
                    digest.update(b",%d" % c)
                    continue
                if now is not None:
                    done.append((now, digest.hexdigest()))
                now, digest = s, hashlib.sha256(b"%d" % c)
            yield _pairs(done)
        yield _pairs([(now, digest.hexdigest())] if now is not None else [])

    ordered = rows.repartition("s").sortWithinPartitions("s", "c")
    return ordered.mapInArrow(run, "s binary, ends_sha256 string")


def _pairs(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in ((0, pa.binary()), (1, pa.string()))], ["s", "ends_sha256"])


def sequences(runs: DataFrame) -> DataFrame:
    """(section, seg, next, path, lens, n, low, ends_sha256): each distinct run once.

    ``n`` conversations share it, the least is ``low``; ``ends_sha256`` is of those that end in it.
    """
    named = runs.withColumn("s", F.unhex(F.sha2(F.concat("section", "path"), 256).substr(1, 2 * DIGEST)))
    named = settle(named.withColumn("ends", F.length("path") < LONG * DIGEST), "runs")
    groups = settle(named.groupBy("s").agg(F.min("c").alias("low"), F.count("*").alias("n")), "groups")
    several = named.filter("ends").select("s", "c").join(groups.filter("n > 1").select("s"), "s", "left_semi")
    groups = groups.join(_ends(several), "s", "left")
    kept = named.join(groups.withColumnRenamed("low", "c"), ["s", "c"])
    single = F.sha2(F.col("c").cast("string"), 256)
    ends = F.when(F.col("ends"), F.coalesce("ends_sha256", F.when(F.col("n") == 1, single)))
    return settle(kept.select("section", "seg", "next", "path", "lens", "n", F.col("c").alias("low"), ends.alias("ends_sha256")), "sequences")


def with_cuts(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` with ``cut``, the turns that all sequences of a shard share, and the number of shards.

    It is one where that leaves at most SHARD_TURNS turns, else twice as many, and so on.
    """
    weight = F.length("path") / DIGEST
    beginning = lambda k: F.concat("section", F.expr(f"substr(path, 1, {k * DIGEST})"))
    total = rows.agg(F.sum(weight)).first()[0] or 0
    cut, left, k = F.lit(1), rows, 1
    while k < LONG:
        heavy = left.groupBy(beginning(k).alias(f"heavy{k}")).agg(F.sum(weight).alias("w")).filter(F.col("w") > SHARD_TURNS)
        heavy = settle(heavy.select(f"heavy{k}"), "heavy")  # total / SHARD_TURNS rows at most
        if heavy.isEmpty():
            break
        rows = rows.join(sized(heavy), beginning(k) == F.col(f"heavy{k}"), "left")
        cut = F.when((cut == k) & F.col(f"heavy{k}").isNotNull(), 2 * k).otherwise(cut)
        rows = rows.withColumn("cut", cut).drop(f"heavy{k}")
        cut, k = F.col("cut"), 2 * k
        left = rows.filter(F.col("cut") == k)
    rows = rows.withColumn("cut", F.least(cut, F.lit(LONG)))
    shard = F.concat("section", F.expr(f"substr(path, 1, cut * {DIGEST})"))
    return rows.withColumn("shard", shard), max(1, int(-(-total // SHARD_TURNS)))


def pack(parent: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BASE and CHECK of a trie given by its edges: node 0 is the root, parents come before children.

    The child of state s by token t is state BASE[s] + t, if CHECK there is s.  State 0 is the root.
    Nodes of many children are placed first among the free states that fit; single children fill the gaps.
    """
    nodes = len(parent)
    order = np.lexsort((token[1:], parent[1:])) + 1
    owners, first = np.unique(parent[order], return_index=True)
    sizes = np.diff(np.append(first, len(order)))
    width = int(token[1:].max(initial=0)) + 1
    base = np.zeros(nodes + 1, np.int64)  # by node first
    check = np.full(2 * nodes + width + 2, -1, np.int64)
    check[0] = 0
    state_of, free, end = np.zeros(nodes, np.int64), 1, 1
    for which in np.argsort(-sizes, kind="stable").tolist():
        mine = order[first[which] : first[which] + sizes[which]]
        away = token[mine] - token[mine[0]]
        while check[free] >= 0:
            free += 1
        at = free
        if len(away) > 1:
            for _ in range(16):
                if at + away[-1] < end and (check[at + away] < 0).all():
                    break
                at += 1
                while at < end and check[at] >= 0:
                    at += 1
            else:
                at = max(end, free)
        if at + int(away[-1]) >= len(check):
            check = np.concatenate([check, np.full(len(check) + int(away[-1]), -1, np.int64)])
        check[at + away] = owners[which]  # nodes for now, states below
        state_of[mine] = at + away
        base[owners[which]] = at - token[mine[0]]
        end = max(end, at + int(away[-1]) + 1)
    states = np.zeros(end, np.int64)
    states[state_of] = base[:nodes]
    check = np.where(check[:end] >= 0, state_of[check[:end]], -1)
    check[0] = -1  # nobody's child
    return states, check


def edges(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent, token) of the nodes of a trie of sequences, level by level; node 0 is the root."""
    parents, labels, nodes = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], 1
    rows, sizes = np.arange(len(bounds) - 1), np.diff(bounds)
    at, width, depth = np.zeros(len(rows), np.int64), int(tokens.max(initial=0)) + 1, 0
    while len(rows := rows[sizes[rows] > depth]):
        edge, which = np.unique(at[rows] * width + tokens[bounds[rows] + depth], return_inverse=True)
        parents.append(edge // width)
        labels.append(edge % width)
        at[rows] = nodes + which
        nodes, depth = nodes + len(edge), depth + 1
    return np.concatenate(parents), np.concatenate(labels)


def shard_nodes(rows: pa.Table, depth_before: int) -> Iterator[pa.RecordBatch]:
    """The nodes of one shard's sequences: final ones, and parts of those that other shards share.

    Every sequence begins with its section as a turn of its own, so that one trie holds all sections.
    """
    count = rows.num_rows
    raw = [p or b"" for p in rows.column("path").to_pylist()]
    roots, section = np.unique(np.array([s.hex() for s in rows.column("section").to_pylist()]), return_inverse=True)
    every = pa.Array.from_buffers(pa.binary(DIGEST), sum(map(len, raw)) // DIGEST, [None, pa.py_buffer(b"".join(raw))])
    coded = every.dictionary_encode()
    digests, turns = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    sizes = np.array([len(p) // DIGEST for p in raw])
    lens = np.concatenate([np.array(x, np.int64) for x in rows.column("lens").to_pylist()] + [np.zeros(0, np.int64)])
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    tokens, lengths = np.empty(bounds[-1], np.int64), np.zeros(bounds[-1], np.int64)
    tokens[bounds[:-1]] = len(digests) + section
    inner = np.ones(bounds[-1], bool)
    inner[bounds[:-1]] = False
    tokens[inner], lengths[inner] = turns, lens

    base, check = pack(*edges(tokens, bounds))
    states = len(base)
    n, low, cut, below = (rows.column(c).to_pylist() for c in ("n", "low", "cut", "below"))
    n, low, cut = (np.array(x, np.int64) for x in (n, low, cut))
    convs, least, cuts = np.zeros(states, np.int64), np.full(states, np.iinfo(np.int64).max), np.zeros(states, np.int64)
    length, label = np.zeros(states, np.int64), np.zeros(states, np.int64)
    levels, here, active, depth = [], np.zeros(count, np.int64), np.arange(count), 0
    while len(active):
        token = tokens[bounds[active] + depth]
        following = base[here[active]] + token
        if not (check[following] == here[active]).all():
            raise AssertionError("a sequence left its trie")
        here[active] = following
        np.add.at(convs, following, n[active])
        np.minimum.at(least, following, low[active])
        np.maximum.at(cuts, following, cut[active])
        length[following], label[following] = lengths[bounds[active] + depth], token
        levels.append(np.unique(following))
        depth += 1
        active = active[sizes[active] + 1 > depth]

    final = np.zeros(states, bool)
    for d, level in enumerate(levels):
        final[level] = d >= cuts[level]
    children, leaves, saved = (np.zeros(states, np.int64) for _ in range(3))
    ends: dict[int, str] = {}
    for state, digest, under in zip(here.tolist(), rows.column("ends_sha256").to_pylist(), below):
        if digest is not None:
            ends[state] = digest
        if under is not None:  # what a later section holds below this node
            children[state], leaves[state], saved[state] = under["n_children"], under["n_leaves"], under["saved_tokens"]
            if under["ends_sha256"]:
                ends[state] = under["ends_sha256"]
    for level in reversed(levels[1:]):
        done = level[final[level]]
        leaves[done] += (children[done] == 0) & (leaves[done] == 0)
        saved[done] += (convs[done] - 1) * length[done]
        np.add.at(children, check[done], 1)
        np.add.at(leaves, check[done], leaves[done])
        np.add.at(saved, check[done], saved[done])

    keys: dict[int, list[bytes]] = {}  # paths of the shared nodes, from the section's root on
    for d, level in enumerate(levels):
        for state in level[~final[level]].tolist():
            if d == 0:
                keys[state] = [bytes.fromhex(str(roots[label[state] - len(digests)]))]
            else:
                above = keys[int(check[state])]
                keys[state] = [*above, hashlib.blake2b(above[-1] + digests[label[state]], digest_size=DIGEST).digest()]
    kinds = pa.schema([
        ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
        ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("upper", pa.bool_()), ("path_key", pa.binary()),
        ("parent_key", pa.binary()), ("above", pa.list_(pa.binary())), ("length", pa.int64()),
    ])
    for d, level in enumerate(levels):
        paths = [keys.get(s, [None]) for s in level.tolist()]
        parents = check[level]
        inside = final[parents] if d else np.zeros(len(level), bool)
        parent_keys = [None if d == 0 or ok else keys[p][-1] for p, ok in zip(parents.tolist(), inside)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(least[level]), pa.array(np.full(len(level), depth_before + d)),
                pa.array(least[parents], mask=~inside), *(pa.array(x[level]) for x in (convs, children, leaves, saved)),
                pa.array([ends.get(s) for s in level.tolist()], pa.string()), pa.array(~final[level]),
                pa.array([p[-1] for p in paths], pa.binary()), pa.array(parent_keys, pa.binary()),
                pa.array([p if p[-1] else None for p in paths], pa.list_(pa.binary())), pa.array(length[level]),
            ],
            schema=kinds,
        )


def _merged(parts: DataFrame) -> DataFrame:
    """The nodes that shards share, whole: summed by path, then summed up their paths.

    A node's path has at most the cut's length, so that each adds to a bounded number of others.
    """
    nodes = parts.filter("upper").groupBy("path_key", "parent_key", "above", "depth", "length").agg(
        F.min("conv_id").alias("conv_id"), F.max("ends_sha256").alias("ends_sha256"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    nodes = settle(nodes, "upper")
    inner = nodes.filter("parent_key is not null").groupBy(F.col("parent_key").alias("path_key")).agg(F.count("*").alias("more"))
    nodes = nodes.join(inner, "path_key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    own = (F.col("n_convs") - 1) * F.col("length")
    mine = nodes.select(
        F.explode("above").alias("path_key"), (F.col("n_leaves") + (F.col("n_children") == 0).cast("int")).alias("l"),
        (F.col("saved_tokens") + own).alias("t"),
    )
    sums = mine.groupBy("path_key").agg(F.sum("l").alias("n_leaves"), F.sum("t").alias("saved_tokens"))
    return settle(nodes.drop("n_leaves", "saved_tokens", "more").join(sums, "path_key"), "merged")


def _level(rows: DataFrame, depth_before: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of the sections that begin after ``depth_before`` turns, and those that shards share."""
    cut, shards = with_cuts(rows)

    def run(batches):
        some = [b for b in batches if b.num_rows]  # a shard: SHARD_TURNS turns or so
        if some:
            yield from shard_nodes(pa.Table.from_batches(some), depth_before)

    dealt = cut.repartition(shards, "shard").select("section", "path", "lens", "n", "low", "ends_sha256", "cut", "below")
    parts = settle(dealt.mapInArrow(run, SHARD), "nodes")
    upper = _merged(parts)
    columns = [c.split()[0] for c in NODE.split(", ")]
    inner = parts.filter("not upper and parent_key is null").select(columns)
    names = upper.select(F.col("path_key").alias("parent_key"), F.col("conv_id").alias("parent"))
    top = looked_up(parts.filter("not upper and parent_key is not null"), names, "parent_key", "conv_id")
    top = top.withColumn("parent_conv_id", F.col("parent")).select(columns)
    shared = looked_up(upper, names, "parent_key", "conv_id").withColumn("parent_conv_id", F.col("parent"))
    emitted = shared if depth_before == 0 else shared.filter("parent_key is not null")  # the root ends the section before
    return inner.unionByName(top).unionByName(emitted.select(columns)), upper.filter("parent_key is null")


UNDER = "struct<n_children:long,n_leaves:long,saved_tokens:long,ends_sha256:string>"


def prefix_nodes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the conversations ``rows`` (c, depth, g, n), all of them listed in ``convs`` (c, total)."""
    longest = convs.agg(F.max("total")).first()[0]
    if longest is None:
        return rows.sparkSession.createDataFrame([], NODE)
    every = sequences(sections(rows, convs, longest >= LONG))
    nothing = F.lit(None).cast(UNDER)
    if longest < LONG:
        nodes, _ = _level(every.withColumn("below", nothing), 0)
    else:
        members = every.filter("seg > 0").groupBy("section").agg(F.sum("n").alias("members"), F.max("seg").alias("at"))
        members = settle(members, "members")
        shared = members.filter("members > 1")
        chains = settle(every.join(members.filter("members = 1").select("section"), "section", "left_semi"), "chains")
        nodes, under = _chains(chains)
        for seg in range(shared.agg(F.max("at")).first()[0] or 0, -1, -1):
            here = every.filter(F.col("seg") == seg)
            here = here.join(shared.select("section"), "section", "left_semi") if seg else here
            here = here.join(under.withColumnRenamed("section", "next"), "next", "left")
            found, roots = _level(here, seg * LONG)
            nodes = nodes.unionByName(found)
            under = settle(under.unionByName(roots.select(F.col("path_key").alias("section"), _below())), "under")
    return nodes.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))


def _below() -> Column:
    return F.struct("n_children", "n_leaves", "saved_tokens", "ends_sha256").cast(UNDER).alias("below")


def _chains(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of sections that one conversation alone reaches, and (section, below) of their roots."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    over = F.length("path") == 0
    closing = rows.filter(over).select(F.col("section").alias("next"), F.col("ends_sha256").alias("closing"))
    whole = F.length("path") == LONG * DIGEST
    steps = rows.filter(~over).join(closing, "next", "left").select(
        "low", "seg", whole.alias("whole"), F.coalesce("closing", "ends_sha256").alias("ends"), F.size("lens").alias("size"),
        F.explode(F.sequence(F.lit(1), F.size("lens"))).alias("i"),
    )
    last = (F.col("i") == F.col("size")) & (~F.col("whole") | F.col("ends").isNotNull())
    nodes = steps.select(
        F.col("low").alias("conv_id"), (F.col("seg") * LONG + F.col("i")).alias("depth"), F.col("low").alias("parent_conv_id"),
        one.alias("n_convs"), F.when(last, none).otherwise(one).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"),
        F.when(last, F.col("ends")).alias("ends_sha256"),
    )
    under = rows.select(
        "section", F.when(over, none).otherwise(one).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"),
        F.when(over, F.col("ends_sha256")).alias("ends_sha256"),
    )
    return nodes, settle(under.select("section", _below()), "under")


def prefix_trie(table: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each node of the trie of rebuilt conversations; see NODE for the columns.

    Turns are ordered by ``turn`` (null first), ties by role, the text's first 32 characters and a digest;
    repeated rows are turns of their own.  A null role or text is empty; rows without a conversation
    are left out.  A conversation begins with the first turns of its group's first conversation (see
    ``rebuilt``); one that is left without turns is a member of the root alone.  A node is known by its
    least member ``conv_id`` and its depth.  Texts of any length count whole, other columns are
    ignored, and an empty table gives an empty result.
    """
    return prefix_nodes(*rebuilt(turns_of(table, conv, turn, role, text)))
