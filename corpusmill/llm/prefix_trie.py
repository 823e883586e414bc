"""A prefix trie of conversations from vertical bitmaps.

Turns are named by a 128-bit digest of role and text, so that texts don't travel. Conversations are dealt out by ranges of
their ids and cut into shards of a bounded size. A shard indexes (position, turn) to the bitset of its conversations that have
that turn there. Depth first, the intersection of a node's bitset with the postings of its next turns yields the children;
its popcount counts members, its lowest bit names the smallest one, and the bits of conversations of just that depth are the
node's ends. A node is named by a chain of digests over its turns, so the nodes of all shards are merged by name.

Sums over subtrees are taken in the shards again: every node counts in the shard of its smallest member alone, a shard's
nodes are numbered in depth-first order, and so a subtree is a stretch of numbers. The stretches' sums are merged by name.

A conversation of more than ``long`` turns is a shard of its own whose chain of nodes is given out as its turns are read;
nothing of it is held. Lists of ends are hashed piece by piece, as they are sorted by node and shard, and never put together.

Edge cases: a null role or text is empty. Turns of one number follow each other by digest, those without a number come first;
repeated rows are turns of their own. Rows without a conv_id are left out. Of an empty table there is no node, not even a
root. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, written

#: Conversations and turns of a shard, at most about, and turns beyond which a conversation is a shard of its own.
SHARD, SHARD_TURNS, LONG = 1_024, 100_000, 50_000
#: Conversations that share a head: groups of so many ids begin with up to so many turns, less one, of the group's first.
HEADS = (5, 9)
ROOT = bytes(16)
_ROWS = 50_000
_NODES = pa.schema([("shard", pa.int64()), ("number", pa.int64()), ("last", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()), ("turn", pa.binary()), ("depth", pa.int64()), ("bytes", pa.int64()), ("n_convs", pa.int64()), ("conv_id", pa.int64()), ("ends", pa.string())])
_NODES_SQL = "shard long, number long, last long, key binary, parent binary, turn binary, depth long, bytes long, n_convs long, conv_id long, ends string"

Turn = tuple[bytes, int]


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.filter("conv_id IS NOT NULL")
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").alias("turn_no"), F.unhex(F.left(digest, F.lit(32))).alias("turn"), role.alias("role"), text.alias("text"))


def turn_texts(conversations: DataFrame) -> DataFrame:
    """(turn, role, text): what the digests of a trie's turns stand for."""
    return _turns(conversations).select("turn", "role", "text").dropDuplicates(["turn"])


def _child(key: bytes, turn: bytes) -> bytes:
    return hashlib.blake2b(key + turn, digest_size=16).digest()


def shard_nodes(convs: list[tuple[int, list[Turn]]]) -> list[tuple]:
    """The nodes of a shard's conversations, which come by ascending id, in depth-first order, as rows of ``_NODES``."""
    postings: dict[tuple[int, bytes], int] = defaultdict(int)
    ended: dict[int, int] = defaultdict(int)
    for k, (_, turns) in enumerate(convs):
        for at, (turn, _) in enumerate(turns):
            postings[at, turn] |= 1 << k
        ended[len(turns)] |= 1 << k
    shard, rows = convs[0][0], []
    stack = [((1 << len(convs)) - 1, 0, ROOT, None, None, 0)]
    while stack:
        members, depth, key, parent, turn, size = stack.pop()
        ends, bits = [], members & ended.get(depth, 0)
        rest = members ^ bits
        while bits:
            low = bits & -bits
            ends.append(convs[low.bit_length() - 1][0])
            bits ^= low
        first = convs[(members & -members).bit_length() - 1][0]
        rows.append([shard, len(rows), None, key, parent, turn, depth, size, members.bit_count(), first, ",".join(map(str, ends)) or None])
        children = []
        while rest:
            turn, size = convs[(rest & -rest).bit_length() - 1][1][depth]
            child = members & postings[depth, turn]
            children.append((child, depth + 1, _child(key, turn), key, turn, size))
            rest &= ~child
        stack.extend(reversed(children))
    open_nodes: list[list] = []
    for row in [*rows, [shard, len(rows), None, None, None, None, -1]]:
        while open_nodes and open_nodes[-1][6] >= row[6]:
            open_nodes.pop()[2] = row[1] - 1
        open_nodes.append(row)
    return rows


def chain_nodes(conv_id: int, turns: Iterator[Turn]) -> Iterator[tuple]:
    """The nodes of one conversation, one after the other; ``last`` is null for all: each subtree is the rest."""
    key, parent, turn, size, depth, nxt = ROOT, None, None, 0, 0, next(turns, None)
    while True:
        yield (conv_id, depth, None, key, parent, turn, depth, size, 1, conv_id, None if nxt else str(conv_id))
        if nxt is None:
            return
        turn, size = nxt
        key, parent, depth, nxt = _child(key, turn), key, depth + 1, next(turns, None)


def _nodes(heads: tuple[int, int] | None, shard: int, shard_turns: int, long: int):
    """A function from record batches (grp, conv_id, head, turn, bytes), sorted, to batches of nodes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        flat = chain.from_iterable(zip(*(b.column(c).to_pylist() for c in ("grp", "conv_id", "head", "turn", "bytes"))) for b in batches)
        held: list[tuple[int, list[Turn]]] = []
        n_turns = 0
        for group, members in groupby(flat, itemgetter(0)):
            if held and (len(held) >= shard or n_turns >= shard_turns):
                yield from shard_nodes(sorted(held))
                held, n_turns = [], 0
            base: list[Turn] = []
            for conv_id, own in groupby(members, itemgetter(1)):
                first = next(own)
                turns = ((r[3], r[4]) for r in chain([first], own))
                if heads:
                    if conv_id == group:  # it comes first
                        base = list(islice(turns, heads[1] - 1))
                        turns = chain(base, turns)
                    else:
                        turns = chain(base[: first[2]], islice(turns, first[2], None))
                some = list(islice(turns, long + 1))
                if len(some) > long:
                    yield from chain_nodes(conv_id, chain(some, turns))
                else:
                    held.append((conv_id, some))
                    n_turns += len(some)
        if held:
            yield from shard_nodes(sorted(held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = rows(batches)
        while part := list(islice(found, _ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), _NODES.types)], schema=_NODES)

    return run


def _subtree_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (shard, number, last, key, leaves, saved), each shard's from the last number down, (key, leaves, saved) summed
    over the numbers from a row's own to its last. Of a shard, the running sums are held, but none of a chain."""
    shard, seen = None, np.zeros((1, 2), np.int64)
    for batch in batches:
        shards = batch.column("shard").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for a, b in zip(edges, edges[1:]) if len(shards) else []:
            part = batch.slice(a, b - a)
            if shards[a] != shard:
                shard, seen = shards[a], np.zeros((1, 2), np.int64)
            own = np.stack([part.column(c).to_numpy() for c in ("leaves", "saved")], 1)
            sums = seen[-1] + np.cumsum(own, 0)
            if part.column("last").null_count:
                out, seen = sums, sums[-1:]
            else:
                seen = np.concatenate([seen, sums])  # the sum of k rows stands at place k
                end = len(seen) - 1 + int(part.column("number")[-1].as_py())  # of all rows of the shard
                out = sums - seen[end - 1 - part.column("last").to_numpy()]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(out[:, 0]), pa.array(out[:, 1])], ["key", "leaves", "saved"])


def _hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, ends), a key's in order, (key, ends_sha256) of all its ends, comma-joined."""
    key, state, out = None, None, []
    for batch in batches:
        for k, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if k != key:
                if key is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(ends.encode())
            else:
                state.update(b"," + ends.encode())
        if len(out) >= _ROWS:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*out))), ["key", "ends_sha256"])
            out = []
    if key is not None:
        out.append((key, state.hexdigest()))
        yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*out))), ["key", "ends_sha256"])


@dataclass
class Trie:
    """``nodes``: key, parent (the parent's key), turn (the last turn's digest), depth, bytes (of the last turn's text), n_convs,
    conv_id (the smallest member), n_children. ``local`` has a shard's share of a node; ``ends`` (key, shard, ends) the ids of
    conversations that end there, comma-joined."""

    nodes: DataFrame
    local: DataFrame

    @property
    def ends(self) -> DataFrame:
        return self.local.filter("ends IS NOT NULL").select("key", "shard", "ends")

    def subtrees(self) -> DataFrame:
        """(key, n_leaves, saved_tokens): childless nodes of each subtree, and the bytes of its turns that members share."""
        facts = self.nodes.select("key", F.col("conv_id").alias("owner"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saves"), (F.col("n_children") == 0).cast("long").alias("leaf"))
        own = lambda c: F.when(F.col("conv_id") == F.col("owner"), F.col(c)).otherwise(F.lit(0)).cast("long")
        weighed = self.local.select("shard", "number", "last", "key", "conv_id").join(facts, "key").select("shard", "number", "last", "key", own("leaf").alias("leaves"), own("saves").alias("saved"))
        ordered = weighed.repartition(partitions(weighed.sparkSession), "shard").sortWithinPartitions("shard", F.desc("number"))
        sums = ordered.mapInArrow(_subtree_sums, "key binary, leaves long, saved long")
        return sums.groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    def ends_hashed(self) -> DataFrame:
        """(key, ends_sha256) of nodes with ends, the ids ascending."""
        ordered = self.ends.repartition(partitions(self.nodes.sparkSession), "key").sortWithinPartitions("key", "shard").select("key", "ends")
        return ordered.mapInArrow(_hashed_ends, "key binary, ends_sha256 string")

    def report(self) -> DataFrame:
        """One row of each node with all of it."""
        parents = self.nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
        out = self.nodes.join(self.subtrees(), "key").join(self.ends_hashed(), "key", "left").join(parents, "parent", "left")
        return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))


def build(conversations: DataFrame, heads: tuple[int, int] | None = HEADS, shard: int = SHARD, shard_turns: int = SHARD_TURNS, long: int = LONG) -> Trie:
    """The trie of conversations (conv_id, turn, role, text). With ``heads`` (g, m), conversation c begins with the first h
    turns of conversation c - c % g, all if it has fewer, in place of its own first h; h is the unsigned crc32 of c in
    decimal, modulo m. Without, conversations are taken as they are."""
    spark = conversations.sparkSession
    conv = F.col("conv_id")
    group = conv - conv % heads[0] if heads else conv
    head = F.crc32(conv.cast("string").cast("binary")) % heads[1] if heads else F.lit(0).cast("long")
    rows = _turns(conversations).select(group.alias("grp"), "conv_id", head.alias("head"), "turn_no", "turn", F.octet_length("text").cast("long").alias("bytes"))
    ordered = rows.repartitionByRange(partitions(spark), "grp").sortWithinPartitions("grp", conv != F.col("grp"), "conv_id", F.asc_nulls_first("turn_no"), "turn")
    ordered = ordered.select("grp", "conv_id", "head", "turn", "bytes")
    local = written(ordered.mapInArrow(_nodes(heads, shard, shard_turns, long), _NODES_SQL), "trie-local")
    merged = local.groupBy("key").agg(*(F.first(c).alias(c) for c in ("parent", "turn", "depth", "bytes")), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    merged = written(merged, "trie-merged")
    children = merged.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = merged.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    return Trie(written(nodes, "trie-nodes"), local)
