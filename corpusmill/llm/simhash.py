"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint's bits are cut into segments of two bits and mapped to the segments' bit counts. The Manhattan distance of two
such vectors is a lower bound of the Hamming distance. The segments form ``max_distance // 2 + 1`` blocks; of two vectors
within the distance, one block at least lies within Manhattan distance 1 (or 0, for three differing bits of four blocks).
The blocks are the grids of a range join: each fingerprint is a member of its own cell in each grid and looks into the
cells one step up; the pairs of a cell are compared by the whole bound and then exactly. Each cell gives only the edges of a
spanning forest, whose components are those of all links. Cells of many members are cut into chunks, so that a large family
of near copies is spread over tasks, and lookers are taken in batches.

Copies cost nothing here: the join sees each fingerprint once, whatever number of documents has it.

Edge cases: a null or empty text, or one of white space only, has fingerprint zero and is linked like any other; fewer words
than a shingle are one shingle. Repeated rows share a fingerprint and a component. A null id is no one's smallest id; a
component of null ids only has a null component_id. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, partitions, text_slices
from .components import connected_components

SHINGLE, SEED, MAX_DISTANCE, SEGMENT = 4, 42, 4, 2
#: Candidate pairs that are compared at once.
PAIRS_AT_ONCE = 2_000_000
#: Members of a cell that one task compares with the cell's lookers, and rows of a cell that it holds, at most about.
CHUNK, ROWS_AT_ONCE = 2_048, 200_000
#: Cells cut into chunks whose number goes to every task at once, at most; more of them are joined by a shuffle.
BROADCAST_CELLS = 100_000


def _fingerprint(text: str, shingle: int, seed: int) -> int:
    import xxhash

    words = text.encode().lower().split()  # of bytes: only A-Z change, and only ASCII white space splits
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 50_000):
        spans = zip(starts[at : min(n, at + 50_000)].tolist(), last[at : at + 50_000].tolist())
        hashes = np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in spans]), np.uint8)
        ones += np.unpackbits(hashes.reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """The columns ``keep`` and fingerprint, the 64 bits as a signed long, which replaces a kept column of its name."""
    keep = tuple(c for c in dict.fromkeys(keep) if c != "fingerprint")
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("fingerprint", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut, texts in text_slices(batches, text):
            yield pa.RecordBatch.from_arrays([*(cut.column(c) for c in keep), pa.array([_fingerprint(t, shingle, seed) for t in texts], pa.int64())], names=[*keep, "fingerprint"])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def popcounts(bits: np.ndarray) -> np.ndarray:
    """The bit counts of the 32 two-bit segments, packed into as many two-bit fields."""
    return bits - ((bits >> np.uint64(1)) & np.uint64(0x5555555555555555))


def grid_cells(bits: np.ndarray, max_distance: int = MAX_DISTANCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, position in bits, whether a look from a neighbouring cell). Two vectors whose block differs by one step share
    the upper one's cell."""
    counts, blocks = popcounts(bits), max_distance // 2 + 1
    rows = np.arange(len(bits))
    bounds = [round(k * 32 / blocks) for k in range(blocks + 1)]
    cells, at, looks = [], [], []
    for k, (low, high) in enumerate(zip(bounds, bounds[1:])):
        mask = np.uint64(((1 << 2 * (high - low)) - 1) << 2 * low)
        block = counts & mask
        name = lambda c, k=k, low=low: ((c >> np.uint64(2 * low)) | (np.uint64(k) << np.uint64(58))).view(np.int64)
        cells.append(name(block)), at.append(rows), looks.append(np.zeros(len(rows), bool))
        for s in range(low, high):
            up = rows[(counts >> np.uint64(2 * s)) & np.uint64(3) < 2]
            cells.append(name(block[up] + (np.uint64(1) << np.uint64(2 * s)))), at.append(up), looks.append(np.ones(len(up), bool))
    return np.concatenate(cells), np.concatenate(at), np.concatenate(looks)


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that each of ``n`` numbers reaches over links between ``a`` and ``b``."""
    label = np.arange(n)
    while True:
        old = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == old).all():
            return label


def _forest(cell: np.ndarray, bits: np.ndarray, look: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the links within cells connect. Rows are sorted by cell, members first."""
    n = len(cell)
    new = np.concatenate([[True], cell[1:] != cell[:-1]])
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    members = np.add.reduceat((~look).astype(np.int64), first)[group]
    start = first[group]
    partners = np.where(look, members, np.arange(n) - start)  # a look meets all members, a member those before it
    counts = popcounts(bits)
    one = np.uint64(0x5555555555555555)
    distinct, number = np.unique(bits, return_inverse=True)
    found_a, found_b = np.empty(0, np.int64), np.empty(0, np.int64)
    ends = np.cumsum(partners)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        k = partners[at:to]
        a = np.repeat(np.arange(at, to), k)
        b = np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k) + start[a]
        p, q = counts[a], counts[b]
        # fields hold 0, 1 or 2: the bits of |p - q| are p ^ q but for 1 against 2, whose difference is 1
        both = p ^ q
        high, low = (both >> np.uint64(1)) & one, both & one
        bound = np.bitwise_count(low).astype(np.int64) + 2 * np.bitwise_count(high & ~low)
        near = np.flatnonzero(bound <= max_distance)
        near = near[np.bitwise_count(bits[a[near]] ^ bits[b[near]]) <= max_distance]
        found_a, found_b = np.append(found_a, number[a[near]]), np.append(found_b, number[b[near]])
        if len(found_a) > PAIRS_AT_ONCE:  # what they connect is all that counts
            label = _labels(len(distinct), found_a, found_b)
            found_a = np.flatnonzero(label != np.arange(len(distinct)))
            found_b = label[found_a]
        at = to
    label = _labels(len(distinct), found_a, found_b)
    moved = np.flatnonzero(label != np.arange(len(distinct)))
    return distinct[moved], distinct[label[moved]]


def links(distinct: DataFrame, max_distance: int = MAX_DISTANCE, chunk: int = CHUNK) -> DataFrame:
    """Of distinct fingerprints (one long column), edges (u, v) whose components are those of all links. A cell of more than
    ``chunk`` members is cut into chunks, each of which its lookers meet, and the members of later chunks as well."""
    name = distinct.columns[0]

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                bits = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).view(np.uint64)
                cell, row, look = grid_cells(bits, max_distance)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(look), pa.array(bits[row].view(np.int64))], names=["cell", "look", "bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def edges(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            u, v = _forest(*rows, max_distance)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cell, part, look, bits = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            new = np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1])) + 1
            # a cell's chunks are cells of their own; a number that rises tells them apart
            number = np.zeros(len(cell), np.int64)
            number[new] = 1
            number = np.cumsum(number)
            if held and (held[-1][3], held[-1][4]) != (cell[0], part[0]):
                number += 1
            number += held[-1][0][-1] if held else 0
            rows = (number, bits.view(np.uint64), look)
            last = int(new[-1]) if len(new) else 0
            if last or (held and held[-1][0][-1] != number[0]):
                whole = [h[:3] for h in held] + [tuple(x[:last] for x in rows)]
                yield edges(tuple(np.concatenate(x) for x in zip(*whole)))
                held = []
            held.append((*(x[last:] for x in rows), cell[-1], part[-1]))
            if sum(len(h[0]) for h in held) > ROWS_AT_ONCE and look[-1]:  # all members are here; lookers go on
                whole = tuple(np.concatenate(x) for x in zip(*(h[:3] for h in held)))
                yield edges(whole)
                held = [(*(x[~whole[2]] for x in whole), cell[-1], part[-1])]
        if held:
            yield edges(tuple(np.concatenate(x) for x in zip(*(h[:3] for h in held))))

    cells = distinct.select(F.col(name)).mapInArrow(embed, "cell long, look boolean, bits long")
    full = checkpoint(cells.filter("NOT look").groupBy("cell").agg(F.ceil(F.count("*") / chunk).cast("int").alias("parts")).filter("parts > 1"))
    full = F.broadcast(full) if full.count() <= BROADCAST_CELLS else full
    # a member is in one chunk and looks into those before it, a looker into all
    own = F.pmod(F.xxhash64("bits"), F.col("parts")).cast("int")
    none = F.array(F.struct(F.lit(0).alias("part"), F.col("look")))
    some = F.when(F.col("look"), F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(p.alias("part"), F.lit(True).alias("look")))).otherwise(
        F.transform(F.sequence(F.lit(0), own), lambda p: F.struct(p.alias("part"), (p < own).alias("look")))
    )
    met = cells.join(full, "cell", "left").select("cell", "bits", F.explode(F.when(F.col("parts").isNull(), none).otherwise(some)).alias("x"))
    met = met.select("cell", F.col("x.part").alias("part"), F.col("x.look").alias("look"), "bits")
    dealt = met.repartition(partitions(distinct.sparkSession), "cell", "part").sortWithinPartitions("cell", "part", "look")
    return dealt.mapInArrow(join, "u long, v long")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_distance: int = MAX_DISTANCE, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the smallest doc_id reachable over links, itself included."""
    prints = checkpoint(fingerprints(docs, text, (doc_id,), shingle, seed))
    firsts = checkpoint(prints.groupBy("fingerprint").agg(F.min(doc_id).alias("first")))
    nodes = connected_components(links(firsts.select("fingerprint"), max_distance))
    least = firsts.join(nodes.withColumnRenamed("node", "fingerprint"), "fingerprint").groupBy("component").agg(F.min("first").alias("least"))
    moved = nodes.join(least, "component").select(F.col("node").alias("fingerprint"), "least")
    classes = checkpoint(firsts.join(moved, "fingerprint", "left").select("fingerprint", F.coalesce("least", "first").alias("component_id")))
    return prints.join(classes, "fingerprint").select(doc_id, "fingerprint", "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents, with all their columns, but for those with a smaller doc_id in their component. Rows that repeat the
    smallest doc_id all stay; rows with a null doc_id stay."""
    found = near_duplicates(docs, text, doc_id, **options).filter(F.col(doc_id) != F.col("component_id")).select(doc_id).distinct()
    return docs.join(found, doc_id, "left_anti")
