"""Embedding near-duplicates by an inverted multi-index.

Two codebooks, one for each half of the unit vectors, are fitted on a bounded sample; their product is a grid of cells, and
every vector is a member of its nearest cell. A vector visits the grid's cells in the order of multi-sequence traversal, by
the sum of its halves' distances to the cell's two centroids, as many as a vector at exactly the threshold needs to be met
with the target recall; that number comes from the sample too. The pair (a, b), a < b, is met once, where a visits b's cell,
and verified in double precision. A cell's pairs are counted as matrix products of members and visitors; no pair leaves its
task, only each vector's number of links and the edges of a spanning forest.

Exact copies are one row with a multiplicity. A cell's members are cut into chunks and its visitors into crowds, and every
crowd meets every chunk in a task's group of its own, so neither a group of copies nor a dense cell lands in one task.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components and rows with a null label link with
nothing: n_links 0, component_id their own id. So do rows with a null id, whose component_id is null. Vectors of
different dimensions don't link; each dimension has an index of its own. Rows that repeat an id are vectors of their own that link with each
other. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, partitions, written
from .components import connected_components

MIN_COSINE, TARGET_RECALL, SAMPLE, CHUNK = 0.93, 0.98, 8_000, 512
#: Codewords of a half, and numbers of the sample that codebooks are fitted on, at most.
MAX_BOOK, SAMPLE_VALUES = 2_048, 1 << 24


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def codebook(points: np.ndarray, size: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids by k-means, from randomly chosen points."""
    rng = np.random.default_rng(seed)
    centroids = points[rng.choice(len(points), min(size, len(points)), replace=False)].copy()
    for _ in range(rounds):
        nearest = distances(points, centroids).argmin(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        n = np.bincount(nearest, minlength=len(centroids))
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of each point to each centroid."""
    return (points**2).sum(1)[:, None] - 2 * points @ centroids.T + (centroids**2).sum(1)[None]


class MultiIndex:
    """The product grid of two codebooks."""

    def __init__(self, sample: np.ndarray, size: int):
        self.half = max(1, sample.shape[1] // 2)
        self.books = [codebook(sample[:, : self.half], size), codebook(sample[:, self.half :], size)] if sample.shape[1] > 1 else [codebook(sample, size), np.zeros((1, 0))]

    def _parts(self, vectors: np.ndarray) -> list[np.ndarray]:
        return [distances(vectors[:, : self.half], self.books[0]), distances(vectors[:, self.half :], self.books[1])]

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """The nearest cell of each vector."""
        a, b = (d.argmin(1) for d in self._parts(vectors))
        return a * len(self.books[1]) + b

    def traverse(self, vectors: np.ndarray, visits: int) -> np.ndarray:
        """The first cells of each vector's multi-sequence traversal, nearest first. A cell at places i and j of the two
        sorted sequences comes after (i+1)(j+1)-1 others, so only cells with (i+1)(j+1) <= visits can be among them."""
        first, second = self._parts(vectors)
        order_a, order_b = first.argsort(1), second.argsort(1)
        sorted_a, sorted_b = np.take_along_axis(first, order_a, 1), np.take_along_axis(second, order_b, 1)
        places = [(i, j) for i in range(first.shape[1]) for j in range(second.shape[1]) if (i + 1) * (j + 1) <= visits]
        i, j = np.array(places).T
        nearest = (sorted_a[:, i] + sorted_b[:, j]).argsort(1, kind="stable")[:, :visits]
        return np.take_along_axis(order_a[:, i] * second.shape[1] + order_b[:, j], nearest, 1)

    def visits_for(self, sample: np.ndarray, min_cosine: float, recall: float, seed: int = 11) -> int:
        """Cells to visit so that partners at exactly ``min_cosine``, in random directions, are met with this recall. A
        partner's cell comes after as many cells as have smaller sums of distances."""
        rng = np.random.default_rng(seed)
        noise = rng.standard_normal(sample.shape)
        noise -= (noise * sample).sum(1, keepdims=True) * sample
        norms = np.linalg.norm(noise, axis=1, keepdims=True)
        partners = min_cosine * sample + math.sqrt(1 - min_cosine**2) * noise / np.where(norms > 0, norms, 1)
        wanted = self.cells(partners)
        first, second = self._parts(sample)
        rows = np.arange(len(sample))
        limit = first[rows, wanted // second.shape[1]] + second[rows, wanted % second.shape[1]]
        rank = [int(np.searchsorted(np.sort(b), d - a).sum()) for a, b, d in zip(first, second, limit)]
        return int(np.quantile(rank, recall, method="higher")) + 1


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _meet(members: np.ndarray, member_ids: np.ndarray, member_n: np.ndarray, visitors: np.ndarray, visitor_ids: np.ndarray, visitor_n: np.ndarray, min_cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, links, root) of the vectors that link here; roots connect what the links connect."""
    near = (visitors @ members.T >= min_cosine) & (visitor_ids[:, None] < member_ids[None])
    a, b = np.nonzero(near)
    if not len(a):
        return (np.empty(0, np.int64),) * 3
    ids, of = np.unique(np.concatenate([visitor_ids[a], member_ids[b]]), return_inverse=True)
    a_of, b_of = of[: len(a)], of[len(a) :]
    links = np.bincount(a_of, member_n[b], len(ids)) + np.bincount(b_of, visitor_n[a], len(ids))
    label = np.arange(len(ids))
    while True:
        old = label.copy()
        least = np.minimum(label[a_of], label[b_of])
        np.minimum.at(label, a_of, least)
        np.minimum.at(label, b_of, least)
        label = label[label]
        if (label == old).all():
            return ids, links.astype(np.int64), ids[label]


def _met(reps: DataFrame, total: int, dim: int, min_cosine: float, target_recall: float, sample: int, codebook_size: int | None, chunk: int) -> DataFrame:
    """(rep, links, root) of linked vectors, found by an index over ``reps``, different vectors of one dimension."""
    spark = reps.sparkSession
    size = codebook_size or min(MAX_BOOK, max(4, 2 ** math.ceil(math.log2(total) / 2 - 4)))
    sample = max(1, min(max(sample, 16 * size), SAMPLE_VALUES // dim))
    taken = reps.select("vector", F.xxhash64("rep").alias("h")).orderBy("h").limit(sample).toArrow().column("vector").combine_chunks()
    taken = unit(_matrix(taken))
    index = MultiIndex(taken, size)
    visits = index.visits_for(taken[:2_000], min_cosine, target_recall)
    shared = spark.sparkContext.broadcast(index)
    kind = reps.schema["vector"].dataType
    placed = T.StructType([reps.schema["label"], T.StructField("cell", T.IntegerType()), T.StructField("visitor", T.BooleanType()), T.StructField("rep", T.LongType()), T.StructField("n", T.LongType()), T.StructField("vector", kind)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                cut = batch.slice(at, 512)
                points = unit(_matrix(cut.column("vector")))
                cells = np.concatenate([grid.cells(points)[:, None], grid.traverse(points, visits)], 1)
                row = pa.array(np.repeat(np.arange(len(points)), cells.shape[1]))
                visitor = np.tile(np.arange(cells.shape[1]) > 0, len(points))
                yield pa.RecordBatch.from_arrays([cut.column("label").take(row), pa.array(cells.ravel(), pa.int32()), pa.array(visitor), cut.column("rep").take(row), cut.column("n").take(row), cut.column("vector").take(row)], names=placed.names)

    met = reps.select("label", F.col("rep").cast("long").alias("rep"), F.col("n").cast("long").alias("n"), "vector").mapInArrow(place, placed)
    count = lambda what, n: F.ceil(F.count_if(what) / n).cast("int")
    sizes = met.groupBy("label", "cell").agg(count(~F.col("visitor"), chunk).alias("chunks"), count(F.col("visitor"), 4 * chunk).alias("crowds")).filter("chunks > 1 OR crowds > 1")
    # a cell's members are cut into chunks and its visitors into crowds, each of which meets each chunk
    ways = lambda n: F.sequence(F.lit(0), F.greatest(F.coalesce(n, F.lit(1)), F.lit(1)) - 1)
    own = lambda n: F.pmod(F.xxhash64("rep"), F.greatest(F.coalesce(n, F.lit(1)), F.lit(1))).cast("int")
    met = met.join(checkpoint(sizes), ["label", "cell"], "left")
    met = met.withColumn("other", F.explode(F.when(F.col("visitor"), ways(F.col("chunks"))).otherwise(ways(F.col("crowds")))))
    met = met.withColumns({"chunk": F.when(F.col("visitor"), F.col("other")).otherwise(own(F.col("chunks"))), "crowd": F.when(F.col("visitor"), own(F.col("crowds"))).otherwise(F.col("other"))})
    group = ["label", "cell", "chunk", "crowd"]
    dealt = met.select(*group, "visitor", "rep", "n", "vector").repartition(partitions(spark), *group).sortWithinPartitions(*group, "visitor")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                cut = batch.slice(at, 1024)
                names = list(zip(*(cut.column(c).to_pylist() for c in group), cut.column("visitor").to_pylist()))
                edges = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
                for a, b in zip(edges, edges[1:]):
                    part = cut.slice(a, b - a)
                    rows = unit(_matrix(part.column("vector"))), part.column("rep").to_numpy(), part.column("n").to_numpy()
                    if now != names[a][:4]:
                        now, members = names[a][:4], []
                    if not names[a][4]:
                        members.append(rows)
                    elif members:
                        if len(members) > 1:
                            members = [tuple(np.concatenate(x) for x in zip(*members))]
                        ids, links, roots = _meet(*members[0], *rows, min_cosine)
                        if len(ids):
                            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(roots)], names=["rep", "links", "root"])

    return dealt.mapInArrow(verify, "rep long, links long, root long")


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", min_cosine: float = MIN_COSINE, target_recall: float = TARGET_RECALL, sample: int = SAMPLE, codebook_size: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """(vec_id, n_links, component_id). ``sample`` or sixteen vectors a codeword, the more of them, bound the
    vectors on which codebooks and visits are fitted; every vector is indexed. ``codebook_size`` grows with the square root of
    the number of vectors, up to ``MAX_BOOK``, unless given."""
    spark = vectors.sparkSession
    vectors = vectors.select(F.col(vec_id).alias("vec"), F.col(embedding).alias("vector"), F.col(label).alias("label"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    usable = F.col("vec").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    keys = [F.xxhash64("label", "vector").alias("k1"), F.xxhash64(F.lit(1), "label", "vector").alias("k2")]
    alone = vectors.filter(~usable).select("vec", F.lit(0).cast("long").alias("n_links"), F.col("vec").alias("component_id"))
    rows = vectors.filter(usable)
    known = checkpoint(rows.select("vec", *keys))
    copies = rows.select("vec", "label", "vector", *keys).groupBy("k1", "k2").agg(F.min("vec").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    stored = written(copies.withColumn("dim", F.size("vector")), "vectors")
    dims = stored.groupBy("dim").count().orderBy("dim").collect()  # one row for each length of vectors
    if not dims:
        return alone.select(F.col("vec").alias(vec_id), "n_links", "component_id")
    met = [_met(stored.filter(F.col("dim") == d.dim), d["count"], d.dim, min_cosine, target_recall, sample, codebook_size, chunk) for d in dims]
    found = checkpoint(reduce(DataFrame.unionByName, met))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = connected_components(found.select("rep", "root")).select(F.col("node").alias("rep"), "component")
    result = checkpoint(
        stored.select("k1", "k2", "rep", "n")
        .join(links, "rep", "left")
        .join(classes, "rep", "left")
        .select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    linked = known.join(result, ["k1", "k2"]).select("vec", "n_links", "component_id")
    return linked.unionByName(alone).select(F.col("vec").alias(vec_id), "n_links", "component_id")
