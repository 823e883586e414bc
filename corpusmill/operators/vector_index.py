"""Approximate nearest vectors: cells whose number grows with the square root of the rows, product-quantised residuals, and
exact distances for a short list.

A row is a cell, a byte for each few dimensions and a number. Its squared distance from a query is the query's from the cell's
centre, plus the row's own number, less an inner product that adds up from one table of the query's; so vectors are read
for short lists alone, and rows of cells that a query does not visit are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import stored
from .vector import BROADCAST_QUERIES, _best, squared_l2

#: Rows that centres and codebooks are fitted on, at most; a cell has 16 of them, so there are at most 4 096 cells.
SAMPLE, ROWS_OF_A_CELL = 1 << 16, 16
#: Dimensions behind one byte of a code; sampled rows that tell how many cells a query visits; candidates held between two cuts.
DIMS_OF_A_BYTE, ASKED, HELD = 4, 256, 1 << 20


class VectorIndex(NamedTuple):
    centres: np.ndarray  #: cells x dimensions, dimensions filled up with zeros to whole bytes of a code
    books: np.ndarray  #: bytes of a code x words x dimensions
    probes: int  #: cells that a query visits
    codes: DataFrame  #: (cell, id, code, own), in ranges of cells


def _off(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of rows from points, less the rows' own squares."""
    return np.einsum("pd,pd->p", points, points) - 2 * (rows @ points.T)


def _nearest(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.concatenate([_off(rows[at : at + 4096], points).argmin(1) for at in range(0, len(rows), 4096)]) if len(rows) else np.empty(0, np.int64)


def _k_means(rows: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    points = rows[np.random.default_rng(seed).permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(rows, points)
        order = np.argsort(near, kind="stable")
        filled, starts, n = np.unique(near[order], return_index=True, return_counts=True)
        points[filled] = np.add.reduceat(rows[order], starts) / n[:, None]
    return points


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column without nulls as a matrix with at least ``dims`` columns, those that rows don't have being 0."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1)
    return np.pad(flat, ((0, 0), (0, dims - flat.shape[1])))


def _codes(rows: np.ndarray, centres: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row its cell, its code, and what of its distance no query has a part in."""
    cells = _nearest(rows, centres)
    rest = rows - centres[cells]
    width = books.shape[2]
    code = np.stack([_nearest(rest[:, j * width : (j + 1) * width], book) for j, book in enumerate(books)], 1).astype(np.uint8)
    near = np.concatenate([book[code[:, j]] for j, book in enumerate(books)], 1)
    return cells, code, (near * near).sum(1) + 2 * (near * centres[cells]).sum(1)


def _visited(sample: np.ndarray, centres: np.ndarray, reach: float, k: int) -> int:
    """Cells that hold the share ``reach`` of the nearest of some sampled rows. Of all rows the nearest are no farther away."""
    asked = sample[:ASKED]
    off = _off(asked, sample)
    off[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    near = np.argsort(off, 1)[:, : min(k, len(sample) - 1)]
    place = np.argsort(np.argsort(_off(asked, centres), 1), 1)
    return int(np.quantile(np.take_along_axis(place, _nearest(sample, centres)[near], 1), reach, method="higher")) + 1 if near.size else len(centres)


def _usable(vectors: DataFrame) -> DataFrame:
    v = F.col("vector")
    return vectors.filter(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))


def build_index(vectors: DataFrame, reach: float = 0.95, k: int = 10, sample: int = SAMPLE, seed: int = 3) -> VectorIndex | None:
    """An index of (id, vector), all of one length; vectors that are null or hold null or non-finite numbers are left out. None
    without any vectors. Cells and codebooks are fitted on a bounded sample, all rows are coded."""
    rows = _usable(vectors.select("id", "vector"))
    n = rows.count()
    if not n:
        return None
    taken = rows.select(F.xxhash64("id").alias("h"), "vector").orderBy("h").limit(sample).toArrow()["vector"].combine_chunks()
    dims = len(taken[0])
    parts = -(-dims // DIMS_OF_A_BYTE)
    some = _matrix(taken, parts * DIMS_OF_A_BYTE)
    centres = _k_means(some, min(int(np.ceil(np.sqrt(n))), max(1, len(some) // ROWS_OF_A_CELL)), seed)
    rest = (some - centres[_nearest(some, centres)]).reshape(len(some), parts, DIMS_OF_A_BYTE)
    books = np.stack([_k_means(np.ascontiguousarray(rest[:, j]), 256, seed) for j in range(parts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells, code, own = _codes(_matrix(batch.column("vector"), centres.shape[1]), centres, books)
                yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), batch.column("id"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(own.astype(np.float32))], ["cell", "id", "code", "own"])

    coded = rows.mapInArrow(run, f"cell int, id {dict(rows.dtypes)['id']}, code binary, own float")
    # ranges by id too, so that a cell of any size is spread
    return VectorIndex(centres, books, _visited(some, centres, reach, k), stored(coded.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id"), "codes"))


def _shortlists(index: VectorIndex, asked: np.ndarray, most: int):
    """A function from coded rows, a cell's side by side, to (query, id, off): for each query of the given matrix the ``most``
    nearest that the task has seen, by coded distance."""
    centres, books, probes = index.centres, index.books, index.probes
    off = _off(asked, centres)
    near = np.argpartition(off, min(probes, len(centres)) - 1, 1)[:, :probes]
    cell = near.ravel()
    order = np.argsort(cell, kind="stable")
    visitors, begin = np.repeat(np.arange(len(asked)), near.shape[1])[order], np.searchsorted(cell[order], np.arange(len(centres) + 1))
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.stack([-2 * (book @ asked[:, j * width : (j + 1) * width].T) for j, book in enumerate(books)])
        bound = np.full(len(asked), np.inf, np.float32)
        held: list[tuple] = []

        def nearest() -> tuple:
            q, ids, d = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((d, q))
            q, ids, d = q[order], ids[order], d[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            full = place == most - 1
            bound[q[full]] = d[full]
            return tuple(x[place < most] for x in (q, ids, d))

        for batch in batches:
            cells = batch.column("cell").to_numpy()
            ids = np.array(batch.column("id").to_pylist(), object)
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(cells), len(books))
            own = batch.column("own").to_numpy()
            edges = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)] if len(cells) else [0]
            for lo, hi in zip(edges, edges[1:]):
                c = cells[lo]
                who = visitors[begin[c] : begin[c + 1]]
                some = tables[:, :, who]
                for at in range(lo, hi, 1024):
                    part = slice(at, min(at + 1024, hi))
                    d = own[part, None] + off[who, c]
                    for j in range(len(books)):
                        d += some[j][code[part, j]]
                    row, q = np.nonzero(d < bound[who])
                    held.append((who[q], ids[part][row], d[row, q].astype(np.float32)))
                    if sum(len(x[0]) for x in held[1:]) > HELD:
                        held = [nearest()]
        if held:
            q, ids, d = nearest()
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(ids.tolist(), batch.schema.field("id").type), pa.array(d)], ["query", "id", "off"])

    return run


def search(index: VectorIndex, vectors: DataFrame, queries: DataFrame, k: int = 10, shortlist: int | None = None, within: DataFrame | None = None) -> DataFrame:
    """(query_id, id, distance, score, rank) like vector.knn(), of the nearest ``shortlist`` rows by coded distance (10 k if not
    given) in the cells that a query visits. ``vectors`` are what is indexed; of them ``within``, with an id, names those that
    may be found. Queries with unusable vectors find nothing; rows that repeat a query's id are one query."""
    most = shortlist or 10 * k
    asked = _usable(queries.select("query_id", "vector")).groupBy("query_id").agg(F.min("vector").alias("query"))
    asked = stored(asked.withColumn("h", F.xxhash64("query_id")), "asked")
    blocks = max(1, -(-asked.count() // BROADCAST_QUERIES))
    codes = index.codes
    if within is not None:
        codes = codes.join(within.select("id"), "id", "left_semi").select(*codes.columns).sortWithinPartitions("cell")
    found = []
    for b in range(blocks):
        # a block of queries is numbered and goes to every task; so do its short lists
        block = asked.filter(F.pmod("h", F.lit(blocks)) == b).toArrow()
        if not block.num_rows:
            continue
        matrix = _matrix(block["query"].combine_chunks(), index.centres.shape[1])
        names = vectors.sparkSession.createDataFrame(block.select(["query_id", "query"]).append_column("number", pa.array(np.arange(block.num_rows, dtype=np.int32))))
        lists = codes.mapInArrow(_shortlists(index, matrix, most), f"query int, id {dict(codes.dtypes)['id']}, off float")
        lists = _best(lists.select(F.col("query").alias("query_id"), "id", F.col("off").alias("distance")), most).select(F.col("query_id").alias("number"), "id")
        pairs = _usable(vectors.select("id", "vector")).join(F.broadcast(stored(lists, "shortlists")), "id").join(F.broadcast(names), "number")
        found.append(_best(pairs.select("query_id", "id", squared_l2("vector", "query").alias("distance")), k))
    return reduce(DataFrame.unionByName, found) if found else _nothing(vectors, queries, k)


def _nothing(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    pairs = vectors.select("id", "vector").limit(0).join(queries.select("query_id", F.col("vector").alias("query")).limit(0))
    return _best(pairs.select("query_id", "id", squared_l2("vector", "query").alias("distance")), k)


def knn_quantised(vectors: DataFrame, queries: DataFrame, k: int = 10, where: str | Column | None = None, shortlist: int | None = None, reach: float = 0.95) -> DataFrame:
    """Nearest rows after the filter by an index of their own; see search()."""
    if where is not None:
        vectors = vectors.filter(where)
    index = build_index(vectors, reach, k)
    return search(index, vectors, queries, k, shortlist) if index else _nothing(vectors, queries, k)
