"""Exact nearest vectors for a set of queries, and embedding and prompting jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import scratch_path, stored

#: Queries that go to every task at once, at most; numbers of them, at most unless one has more; products held at once, about.
BROADCAST_QUERIES, BROADCAST_NUMBERS, _AT_ONCE = 10_000, 1 << 23, 1 << 22


def squared_l2(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda acc, x: acc + x)


def similarity(distance: Column) -> Column:
    return F.round(1 / (1 + distance), 4)


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query. Spark limits the groups in each task before the shuffle too (WindowGroupLimit)."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).withColumn("score", similarity(F.col("distance")))


class _Nearest:
    """The k nearest rows of each query, so far: by distance, then by id."""

    def __init__(self, queries: np.ndarray, k: int) -> None:
        self.q, self.k = queries, k
        self.norms = (queries * queries).sum(1)
        self.distance, self.id = np.full((len(queries), k), np.inf), np.full((len(queries), k), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """Products tell which rows can be among the nearest; those are measured term by term, in the order of the dimensions."""
        norms = (rows * rows).sum(1)
        # far more than products of doubles can be wrong by
        slack = 1e-12 * rows.shape[1] * (norms.max() + self.norms) + 1e-300
        near = self.norms[:, None] + norms - 2 * (self.q @ rows.T)
        bound = self.distance[:, -1]
        if len(ids) > self.k and not np.isfinite(bound).all():
            bound = np.minimum(bound, np.partition(near, self.k - 1, axis=1)[:, self.k - 1] + slack)
        at, row = np.nonzero(near <= (bound + slack)[:, None])
        if not len(at):
            return
        exact = np.zeros(len(at))
        for j in range(rows.shape[1]):
            exact += (rows[row, j] - self.q[at, j]) ** 2
        open_ = np.unique(at)
        place = np.searchsorted(open_, at)
        q = np.concatenate([np.repeat(np.arange(len(open_)), self.k), place])
        d, i = np.concatenate([self.distance[open_].ravel(), exact]), np.concatenate([self.id[open_].ravel(), ids[row]])
        order = np.lexsort((i, d, q))
        begin = np.searchsorted(q[order], np.arange(len(open_)))
        best = order[begin[:, None] + np.arange(self.k)]
        self.distance[open_], self.id[open_] = d[best], i[best]


def _even(vectors: DataFrame, queries: DataFrame) -> int:
    """The length of all vectors, if they and their ids can be searched by products, else 0."""
    whole = lambda frame, c: isinstance(frame.schema[c].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    if not whole(vectors, "id") or not whole(queries, "query_id"):
        return 0
    fine = lambda c, v: F.col(c).isNotNull() & F.forall(v, lambda x: F.abs(x.cast("double")) < 1e100)
    seen = [frame.agg(F.min(F.size("vector")), F.max(F.size("vector")), F.bool_and(F.coalesce(fine(c, "vector"), F.lit(False))), F.countDistinct(c) if c == "query_id" else F.lit(0), F.count("*")).first() for frame, c in ((vectors, "id"), (queries, "query_id"))]
    least, most = min(r[0] or 0 for r in seen), max(r[1] or 0 for r in seen)
    return least if 0 < least == most and all(r[2] for r in seen) and seen[1][3] == seen[1][4] else 0


def _nearest(vectors: DataFrame, names: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """(query_id, id, distance): of each task's rows that have the queries' length and no gaps, the k nearest of each query."""
    shared = vectors.sparkSession.sparkContext.broadcast((names, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries = shared.value
        step = max(1, _AT_ONCE // max(1, len(queries)))
        best = _Nearest(queries, k)
        for batch in batches:
            ids, flat = batch.column("id").to_numpy(), batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            flat = flat.reshape(len(ids), queries.shape[1])
            for at in range(0, len(ids), step):
                best.add(ids[at : at + step], flat[at : at + step])
        there = best.distance < np.inf
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, there.sum(1))), pa.array(best.id[there]), pa.array(best.distance[there])], ["query_id", "id", "distance"])

    return vectors.mapInArrow(run, "query_id long, id long, distance double")


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, where: str | Column | None = None) -> DataFrame:
    """(query_id, id, distance, score, rank): the nearest rows by squared Euclidean distance, after the filter.

    Tables whose ids are whole numbers and whose vectors are all of one length, without gaps, nulls, infinite or huge numbers,
    are searched by products of matrices, blocks of queries going to all tasks; others row by row.
    """
    if where is not None:
        vectors = vectors.filter(where)
    length = _even(vectors, queries)
    if length:
        many = max(1, min(BROADCAST_QUERIES, BROADCAST_NUMBERS // length))
        side = queries.select("query_id", "vector")
        blocks = -(-side.count() // many)
        if blocks > 1:  # by ranges of their hashes, so that no block is much larger than the others
            side = stored(side.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(2 * blocks))), "queries")
        # dealt anew, as few files may hold all rows
        dealt = stored(vectors.select(F.col("id").cast("long"), "vector").repartition(side.sparkSession.sparkContext.defaultParallelism), "vectors")
        out, kind = scratch_path(side.sparkSession, "nearest"), "query_id long, id long, distance double"
        for part in [side.filter(F.col("block") == b) for b in range(2 * blocks)] if blocks > 1 else [side]:
            rows = part.select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>")).toArrow().combine_chunks()
            if rows.num_rows:
                of = rows.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, length)
                _nearest(dealt, rows.column("query_id").to_numpy(), of, k).write.mode("append").parquet(out)
        found = side.sparkSession.read.schema(kind).parquet(out).select(F.col("query_id").cast(queries.schema["query_id"].dataType), F.col("id").cast(vectors.schema["id"].dataType), "distance")
        return _best(found, k)
    side = queries.select("query_id", F.col("vector").alias("query"))
    blocks = max(1, -(-side.count() // BROADCAST_QUERIES))
    if blocks > 1:  # by ranges of their hashes, so that no block is much larger than the others
        side = stored(side.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(2 * blocks))), "queries")
    parts = [side.filter(F.col("block") == b).drop("block") for b in range(2 * blocks)] if blocks > 1 else [side]
    # every block of queries goes to all tasks and meets all rows
    found = [_best(vectors.select("id", "vector").join(F.broadcast(q)).select("query_id", "id", squared_l2("vector", "query").alias("distance")), k) for q in parts]
    return reduce(DataFrame.unionByName, found)


def embed(passages: DataFrame, model: Callable[[list[str]], list[list[float]]], text: str = "passage", batch: int = 32, prefix: str = "") -> DataFrame:
    """Adds vector, from a function of the user's that maps a batch of texts to vectors."""
    schema = T.StructType([*passages.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors: list[list[float]] = []
            texts = [prefix + (t or "") for t in frame[text]]
            for at in range(0, len(texts), batch):
                vectors += model(texts[at : at + batch])
            yield frame.assign(vector=vectors)

    return passages.mapInPandas(run, schema)


def prompts(hits: DataFrame, requests: DataFrame, most: int = 1_200) -> DataFrame:
    """(query_id, prompt): a request with its hits, in the order of their ranks, as numbered examples before it."""
    body = F.when(F.length("text") > most, F.concat(F.left("text", F.lit(most)), F.lit(" …"))).otherwise(F.col("text"))
    block = F.concat(F.lit("[example "), F.col("rank").cast("string"), F.lit(" — "), F.col("bucket"), F.lit(" · "), F.coalesce("title", F.lit("")), F.lit("]\n"), body)
    gathered = hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))), lambda x: x["block"]), "\n\n").alias("examples"))
    whole = F.when(F.col("examples").isNull(), F.col("request")).otherwise(F.concat(F.lit("Examples:\n\n"), F.col("examples"), F.lit("\n\nRequest:\n"), F.col("request")))
    return requests.join(gathered, "query_id", "left").select("query_id", whole.alias("prompt"))
