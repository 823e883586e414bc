"""Approximate nearest vectors against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import vector_index as vi


def frame(spark, rows, name="id", **more):
    return spark.createDataFrame(pd.DataFrame({name: range(len(rows)), "vector": [r.tolist() for r in rows]} | more))


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(60, 24)) * 3
    # a third of all rows in one cluster
    of = np.where(rng.random(20_000) < 1 / 3, 0, rng.integers(0, 60, 20_000))
    return (middles[of] + rng.normal(size=(20_000, 24))).astype(np.float32)


def test_recall_and_rows_touched(spark, clustered):
    vectors, queries = frame(spark, clustered), frame(spark, clustered[::200], "query_id")
    index = vi.build_index(vectors)
    assert len(index.centres) == 142  # the root of the rows, rounded up
    assert index.codes.count() == 20_000
    sizes = np.zeros(142)
    for r in index.codes.groupBy("cell").count().collect():
        sizes[r["cell"]] = r["count"]
    visited = np.argsort(vi._off(clustered[::200], index.centres), 1)[:, : index.probes]
    assert sizes[visited].sum(1).mean() < 20_000 / 4
    got = {(r.query_id, r.id): r for r in vi.search(index, vectors, queries).collect()}
    distances = ((clustered[::200, None, :].astype(float) - clustered[None].astype(float)) ** 2).sum(2)
    want = {(q, i) for q, row in enumerate(np.argsort(distances, 1, kind="stable")[:, :10]) for i in row}
    assert len(got) == len(want) and len(want & got.keys()) >= 0.9 * len(want)
    for (q, i), r in got.items():
        assert r.distance == pytest.approx(distances[q, i])


def test_within_and_whole_lists_are_exact(spark):
    """With every cell visited and a list as long as the table, the search is the exact one; ties go by id."""
    rows = np.repeat(np.random.default_rng(1).normal(size=(40, 5)), 3, 0)
    vectors, queries = frame(spark, rows), frame(spark, rows[:7], "query_id")
    index = vi.build_index(vectors, reach=1.0)._replace(probes=100)
    got = sorted((r.query_id, r["rank"], r.id) for r in vi.search(index, vectors, queries, 4, 200, vectors.filter("id % 2 = 0")).collect())
    ids = np.arange(0, 120, 2)
    for q in range(7):
        d = ((rows[ids] - rows[q]) ** 2).sum(1)
        assert [i for p, _, i in got if p == q] == ids[np.lexsort((ids, d.round(9)))][:4].tolist()


def test_unusable_vectors_and_empty_tables(spark):
    schema = "id string, vector array<double>, query int"
    rows = [("a", [1.0, 2.0], 0), ("b", None, 0), ("c", [None, 1.0], 0), ("d", [float("nan"), 1.0], 0), ("e", [float("inf"), 1.0], 0), ("f", [0.0, 0.0], 0)]
    vectors = spark.createDataFrame(rows, schema)
    queries = vectors.select(F.col("id").alias("query_id"), "vector")
    got = [(r.query_id, r.id, r.distance) for r in vi.knn_quantised(vectors, queries).orderBy("query_id", "rank").collect()]
    assert got == [("a", "a", 0.0), ("a", "f", 5.0), ("f", "f", 0.0), ("f", "a", 5.0)]
    assert vi.knn_quantised(vectors, queries, where="id = 'f'").count() == 2
    assert vi.knn_quantised(vectors.limit(0), queries).collect() == []
    assert vi.knn_quantised(vectors, queries.limit(0)).collect() == []
