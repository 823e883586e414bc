"""Nearest vectors by products of matrices are those measured row by row."""

import numpy as np
import pytest
from corpusmill.operators import vector
from pyspark.sql import functions as F


def rows(n=600, d=9):
    """Some vectors are equal, some differ in the last bits, some are large."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[100:140], x[140:160] = x[:40], x[40:60] + np.float32(1e-7)
    x[160:170] *= 1e6
    return [(k, v.tolist()) for k, v in enumerate(x)]


def frames(spark, **kinds):
    all_ = spark.createDataFrame(rows(), f"id {kinds.get('id', 'long')}, vector array<float>")
    return all_, all_.filter("id % 5 = 0").select(F.col("id").alias("query_id"), "vector")


def plainly(spark, monkeypatch, *args, **named):
    with monkeypatch.context() as m:
        m.setattr(vector, "_even", lambda *_: 0)
        return sorted(map(tuple, vector.knn(*args, **named).collect()))


def test_products_find_what_rows_find(spark, monkeypatch):
    all_, asked = frames(spark)
    plan = vector.knn(all_, asked, 7)._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "zip_with" not in plan
    for named in ({"k": 7}, {"k": 3, "where": "id < 2"}, {"k": 900}, {"k": 4, "where": "id % 2 = 1"}):
        want = plainly(spark, monkeypatch, all_, asked, **named)
        assert want and sorted(map(tuple, vector.knn(all_, asked, **named).collect())) == want
    monkeypatch.setattr(vector, "_AT_ONCE", 500)
    monkeypatch.setattr(vector, "BROADCAST_NUMBERS", 90)
    assert sorted(map(tuple, vector.knn(all_, asked, 7).collect())) == plainly(spark, monkeypatch, all_, asked, k=7)


@pytest.mark.parametrize("odd", [None, [], [1.0], [None] * 9, [float("nan")] * 9])
def test_uneven_vectors_go_row_by_row(spark, monkeypatch, odd):
    all_, asked = frames(spark)
    more = all_.unionByName(spark.createDataFrame([(9000, odd)], all_.schema))
    assert sorted(map(repr, vector.knn(more, asked, 2).collect())) == sorted(map(repr, vector.knn(more, asked, 2).collect())) != []
    assert vector._even(more, asked) == 0 and vector._even(all_, asked) == 9
