"""Nearest vectors and prompts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import vector, vector_index
from .registry import query, table


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def asked(spark, sf_dir):
    """Every vector whose id is divisible by 50."""
    return vectors(spark, sf_dir).filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")


_KNN = """d AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_sum(list_transform(list_zip(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS distance FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 {where})
 SELECT query_id, id, round(distance, 6) AS distance, round(1 / (1 + distance), 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank FROM d QUALIFY rank <= 10"""


@query("WITH " + _KNN.format(where=""))
def knn_l2(spark, sf_dir):
    return vector.knn(vectors(spark, sf_dir), asked(spark, sf_dir)).withColumn("distance", F.round("distance", 6))


@query("WITH " + _KNN.format(where="AND v.label < 3"))
def knn_filtered(spark, sf_dir):
    return vector.knn(vectors(spark, sf_dir), asked(spark, sf_dir), where="label < 3").withColumn("distance", F.round("distance", 6))


@query()
def knn_partitioned(spark, sf_dir):
    """Nearest vectors by cells, coded residuals and exact distances of short lists."""
    return vector_index.knn_quantised(vectors(spark, sf_dir), asked(spark, sf_dir)).withColumn("distance", F.round("distance", 6))


@query("SELECT count(*) AS asked, true AS enough FROM embeddings WHERE vec_id % 50 = 0")
def knn_partitioned_recall(spark, sf_dir):
    """Whether the search by cells and codes finds at least nine tenths of what the exact one finds."""
    keys = ["query_id", "id"]
    exact, near = (f(spark, sf_dir).select(*keys) for f in (knn_l2, knn_partitioned))
    both = exact.join(near.withColumn("found", F.lit(True)), keys, "left").agg((F.count("found") >= 0.9 * F.count("*")).alias("enough"))
    return asked(spark, sf_dir).agg(F.count("*").alias("asked")).join(both)


@query("""WITH r AS (SELECT conv_id, min(text) FILTER (WHERE turn = 0) AS request FROM conversations GROUP BY conv_id),
 h AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rank, role, text FROM conversations WHERE turn > 0),
 e AS (SELECT conv_id, string_agg('[example ' || rank || ' — ' || role || ' · ]' || chr(10) || CASE WHEN length(text) > 1200 THEN left(text, 1200) || ' …' ELSE text END, chr(10) || chr(10) ORDER BY rank) AS examples FROM h WHERE rank <= 3 GROUP BY conv_id)
 SELECT conv_id AS query_id, CASE WHEN examples IS NULL THEN request ELSE 'Examples:' || chr(10) || chr(10) || examples || chr(10) || chr(10) || 'Request:' || chr(10) || request END AS prompt FROM r LEFT JOIN e USING (conv_id)""")
def prompt_assembly(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "query_id")
    requests = turns.groupBy("query_id").agg(F.min(F.when(F.col("turn") == 0, F.col("text"))).alias("request"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("turn", "role", "text"))
    hits = turns.filter("turn > 0").withColumn("rank", place).filter("rank <= 3")
    return vector.prompts(hits.select("query_id", "rank", F.col("role").alias("bucket"), F.lit(None).cast("string").alias("title"), "text"), requests)


def _measured(texts: list[str]) -> list[list[float]]:
    """A model that is plain arithmetic: length, letters e, and words of a text."""
    return [[float(len(t)), float(t.count("e")), float(len(t.split(" ")))] for t in texts]


@query("""SELECT doc_id, length(p)::DOUBLE AS v0, len(regexp_extract_all(p, 'e'))::DOUBLE AS v1, len(string_split(p, ' '))::DOUBLE AS v2 FROM (SELECT doc_id, 'passage: ' || text AS p FROM documents)""")
def batch_embed(spark, sf_dir):
    """Vectors of all documents from a model function, a batch of texts at a time."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("passage"))
    found = vector.embed(rows, _measured, prefix="passage: ")
    return found.select("doc_id", *(F.get("vector", F.lit(k)).cast("double").alias(f"v{k}") for k in range(3)))
