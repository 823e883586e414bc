"""Bounded samples of labelled documents, on which classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Labelled rows of each class that a classifier is fitted on, at most.
PER_CLASS = 10_000


def held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Rows that no classifier learns from; a row without an id is none of them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS) -> tuple[DataFrame, dict[int, float]]:
    """Texts with their label (text, label), at most ``per_class`` of each class, chosen by a hash of doc_id among the rows
    that aren't held out; and how many labelled rows one sampled row of a class stands for. Rows whose doc_id or label is
    null are left out; of a doc_id's contradicting labels the larger counts."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    totals = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    order = F.xxhash64("doc_id")
    parts = [known.filter(F.col("label") == v).orderBy(order, "doc_id").limit(per_class) for v in (0, 1)]
    # the chosen ids are at most 2 * per_class rows
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    sample = written(docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "label"), "labelled")
    return sample, {v: max(1.0, n / per_class) for v, n in totals.items()}
