"""Line deduplication with levelled sorted runs of line hashes.

The documents come in batches of ascending doc_id. Each batch's distinct line keys are merge-joined with the runs, which
are tables bucketed and sorted by the key's hash: a key that a run holds belongs to an earlier document, the others form a
new run. When a level has ``fanout`` runs, they are merged into one of the next level, so a batch meets few runs.

A key is a line without ASCII white space at its ends, A-Z lower-cased, and counts from ``min_chars`` code points on. A key
that two documents hold loses all its lines but those of the smallest doc_id that holds it. Keys are compared by 128-bit
hashes.

Edge cases: a null or empty text is one empty line. A row with a null doc_id is left as it is and holds no key. Rows with
the same doc_id are one document: none loses lines to the other. An empty table gives no rows. Columns of the documents
besides the named ones are carried through; the added columns replace columns of the same names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, partitions, remove, scratch, text_slices, written

MIN_CHARS, BATCHES, FANOUT = 10, 4, 2
_SPACE = b" \t\n\x0b\x0c\r"


def _keys(text: str, min_chars: int) -> list[bytes | None]:
    """Of each line, the hash of its key, or None for a short key."""
    import xxhash

    out: list[bytes | None] = []
    for line in text.encode().split(b"\n"):
        key = line.strip(_SPACE).lower()
        long = len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)
        out.append(xxhash.xxh3_128_digest(key) if long else None)
    return out


class LineRuns:
    """The levelled runs. A run's table has key (binary) and owner, the smallest doc_id that holds the key."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout, self.buckets = spark, fanout, buckets or partitions(spark)
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def _write(self, df: DataFrame, level: int) -> None:
        name, path = f"line_run_{uuid.uuid4().hex}", scratch(self.spark, "line-run")
        df.repartition(self.buckets, "key").write.bucketBy(self.buckets, "key").sortBy("key").option("path", path).saveAsTable(name)
        self.paths[name] = path
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, self.paths.pop(name))

    def owners(self, keys: DataFrame) -> DataFrame:
        """Merge-join keys with every run: adds prior, the earlier owner or null. A key is in one run at most."""
        runs = [name for level in self.levels for name in level]
        out = keys.repartition(self.buckets, "key")
        for k, name in enumerate(runs):
            out = out.join(self.spark.table(name).select("key", F.col("owner").alias(f"owner_{k}")), "key", "left")
        prior = F.coalesce(*(f"owner_{k}" for k in range(len(runs))), F.lit(None))
        return out.select(*keys.columns, prior.cast(keys.schema["first"].dataType).alias("prior"))

    def add(self, new: DataFrame) -> None:
        """Add a batch's own keys (key, owner) as a run, and compact full levels."""
        self._write(new, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            names = self.levels[level]
            self.levels[level] = []
            self._write(reduce(DataFrame.unionByName, map(self.spark.table, names)), level + 1)
            for name in names:
                self._drop(name)
            level += 1

    def clear(self) -> None:
        for name in list(self.paths):
            self._drop(name)


def dropped_keys(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT, runs: LineRuns | None = None) -> DataFrame:
    """(doc_id, keys): the hashes of the keys that a document loses; documents that lose none are absent. With ``runs`` of
    earlier calls, lines that their documents hold are lost too, whatever the ids, and this call's keys join them."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).filter(F.col("doc").isNotNull())
    kind = docs.schema["doc"].dataType
    schema = T.StructType([T.StructField("doc", kind), T.StructField("key", T.BinaryType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut, texts in text_slices(parts, "text"):
            sets = [list({k for k in _keys(t, min_chars) if k}) for t in texts]
            rows = pa.array([i for i, s in enumerate(sets) for _ in s], pa.int64())
            yield pa.RecordBatch.from_arrays([cut.column("doc").take(rows), pa.array([k for s in sets for k in s], pa.binary())], names=["doc", "key"])

    cuts = docs.select(F.percentile_approx("doc", [k / batches for k in range(1, batches)])).first()[0] if batches > 1 else None
    cuts = sorted({*(cuts or [])})
    batch = sum((F.when(F.col("doc") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    path = scratch(spark, "lines")
    docs.mapInArrow(run, schema).withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])).parquet(path)

    held, dropped = runs or LineRuns(spark, fanout), []
    earlier = bool(held.paths)
    try:
        for b in range(len(cuts) + 1):
            own = lines.filter(F.col("batch") == b).select("doc", "key")
            keys = own.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
            met = written(held.owners(keys), "line-keys")
            # a key's lines may be many: its owners are written, so that a hot key's part of this join can be split
            twice = met.filter(F.col("prior").isNotNull() | (F.col("last") > F.col("first")))
            twice = checkpoint(twice.select("key", F.coalesce("prior", "first").alias("owner"), (F.col("prior").isNotNull() & F.lit(earlier)).alias("met")))
            dropped.append(own.join(twice, "key").filter("met OR doc > owner" if earlier else "doc > owner").select("doc", "key"))
            if b < len(cuts) or runs is not None:
                held.add(met.filter(F.col("prior").isNull()).select("key", F.col("first").alias("owner")))
    finally:
        if runs is None:
            held.clear()
    found = reduce(DataFrame.unionByName, dropped)
    return found.groupBy("doc").agg(F.collect_list("key").alias("keys")).withColumnRenamed("doc", doc_id)


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS, **options) -> DataFrame:
    """The documents with the kept lines as their text, and n_lines (before) and n_dropped."""
    added = ["n_lines", "n_dropped"]
    keep = [c for c in docs.columns if c not in added]
    gone = dropped_keys(docs, text, doc_id, min_chars, **options).select(F.col(doc_id).alias("__doc"), F.col("keys").alias("__keys"))
    joined = docs.select(*keep).join(gone, F.col(doc_id) == F.col("__doc"), "left").drop("__doc")
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, T.LongType(), False) for c in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut, texts in text_slices(batches, text):
            kept, n_lines, n_dropped = [], [], []
            for t, keys, was in zip(texts, cut.column("__keys").to_pylist(), cut.column(text)):
                lines = t.split("\n")
                n_lines.append(len(lines))
                if keys:
                    keys = set(keys)
                    lines = [x for x, k in zip(lines, _keys(t, min_chars)) if k not in keys]
                n_dropped.append(n_lines[-1] - len(lines))
                kept.append("\n".join(lines) if was.is_valid else None)
            yield pa.RecordBatch.from_arrays([*(pa.array(kept, pa.string()) if c == text else cut.column(c) for c in keep), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*keep, *added])

    return joined.mapInArrow(run, schema)
