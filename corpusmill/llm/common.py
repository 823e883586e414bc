"""What the operators of this subpackage share: scratch space, materialising, and bounded batches of texts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Characters of text that one step of a Python task handles at once.
SLICE_CHARS = 2_000_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate files: the session's ``spark.checkpoint.dir``; a new temporary one where that
    setting is absent and Spark is local, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="corpusmill-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Compute once, into the shared folder; lost executors can't take it away."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Like checkpoint(), as a compressed Parquet table from which later reads take only the columns they use."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def file_uri(path: str) -> str:
    """The form of a Hadoop path that pyarrow's file systems take."""
    return re.sub(r"^(file:)?/+", "file:///", path) if re.match(r"(file:)?/", path) else path


def row_slices(batches: Iterator[pa.RecordBatch], column: str, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that no slice but a single long row has more than ``chars`` bytes of text."""
    for batch in batches:
        texts = batch.column(column)
        sizes = texts.fill_null("").cast(pa.large_binary()) if texts.null_count else texts
        ends = np.cumsum(pc.binary_length(sizes).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            to = max(start + 1, int(np.searchsorted(ends, before + chars, "right")))
            yield batch.slice(start, to - start)
            start = to


def text_slices(batches: Iterator[pa.RecordBatch], column: str, chars: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices as row_slices() cuts them, with their texts; null texts are ''."""
    for cut in row_slices(batches, column, chars):
        yield cut, [t or "" for t in cut.column(column).to_pylist()]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
