"""Streams across restarts: state on disk, eviction and its memory."""

import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import dedup
from corpusmill.streaming import corpus as st
from corpusmill.streaming import near

STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def places(tmp_path):
    return [f"file:{tmp_path}/{n}" for n in ("log", "out", "state")]


def run(spark, places, rows, schema, keys, *bound):
    log, out, state = places
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(log)
    query = st.incremental(st.exact_dedup(st.read_log(spark, log, schema), keys, *bound), out, state)
    query.awaitTermination()
    return query.recentProgress


def test_restart_remembers_keys(spark, places):
    before = spark.conf.get(STORE)
    schema = "bucket string, id string, seq long"
    run(spark, places, [("a", "x", 1), ("a", "x", 2), ("b", "x", 3), (None, "x", 4), (None, "x", 5)], schema, ["bucket", "id"])
    last = run(spark, places, [("a", "x", 6), ("a", "y", 7), (None, "x", 8)], schema, ["bucket", "id"])[-1]
    got = [(r.bucket, r.id) for r in spark.read.parquet(places[1]).collect()]
    assert sorted(got, key=str) == sorted([("a", "x"), ("b", "x"), (None, "x"), ("a", "y")], key=str)
    assert any("rocksdb" in name for name in last["stateOperators"][0]["customMetrics"])
    assert spark.conf.get(STORE) == before


def test_keys_are_forgotten_after_their_bound(spark, places):
    schema = "id string, minute long"
    timed = "id string, at timestamp"
    log, out, state = places
    sizes = []
    for rows in ([("x", 0), ("y", 0), ("x", 5)], [("z", 100)], [("w", 101), ("x", 102)], [("late", 1)]):
        spark.createDataFrame(rows, schema).select("id", F.timestamp_seconds((F.col("minute") + 1_000) * 60).alias("at")).coalesce(1).write.mode("append").parquet(log)
        query = st.incremental(st.exact_dedup(st.read_log(spark, log, timed), ["id"], "at", "10 minutes"), out, state)
        query.awaitTermination()
        sizes.append(query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    got = sorted(r.id for r in spark.read.parquet(out).collect())
    assert got == ["w", "x", "x", "y", "z"]  # x is new again when its first row is long past; late is too late
    assert sizes[0] == 2 and sizes[1] == 1 and sizes[3] == 3


GROWING = """
import sys
sys.path.insert(0, sys.argv[1])
from corpusmill.streaming import corpus as st
from pyspark.sql import SparkSession, functions as F

spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
log, out, state = (f"file:{sys.argv[2]}/{n}" for n in ("log", "out", "state"))
for k in range(3):
    spark.range(k * 250_000, (k + 1) * 250_000).select(F.sha2(F.col("id").cast("string"), 256).alias("id")).write.mode("append").parquet(log)
    with st.state_on_disk(spark, 16):
        query = st.exact_dedup(st.read_log(spark, log, "id string"), ["id"]).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    operator = query.recentProgress[-1]["stateOperators"][0]
    print("state", operator["numRowsTotal"], operator["memoryUsedBytes"])
"""


def test_memory_of_state_stays_within_its_bound(tmp_path):
    """Three times as many bytes of keys as stores may hold; in a JVM of its own, as the first stream of one sets its bound."""
    here = str(Path(__file__).resolve().parent.parent)
    done = subprocess.run([sys.executable, "-c", GROWING, here, str(tmp_path)], capture_output=True, text=True, timeout=300)
    sizes = [tuple(map(int, line.split()[1:])) for line in done.stdout.splitlines() if line.startswith("state")]
    assert [n for n, _ in sizes] == [250_000, 500_000, 750_000]
    assert max(used for _, used in sizes) <= 16 << 20


def test_near_copies_fold_across_batches_as_in_one(spark, tmp_path):
    """Copies, near copies, and fragments whose parent a later, longer text takes away, in three batches."""
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n))
    long, rows = [words(60) for _ in range(6)], []
    for text in long:
        parts = text.split(" ")
        # a fragment, its parent but for some words, a near copy of the whole, the whole, and the whole within a longer one
        rows += [" ".join(parts[:12]), " ".join(parts[:30] + words(3).split(" ")), " ".join(parts[:59]), text, text, text + " " + words(50)]
    rng.shuffle(rows)
    rows = [("b" if k % 5 else "c", k, t) for k, t in enumerate([*rows, "", None, "?!", long[0], long[1]])]
    schema = "bucket string, seq long, text string"
    log, state, checkpoint = (f"file:{tmp_path}/{n}" for n in ("log", "state", "checkpoint"))
    for part in (rows[:9], rows[9:25], rows[25:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(log)
        near.fold_near(st.read_log(spark, log, schema), state, checkpoint).awaitTermination()
    got = sorted(map(tuple, near.folded(spark, state).collect()))
    frame = spark.createDataFrame(rows, schema).withColumn("text", F.coalesce("text", F.lit("")))
    copies = dedup.exact_duplicates(frame, ["bucket", "text"]).filter("is_dup").select("seq", "survivor_seq")
    singles = frame.join(copies, "seq", "left_anti")
    alike = dedup.near_duplicate_survivors(dedup.jaccard_pairs(singles))
    parts = dedup.fold_fragments(dedup.containment_pairs(singles.join(alike, "seq", "left_anti")))
    want = sorted((rows[r.seq][0], r.seq, r.survivor_seq) for r in dedup.ultimate_survivors(copies, alike, parts).collect())
    assert len(want) > 10 and got == want
