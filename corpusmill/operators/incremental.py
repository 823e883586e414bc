"""What is known already: latest states, watermarks, and the rows that are new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def latest(log: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """The last row of each key of an append-only log."""
    return log.groupBy(key).agg(F.max_by(F.struct("*"), seq).alias("__row")).select("__row.*")


def seen(fetched: DataFrame, failed: DataFrame, key: str = "url") -> DataFrame:
    return fetched.select(key).union(failed.select(key)).filter(F.col(key).isNotNull()).distinct()


def frontier(links: DataFrame, known: DataFrame, key: str = "url", order: str = "ord", most: int | None = None, force: bool = False) -> DataFrame:
    """The links' first occurrences that aren't known, in order; ``force`` takes known ones too."""
    firsts = links.groupBy(key).agg(F.min(order).alias(order))
    new = firsts if force else firsts.join(known.select(key), key, "left_anti")
    return new.orderBy(order).limit(most) if most else new


def cap_per_source(records: DataFrame, most: int, source: str = "source", order: str = "seq") -> DataFrame:
    """The first records of each source, in order. Spark limits the groups in each task before the shuffle too."""
    return records.withColumn("rank", F.row_number().over(Window.partitionBy(source).orderBy(order))).filter(F.col("rank") <= most)


def watermarks(posts: DataFrame, source: str = "source", post_id: str = "post_id") -> DataFrame:
    """(source, min_id, max_id, n) of ids that are integers."""
    number = F.col(post_id).try_cast("long")
    return posts.groupBy(source).agg(F.min(number).alias("min_id"), F.max(number).alias("max_id"), F.count(number).alias("n"))


def advance(checkpoints: DataFrame, batch: DataFrame, source: str = "source") -> DataFrame:
    """Checkpoints (source, max_id, count_total) after a batch: with previous_max and mode, backfill without an earlier id."""
    new = watermarks(batch, source)
    old = checkpoints.select(source, F.col("max_id").alias("previous_max"), F.col("count_total").alias("before"))
    both = new.join(old, source, "full")
    return both.select(
        source,
        F.greatest("max_id", "previous_max").alias("max_id"),
        "previous_max",
        (F.coalesce("before", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("count_total"),
        F.when(F.col("previous_max").isNull(), "backfill").otherwise("incremental").alias("mode"),
    )


def newer_than(posts: DataFrame, checkpoints: DataFrame, source: str = "source", post_id: str = "post_id") -> DataFrame:
    """The posts above their source's watermark."""
    marks = checkpoints.select(source, F.col("max_id").alias("__mark"))
    return posts.join(marks, source, "left").filter(F.col(post_id).try_cast("long") > F.coalesce("__mark", F.lit(-1))).drop("__mark")


def tail_window(posts: DataFrame, lows: DataFrame, floor: int = 1, source: str = "source", post_id: str = "post_id") -> DataFrame:
    """Older posts of a second reader: above the floor and below the lowest id that the first one reached."""
    marks = lows.filter(F.col("min_id") > 1).select(source, F.col("min_id").alias("__low"))
    number = F.col(post_id).try_cast("long")
    return posts.join(marks, source).filter((number > floor - 1) & (number < F.col("__low"))).drop("__low")


def duration_status(seconds: Column, least: float | None, most: float | None) -> Column:
    """skipped_short, skipped_long, or null; an unknown duration passes."""
    out = F.when(F.lit(False), "")
    if least is not None:
        out = out.when(seconds < least, "skipped_short")
    if most is not None:
        out = out.when(seconds > most, "skipped_long")
    return out


def pending(index: DataFrame, done: DataFrame | None = None, keys: tuple[str, ...] = ("video_id",), most: int | None = None) -> DataFrame:
    """Latest entries that are downloaded, have a path and aren't done, in order of their ids under one cap."""
    rows = latest(index, "video_id").filter((F.col("status") == "downloaded") & tx.nonempty(F.col("audio_path")).isNotNull())
    if done is not None:
        rows = rows.join(done.select(*keys).distinct(), list(keys), "left_anti")
    return rows.orderBy("video_id").limit(most) if most else rows


def fold_transcripts(records: DataFrame, transcripts: DataFrame, key: str = "video_id") -> DataFrame:
    """Records with a transcript's text where they have none of their own."""
    extra = transcripts.select(key, F.col("text").alias("__transcript"))
    return records.join(extra, key, "left").withColumn("text", F.coalesce(tx.nonempty(F.col("text")), "__transcript")).drop("__transcript")


def flatten_entries(rows: DataFrame, entries: str = "entries") -> DataFrame:
    """One level of nested entries as rows; a row without entries stays, null entries go."""
    own = F.array(F.struct(*(c for c in rows.columns if c != entries)))
    return rows.select(F.explode(F.coalesce(F.filter(entries, lambda e: e.isNotNull()), own)).alias("e")).select("e.*")
