"""Listing records: free-text, lineage and facet filters, pages with totals, reading order, and flat renditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .order import running_total

#: The columns of the flat export.
FLAT_COLUMNS = ("id", "subject", "category", "title", "text", "lang", "word_count", "line_count", "source", "source_kind", "sources", "source_url", "source_urls", "date", "topics", "meter", "rhyme")


def free_text(records: DataFrame, query: str) -> DataFrame:
    """Rows whose serialised form contains the query, whatever its case."""
    return records.filter(F.contains(F.lower(F.to_json(F.struct("*"))), F.lit(query.lower())))


def of_run(records: DataFrame, run_id: int) -> DataFrame:
    ids = [F.col(c) for c in ("run_id", "_run_id") if c in records.columns]
    return records.filter(F.coalesce(*ids) == run_id)


def with_meta(records: DataFrame, *names: str) -> DataFrame:
    """Entries of the map ``meta`` as columns, null where it lacks them, so that clean records can be filtered, counted and
    ordered by them; columns that are there already stay."""
    return records.withColumns({c: F.try_element_at("meta", F.lit(c)) for c in names if c not in records.columns})


def facet_filter(records: DataFrame, equal: dict[str, str] | None = None, part: dict[str, str] | None = None, among: dict[str, str] | None = None) -> DataFrame:
    """Columns that equal a value, contain one as a part, or have one among their joined values."""
    for c, v in (equal or {}).items():
        records = records.filter(F.col(c) == v)
    for c, v in (part or {}).items():
        records = records.filter(F.contains(F.col(c), F.lit(v)))
    for c, v in (among or {}).items():
        records = records.filter(F.array_contains(F.transform(F.split(F.col(c), "[|]"), lambda x: F.trim(x)), v))
    return records


def page(records: DataFrame, order: str = "seq", offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of at most 500 rows, each with the number of all matches."""
    total = F.broadcast(records.agg(F.count("*").alias("total")))
    return records.orderBy(order).offset(max(0, offset)).limit(min(500, max(1, limit))).join(total)


def reading_key(title: Column, date: Column, record_id: Column) -> Column:
    """Titled records by title, then dated ones by date, then the rest by id."""
    title, date = tx.nonempty(title), tx.nonempty(date)
    return F.struct(F.when(title.isNotNull(), 0).when(date.isNotNull(), 1).otherwise(2).alias("part"), F.coalesce(title, date, record_id).alias("key"), record_id.alias("id"))


def chapters(records: DataFrame, by: str, title: str, date: str, record_id: str) -> DataFrame:
    """Adds chapter, the place in reading order, and chapter_title, '#n' for untitled ones."""
    key = reading_key(F.col(title), F.col(date), F.col(record_id))
    out = running_total(records, [key["part"], key["key"], key["id"]], F.lit(1), "chapter", (by,)).withColumn("chapter", F.col("chapter").cast("int"))
    return out.select(*records.columns, "chapter", F.coalesce(tx.nonempty(F.col(title)), F.concat(F.lit("#"), F.col("chapter").cast("string"))).alias("chapter_title"))


def flat_rows(records: DataFrame, columns: tuple[str, ...] = FLAT_COLUMNS) -> DataFrame:
    """String columns for a flat file: lists joined by '|', null and zero as ''. What is no column of its own is looked up in the
    map ``meta``."""

    def flat(c: str) -> Column:
        kind = dict(records.dtypes).get(c)
        if kind is None:
            return F.coalesce(F.try_element_at("meta", F.lit(c)), F.lit("")) if "meta" in records.columns else F.lit("")
        if kind.startswith("array"):
            return F.coalesce(F.array_join(c, "|"), F.lit(""))
        value = F.col(c)
        return F.coalesce(F.when(value != 0, value.cast("string")) if kind in ("int", "bigint", "double") else value.cast("string"), F.lit(""))

    return records.select(*(flat(c).alias(c) for c in columns))


def markdown_blocks(records: DataFrame, by: str, title: str, text: str, date: str, record_id: str, url: str | None = None) -> DataFrame:
    """(by, chapter, block, entry): each record's rendition, and its line of the table of contents if it is titled."""
    rows = chapters(records, by, title, date, record_id)
    verses = F.array_join(F.transform(tx.lines(F.col(text)), lambda x: F.concat(x, F.lit("  "))), "\n")
    source = F.concat(F.lit("\n\n<sub>"), F.col(url), F.lit("</sub>")) if url else F.lit("")
    block = F.concat(F.lit("## "), F.col("chapter_title"), F.lit("\n\n"), verses, F.coalesce(source, F.lit("")), F.lit("\n"))
    entry = F.when(tx.nonempty(F.col(title)).isNotNull(), F.concat(F.lit("- ["), F.col(title), F.lit("](#"), tx.anchor(F.col(title), F.col("chapter")), F.lit(")")))
    return rows.select(by, "chapter", block.alias("block"), entry.alias("entry"))
