"""Counts, totals, percentiles and facets of a corpus, and suggestions of rules from samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..scratch import stored
from .order import medians, values_at

#: Separators of titles, in the order of preference.
SEPARATORS = ("»", "›", "·", "|", "—", "/", "::")


def status_counts(outcomes: DataFrame, by: list[str], fragments: bool = False) -> DataFrame:
    """Of rows with a status (kept, filtered, duplicate or fragment), the counts by the given columns; dropped_dedup counts
    fragments too, and dropped_fragment, where it is asked for, counts them alone."""
    count = lambda s: F.count_if(F.col("status") == s)
    return outcomes.groupBy(*by).agg(F.count("*").alias("input"), count("kept").alias("kept"), count("filtered").alias("dropped_filter"), (count("duplicate") + count("fragment")).alias("dropped_dedup"), *([count("fragment").alias("dropped_fragment")] if fragments else []))


def bucket_totals(records: DataFrame) -> DataFrame:
    return records.groupBy("bucket").agg(F.count("*").alias("n_rows"), F.sum("word_count").alias("words"), F.sum("line_count").alias("lines"), F.bool_or(F.contains("bucket", F.lit("__"))).alias("sidecar"))


def nearest_rank_percentiles(values: DataFrame, column: str, percents: tuple[int, ...] = (50, 90, 99)) -> DataFrame:
    """Of each percent, the value at index round(p / 100 * (n - 1)), half to even; 0 for an empty table."""
    hit = values_at(values, column, lambda n: {p: round(p / 100 * (n - 1)) for p in percents})
    kind = values.schema[column].dataType.simpleString()
    rows = values.sparkSession.createDataFrame([(p, hit.get(p)) for p in percents], f"percent int, value {kind}")
    return rows.select("percent", F.coalesce("value", F.lit(0)).alias("value"))


def top_counts(values: DataFrame, column: str, k: int) -> DataFrame:
    """The k commonest values, ties in the order of the values."""
    return values.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def multi_values(records: DataFrame, column: str, sep: str = "|") -> DataFrame:
    """Trimmed non-empty values of a joined column, a row each."""
    values = F.transform(F.split(F.col(column), f"[{sep}]"), lambda x: F.trim(x))
    return records.select(F.explode(F.filter(values, lambda x: x != "")).alias(column))


def facet_counts(records: DataFrame, facets: dict[str, int], multi: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """(by, facet, value, n): the commonest values of several facets in one pass over the records."""
    values = lambda c: F.transform(F.split(F.col(c), "[|]"), lambda x: F.trim(x)) if c in multi else F.array(F.col(c).cast("string"))
    named = lambda c: F.transform(F.coalesce(values(c), F.array().cast("array<string>")), lambda v: F.struct(F.lit(c).alias("facet"), v.alias("value")))
    pairs = F.flatten(F.array(*map(named, facets)))
    rows = records.select(*by, F.explode(pairs).alias("x")).select(*by, "x.facet", "x.value").filter(F.col("value").isNotNull() & (F.col("value") != ""))
    limit = None
    for name, k in facets.items():
        limit = (limit.when if limit is not None else F.when)(F.col("facet") == name, k)
    rank = F.row_number().over(Window.partitionBy(*by, "facet").orderBy(F.desc("n"), "value"))
    return rows.groupBy(*by, "facet", "value").agg(F.count("*").alias("n")).withColumn("rank", rank).filter(F.col("rank") <= limit).drop("rank")


def source_frequency(records: DataFrame, k: int = 30) -> DataFrame:
    return top_counts(records.select(F.explode("sources").alias("source")), "source", k)


def suggest_title_ops(titles: DataFrame, separators: tuple[str, ...] = SEPARATORS, share: float = 0.6) -> DataFrame:
    """(separator, if_starts_with): the commonest separator, if enough titles have it, and the start most of them share."""
    rows = titles.select(F.trim("title").alias("title")).filter(F.col("title") != "")
    total = rows.agg(F.count("*").alias("n"))
    places = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(s).alias("separator")) for i, s in enumerate(separators)))
    hits = rows.select("title", F.explode(places).alias("x")).select("title", "x.*").filter(F.contains("title", F.col("separator")))
    best = hits.groupBy("separator", "ord").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "ord").limit(1).join(total).filter(F.col("hits") >= F.greatest(F.lit(2), F.floor(F.col("n") * share)))
    heads = hits.join(F.broadcast(best.select("separator", "n")), "separator").withColumn("head", F.trim(F.split_part("title", F.col("separator"), F.lit(1))))
    top = heads.filter(F.col("head") != "").groupBy("separator", "head", "n").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "head").limit(1)
    top = top.filter(F.col("c") >= F.floor(F.col("n") * share)).select("separator", F.col("head").alias("if_starts_with"))
    return best.select("separator", "hits").join(top, "separator", "left")


def suggest_footers(texts: DataFrame, last: int = 3, most: int = 6) -> DataFrame:
    """(line, n): lines that end at least half of the texts, the commonest first."""
    rows = texts.filter(tx.trim_space(F.col("text")) != "")
    total = F.broadcast(rows.agg(F.count("*").alias("total")))
    parts = F.filter(F.transform(tx.lines(F.col("text")), lambda x: tx.trim_space(x)), lambda x: x != "")
    tail = rows.select(parts.alias("p")).select(F.explode(F.slice("p", F.greatest(F.size("p") - (last - 1), F.lit(1)), F.lit(last))).alias("line"))
    counts = tail.filter(F.length("line").between(4, 79)).groupBy("line").agg(F.count("*").alias("n"))
    enough = counts.join(total).filter((F.col("total") >= 2) & (F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("total") / 2))))
    return enough.orderBy(F.desc("n"), "line").limit(most).select("line", "n")


def suggest_thresholds(texts: DataFrame, script: str = tx.ARABIC) -> DataFrame:
    """(min_chars, min_script_ratio, n, median_chars, median_ratio) of a sample."""
    rows = texts.filter(F.col("text") != "").select(F.length("text").alias("chars"), tx.script_ratio(F.col("text"), script).alias("ratio"))
    rows = stored(rows, "thresholds")
    hit = values_at(rows, "chars", lambda n: {"p25": n // 4})
    quarter = rows.sparkSession.createDataFrame([tuple(hit.values())] if hit else [], "p25 int")
    middle = lambda c: medians(rows, c).select(F.col("median").alias(f"median_{c}"))
    found = rows.agg(F.count("*").alias("n"), F.min("ratio").alias("least")).join(middle("chars")).join(middle("ratio")).join(quarter)
    p25 = F.col("p25")
    chars = F.greatest(F.lit(20), F.least(p25, F.floor(F.col("median_chars") * 0.5).cast("int")))
    ratio = F.when((F.col("least") >= 0.4) | (F.col("median_ratio") >= 0.5), 0.4).otherwise(0.0)
    return found.select(chars.alias("min_chars"), ratio.alias("min_script_ratio"), "n", F.floor("median_chars").alias("median_chars"), F.round("median_ratio", 2).alias("median_ratio"))


def subject_totals(counts: DataFrame) -> DataFrame:
    """Of (subject, stage, source, n), the records by stage, the largest raw source and the number of raw sources."""
    total = lambda s: F.coalesce(F.sum(F.when(F.col("stage") == s, F.col("n"))), F.lit(0)).alias(s)
    raw = F.col("stage") == "raw"
    largest = F.max_by(F.when(raw, F.col("source")), F.when(raw, F.struct("n", "source"))).alias("primary_source")
    return counts.groupBy("subject").agg(total("raw"), total("clean"), total("export"), largest, F.count_if(raw).alias("raw_sources"))


def corpus_totals(totals: DataFrame) -> DataFrame:
    """(buckets, n_rows, words, lines) over the primary buckets; sidecars are left out."""
    main = totals.filter(~F.col("sidecar"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return main.agg(F.count("*").alias("buckets"), total("n_rows"), total("words"), total("lines"))


def labelled_totals(totals: DataFrame, names: DataFrame) -> DataFrame:
    """Buckets' totals with a label, most rows first. names: subject, name_ar, name_en; as many as are configured."""
    known = names.select(F.col("subject").alias("bucket"), tx.nonempty(F.col("name_ar")).alias("ar"), tx.nonempty(F.col("name_en")).alias("en"))
    both = F.concat(F.col("ar"), F.lit(" ("), F.col("en"), F.lit(")"))
    labelled = totals.join(known, "bucket", "left").withColumn("label", F.coalesce(both, "ar", "en", "bucket")).drop("ar", "en")
    return labelled.orderBy(F.desc("n_rows"), "bucket")


def subject_sources(counts: DataFrame, subjects: DataFrame) -> DataFrame:
    """(subject, stage, source, n): raw sources that are named like a subject or end with its name behind '-' or '_', and
    clean and exported ones that are named like it or start with its name before '__'. Each source's possible subjects are
    listed and joined by equality."""
    source, at = F.col("source"), F.sequence(F.lit(1), F.greatest(F.length("source"), F.lit(1)))
    ends = F.transform(F.filter(at, lambda i: F.substr(source, i, F.lit(1)).isin("-", "_")), lambda i: F.substr(source, i + 1))
    starts = F.transform(F.filter(at, lambda i: F.substr(source, i, F.lit(2)) == "__"), lambda i: F.substr(source, F.lit(1), i - 1))
    named = F.array_distinct(F.concat(F.array(source), F.when(F.col("stage") == "raw", ends).otherwise(starts)))
    return counts.select("stage", "source", "n", F.explode(named).alias("subject")).join(subjects.select("subject").distinct(), "subject").select("subject", "stage", "source", "n")


def sample_profile(samples: DataFrame, script: str = tx.ARABIC) -> DataFrame:
    """(samples, with_title, with_text, median_chars, median_ratio) of titles and texts; medians are of texts that aren't
    empty, 0 where there are none."""
    rows = samples.select(tx.nonempty(F.trim("title")).alias("title"), tx.nonempty(F.col("text")).alias("text"))
    rows = stored(rows.select(F.col("title").isNotNull().alias("titled"), F.length("text").alias("chars"), F.when(F.col("text").isNotNull(), tx.script_ratio(F.col("text"), script)).alias("ratio")), "profile")
    middle = lambda c: medians(rows, c).select(F.col("median").alias(c))
    counts = rows.agg(F.count("*").alias("samples"), F.count_if("titled").alias("with_title"), F.count("chars").alias("with_text"))
    zero = F.lit(0.0)
    return counts.join(middle("chars")).join(middle("ratio")).select("samples", "with_title", "with_text", F.floor(F.coalesce("chars", zero)).alias("median_chars"), F.round(F.coalesce("ratio", zero), 2).alias("median_ratio"))


def scrape_totals(records: DataFrame, source: str = "source") -> DataFrame:
    """(source, n): the records of each source, and of all under a null source."""
    return records.rollup(source).agg(F.count("*").alias("n"), F.grouping(source).alias("__all")).filter((F.col("__all") == 1) | F.col(source).isNotNull()).drop("__all")


def progress_summary(entries: DataFrame, within: Column) -> DataFrame:
    """(entries, within, total_duration, total_bytes) of media entries with duration and bytes; ``within`` tells which pass."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}")
    return entries.agg(F.count("*").alias("entries"), F.count_if(within).alias("within"), total("duration"), total("bytes"))
