"""Classifying URLs and ranking candidate sources from search hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

#: Engines whose hits are trusted, and grades of confidence, the best first.
QUALITY_ENGINES = ("google", "brave", "wikipedia", "qwant")
CONFIDENCE = ("high", "medium", "low", "reference")


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def path_parts(url: Column) -> Column:
    return F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda p: p != "")


def classify_url(url: Column) -> Column:
    """(type, name, template, confidence) that a URL's host and path suggest."""
    h, parts = F.coalesce(host(url), F.lit("")), path_parts(url)
    none = F.lit(None).cast("string")
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))

    def answer(kind: str, name: Column, template: Column, confidence: str) -> Column:
        return F.struct(F.lit(kind).alias("type"), name.alias("name"), template.alias("template"), F.lit(confidence).alias("confidence"))

    channel = F.when((first == "s") & second.isNotNull(), second).otherwise(first)
    return (
        F.when((F.startswith(h, F.lit("t.me")) | (h == "telegram.me")) & first.isNotNull(), answer("telegram_web", channel, none, "high"))
        .when(h.isin("x.com", "twitter.com") & first.isNotNull(), answer("x_syndication", first, none, "medium"))
        .when(F.contains(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/cat-poet-")), answer("list_detail", none, url, "high"))
        .when(F.rlike(url, F.lit(r"[?&]page=\d+")), answer("paginated", none, F.regexp_replace(url, r"(page=)\d+", "$1{page}"), "medium"))
        .otherwise(answer("list_detail", none, url, "low"))
    )


def merge_hits(hits: DataFrame) -> DataFrame:
    """The first hit of each URL over all query variants, by query and rank."""
    return hits.groupBy("url").agg(F.min_by(F.struct("*"), F.struct("query_ord", "rank")).alias("h")).select("h.*")


def random_looking(domain: Column) -> Column:
    """A short name under a short top-level domain, with hardly any vowels, hardly anything else, or consonants in a row."""
    parts = F.split(domain, "[.]")
    name, top = F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1))
    vowels = F.regexp_count(name, F.lit("[aeiouy]"))
    odd = (vowels == 0) | (vowels >= F.length(name) - 1) | F.rlike(name, F.lit("[bcdfghjklmnpqrstvwxz]{3,}"))
    return F.coalesce((F.length(top) <= 3) & F.length(name).between(4, 9) & odd, F.lit(False))


def domain_candidates(hits: DataFrame, known: DataFrame, excluded: DataFrame, wanted_script: str | None = None, evidence: int = 3) -> DataFrame:
    """(site, url, confidence, n_hits, evidence): hits by host, those of excluded hosts left out. known has site and
    confidence, high or reference; the hosts of others are low, and stay only if they look like no spam and, with a wanted
    script, if a hit is mostly written in it."""
    rows = hits.withColumn("site", host(F.col("url"))).filter(F.col("site").isNotNull()).join(excluded.select("site"), "site", "left_anti")
    snippet = tx.trim_space(F.coalesce("snippet", F.lit(""))) != ""
    words = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")))
    ratio = tx.script_ratio(words, wanted_script) if wanted_script else F.lit(1.0)
    first = F.array_sort(F.collect_list(F.struct("ord", "title", "url")))
    # of each host, only the first few hits are gathered

    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy("ord")))
    gathered = rows.filter(F.col("place") <= evidence).groupBy("site").agg(F.transform(first, lambda x: F.struct(x["title"], x["url"])).alias("evidence"))
    grouped = rows.groupBy("site").agg(
        F.min_by("url", "ord").alias("url"),
        F.count("*").alias("n_hits"),
        F.bool_or(F.lower("engine").isin(*QUALITY_ENGINES)).alias("quality"),
        F.bool_or(snippet).alias("snippets"),
        F.bool_or(ratio >= 0.4).alias("relevant"),
    )
    joined = grouped.join(known.select("site", "confidence"), "site", "left").withColumn("confidence", F.coalesce("confidence", F.lit("low")))
    path = F.trim(F.coalesce(F.try_parse_url(F.col("url"), F.lit("PATH")), F.lit("")), F.lit("/"))
    spam = (~F.col("quality") & (~F.col("snippets") | random_looking(F.col("site")))) | (F.rlike(path, F.lit("^[a-z]{3,12}$")) & ~F.col("snippets"))
    kept = joined.filter((F.col("confidence") != "low") | (~spam & F.col("relevant")))
    return kept.join(gathered, "site").select("site", "url", "confidence", "n_hits", "evidence")


def ranked(candidates: DataFrame) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, CONFIDENCE)), F.col("confidence"))
    return candidates.orderBy(F.when(place == 0, 99).otherwise(place), F.desc("n_hits"), "site")


def merge_candidates(probed: DataFrame, searched: DataFrame) -> DataFrame:
    """One candidate of each URL: the probe's where there is one, with the search's evidence."""
    right = searched.select("url", *(F.col(c).alias(f"__{c}") for c in ("site", "confidence", "n_hits")))
    both = probed.select("url", "site", "confidence").join(right, "url", "full")
    return both.select("url", F.coalesce("site", "__site").alias("site"), F.coalesce("confidence", "__confidence").alias("confidence"), F.coalesce("__n_hits", F.lit(0)).alias("n_hits"))


#: The variants' words are fixed values.
def query_variants(subjects: DataFrame) -> DataFrame:
    """(name, ord, query): search queries for subjects (name, type)."""
    name = F.trim(F.trim("name"), F.lit('"'))
    quoted = F.concat(F.lit('"'), name, F.lit('"'))
    with_ = lambda a, b: F.concat(a, F.lit(b))
    variants = (
        F.when(F.col("type").isin("poet", "person"), F.array(with_(quoted, " شعر"), with_(quoted, " قصيدة"), with_(quoted, " ديوان"), quoted))
        .when(F.col("type") == "topic", F.array(with_(name, " شعر"), with_(name, " ديوان قصائد"), F.concat(F.lit("قصائد عن "), name), with_(name, " موضوع شعري")))
        .when(F.col("type") == "site", F.array(name))
        .otherwise(F.array(quoted, name))
    )
    return subjects.select("name", F.posexplode(variants).alias("ord", "query"))


def project_hits(hits: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, id, title, thumbnail, channel, url) of video search hits."""
    url = F.when(F.col("id").isNotNull(), F.concat(F.lit("https://www.youtube.com/watch?v="), "id"))
    return hits.select(*keep, "id", "title", F.try_element_at("thumbnails", F.lit(-1)).alias("thumbnail"), F.coalesce("channel", "uploader").alias("channel"), url.alias("url"))
