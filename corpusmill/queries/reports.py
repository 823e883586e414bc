"""Normalised fields, rule packs, totals and summaries, and posts of channel and timeline pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as rl
from ..functions import text as tx
from ..operators import categorize as ct
from ..operators import dedup as dd
from ..operators import discovery, incremental, order, stats
from ..operators import pages as pg
from ..scratch import scratch_path
from ..sources import io
from ..streaming import corpus as st
from .corpus import _LINES, _WORDS, records
from .registry import query, table
from .text import ACCENTED, SP, SQL_TITLE, documents, first_line

def _strip(text: str) -> str:
    return rf"regexp_replace({text}, '^{SP}+|{SP}+$', '', 'g')"


def _clean(text: str) -> str:
    return _strip(rf"regexp_replace(regexp_replace({text}, '\n{{3,}}', chr(10) || chr(10), 'g'), '(?m)[\p{{Zs}}\t\f\r\x0B]+$', '', 'g')")


def _ratio(text: str) -> str:
    return f"CASE WHEN length(regexp_replace({text}, '{SP}', '', 'g')) > 0 THEN len(regexp_extract_all({text}, '[{ACCENTED}]')) / length(regexp_replace({text}, '{SP}', '', 'g'))::DOUBLE ELSE 0.0 END"


_META = """WITH r AS (SELECT doc_id, ['telegram', 'aldiwan', 'fixture', 'other'][(doc_id % 4 + 1)::INT] AS kind, doc_id::VARCHAR AS post_id, CASE WHEN doc_id % 8 = 0 THEN '2020' END AS published_at, n_chars::VARCHAR AS views, source AS ch,
  CASE WHEN doc_id % 3 = 0 THEN lang ELSE '' END AS categories, CASE WHEN doc_id % 5 > 0 THEN 'المزيد عن ' || lang || '| ' || source || ' |متابعة' || CASE WHEN doc_id % 2 = 0 THEN '|' || lang ELSE '' END END AS poets, ' ' || source || ' ||' AS slugs FROM documents),
 l AS (SELECT doc_id, CASE kind WHEN 'telegram' THEN ['channel=' || ch, 'post_id=' || post_id, 'published_at=' || coalesce(published_at, '-'), 'views=' || views]
  WHEN 'aldiwan' THEN list_filter([CASE WHEN categories <> '' THEN 'categories=' || categories END, 'related_poet_slugs=' || trim(ch), CASE WHEN poets IS NOT NULL THEN 'related_poets=' || ch || CASE WHEN doc_id % 2 = 0 THEN '|' || (SELECT lang FROM documents d WHERE d.doc_id = r.doc_id) ELSE '' END END], lambda x: x IS NOT NULL)
  WHEN 'fixture' THEN [] ELSE ['_channel=' || ch, 'categories=' || categories, 'doc_id=' || doc_id, 'post_id=' || post_id, 'published_at=' || coalesce(published_at, '-'), 'related_poet_slugs=' || slugs, 'related_poets=' || coalesce(poets, '-'), 'views=' || views] END AS p FROM r)
 SELECT doc_id, array_to_string(list_sort(p), ';') AS meta FROM l"""


@query(_META)
def meta_by_kind(spark, sf_dir):
    n = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, ("telegram", "aldiwan", "fixture", "other"))), (n % 4 + 1).cast("int"))
    labels = F.concat(F.lit("المزيد عن "), "lang", F.lit("| "), "source", F.lit(" |متابعة"), F.when(n % 2 == 0, F.concat(F.lit("|"), "lang")).otherwise(""))
    rows = documents(spark, sf_dir).select(
        "doc_id", kind.alias("source_kind"), n.cast("string").alias("post_id"), F.when(n % 8 == 0, "2020").alias("published_at"), F.col("n_chars").alias("views"), F.col("source").alias("_channel"),
        F.when(n % 3 == 0, F.col("lang")).otherwise("").alias("categories"), F.when(n % 5 > 0, labels).alias("related_poets"), F.concat(F.lit(" "), "source", F.lit(" ||")).alias("related_poet_slugs"),
        "text", first_line().alias("title"), F.lit("u").alias("_source_url"),
    )
    pairs = F.transform(F.map_entries(ct.projected_meta(rows)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("-"))))
    return rows.select("doc_id", F.array_join(F.array_sort(pairs), ";").alias("meta"))


_SITE_TITLE = rf"regexp_replace({_strip('t')}, '{SP}+', ' ', 'g')"


@query(rf"""WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN 'الديوان » ' || {SQL_TITLE} ELSE {SQL_TITLE} || ' » x' END AS t FROM documents), c AS (SELECT doc_id, {_clean('text')} AS text, {_SITE_TITLE} AS t FROM d)
 SELECT doc_id, text, nullif(CASE WHEN starts_with(t, 'الديوان') AND contains(t, '»') THEN coalesce(nullif({_strip("list_last(string_split(t, '»'))")}, ''), t) ELSE t END, '') AS title FROM c""")
def default_site_rules(spark, sf_dir):
    """Breadcrumbs before titles and footers behind texts go."""
    rules = rl.default_rules("list_detail")
    title = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("الديوان » "), first_line())).otherwise(F.concat(first_line(), F.lit(" » x")))
    text = F.concat("text", F.lit("\n" + rl.FOOTERS[0] + " "), "lang", F.lit("\ntail"))
    return documents(spark, sf_dir).select("doc_id", rl.clean_text(text, rules)[0].alias("text"), rl.clean_title(title, rules).alias("title"))


@query(rf"""WITH d AS (SELECT doc_id, regexp_replace(regexp_replace('[موسيقى] ' || replace(text, ' ', '  ') || '(Applause)', '[\[\(](?:تصفيق|موسيقى|ضحك|تهليل|تكبير|Music|Applause|Laughter|Audience)[\]\)]', '', 'g'), ' {{2,}}', ' ', 'g') AS text FROM documents),
 c AS (SELECT doc_id, {_clean('text')} AS text FROM d) SELECT doc_id, text, CASE WHEN text = '' THEN 'empty' WHEN length(text) < 80 THEN 'chars' ELSE 'ok' END AS verdict FROM c""")
def default_caption_rules(spark, sf_dir):
    """Sound tags and double spaces go; short captions are rejected."""
    rules = rl.default_rules("youtube_transcripts").extended(min_script_ratio=0.0, drop_url_dominated=False)
    loose = F.concat(F.lit("[موسيقى] "), F.replace(F.col("text"), F.lit(" "), F.lit("  ")), F.lit("(Applause)"))
    rows = documents(spark, sf_dir).select("doc_id", rl.clean_text(loose, rules)[0].alias("text"))
    return rows.select("doc_id", "text", F.coalesce(rl.reject_reason(F.col("text"), rules), F.lit("ok")).alias("verdict"))


def _buckets(spark, sf_dir):
    """Records by language, every fourth in a sidecar."""
    bucket = F.when(F.col("doc_id") % 4 == 0, F.concat("lang", F.lit("__notes"))).otherwise(F.col("lang"))
    return stats.bucket_totals(records(spark, sf_dir).withColumn("bucket", bucket))


@query(f"SELECT count(DISTINCT lang) AS buckets, count(*) AS n_rows, sum({_WORDS})::BIGINT AS words, sum({_LINES})::BIGINT AS lines FROM documents WHERE doc_id % 4 > 0")
def corpus_totals(spark, sf_dir):
    return stats.corpus_totals(_buckets(spark, sf_dir))


@query("""WITH t AS (SELECT lang || CASE WHEN doc_id % 4 = 0 THEN '__notes' ELSE '' END AS bucket, count(*) AS n_rows FROM documents GROUP BY 1)
 SELECT bucket, n_rows, CASE bucket WHEN 'de' THEN 'DE' WHEN 'es' THEN 'n-es' ELSE CASE WHEN contains(bucket, '__') THEN bucket ELSE 'n-' || bucket || ' (' || upper(bucket) || ')' END END AS label, row_number() OVER (ORDER BY n_rows DESC, bucket) AS place FROM t""")
def labelled_totals(spark, sf_dir):
    """Buckets with their subjects' names, most rows first."""
    lang = F.col("lang")
    names = documents(spark, sf_dir).select("lang").distinct().select(lang.alias("subject"), F.when(lang != "de", F.concat(F.lit("n-"), lang)).alias("name_ar"), F.when(lang != "es", F.upper(lang)).alias("name_en"))
    found = stats.labelled_totals(_buckets(spark, sf_dir), names)
    return order.running_total(found, [-F.col("n_rows"), "bucket"], F.lit(1), "place").select("bucket", "n_rows", "label", F.col("place").cast("long").alias("place"))


_STAGES = """c AS (SELECT 'raw' AS stage, CASE doc_id % 3 WHEN 0 THEN source || '-' || lang WHEN 1 THEN source || '_' || lang ELSE lang || source END AS source FROM documents UNION ALL SELECT 'clean', CASE WHEN doc_id % 2 = 0 THEN lang ELSE lang || '__' || source END FROM documents),
 g AS (SELECT stage, source, count(*) AS n FROM c GROUP BY ALL), s AS (SELECT DISTINCT lang AS subject FROM documents)"""


@query(f"WITH {_STAGES} SELECT subject, stage, source, n FROM g JOIN s ON source = subject OR (stage = 'raw' AND (ends_with(source, '-' || subject) OR ends_with(source, '_' || subject))) OR (stage = 'clean' AND starts_with(source, subject || '__'))")
def subject_sources(spark, sf_dir):
    docs, n = documents(spark, sf_dir), F.col("doc_id")
    raw = F.when(n % 3 == 0, F.concat("source", F.lit("-"), "lang")).when(n % 3 == 1, F.concat("source", F.lit("_"), "lang")).otherwise(F.concat("lang", "source"))
    clean = F.when(n % 2 == 0, F.col("lang")).otherwise(F.concat("lang", F.lit("__"), "source"))
    counts = docs.select(F.lit("raw").alias("stage"), raw.alias("source")).unionByName(docs.select(F.lit("clean").alias("stage"), clean.alias("source"))).groupBy("stage", "source").agg(F.count("*").alias("n"))
    return stats.subject_sources(counts, docs.select(F.col("lang").alias("subject")))


@query(f"""WITH r AS (SELECT CASE WHEN doc_id % 3 = 0 THEN nullif(trim({SQL_TITLE}), '') END AS title, CASE WHEN doc_id % 7 > 0 THEN nullif(text, '') END AS text FROM documents)
 SELECT count(*) AS samples, count(title) AS with_title, count(text) AS with_text, floor(coalesce(median(length(text)), 0))::BIGINT AS median_chars, round(coalesce(median(CASE WHEN text IS NOT NULL THEN {_ratio('text')} END), 0), 2) AS median_ratio FROM r""")
def sample_profile(spark, sf_dir):
    n = F.col("doc_id")
    rows = documents(spark, sf_dir).select(F.when(n % 3 == 0, first_line()).alias("title"), F.when(n % 7 > 0, F.col("text")).otherwise("").alias("text"))
    return stats.sample_profile(rows, ACCENTED)


@query("SELECT source, count(*) AS n FROM documents GROUP BY ROLLUP(source)")
def scrape_totals(spark, sf_dir):
    return stats.scrape_totals(documents(spark, sf_dir))


@query("SELECT count(*) AS entries, count(*) FILTER (WHERE d BETWEEN 10 AND 60) AS within, sum(d)::BIGINT AS total_duration, sum(user_id)::BIGINT AS total_bytes FROM (SELECT user_id, CASE WHEN event_id % 9 > 0 THEN floor(value)::BIGINT END AS d FROM events)")
def progress_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 9 > 0, F.floor("value")).alias("duration"), F.col("user_id").alias("bytes"))
    return stats.progress_summary(rows, F.col("duration").between(10, 60))


@query("SELECT conv_id::VARCHAR AS video_id, min(text) AS text FROM conversations WHERE text <> '' GROUP BY conv_id")
def transcript_provider(spark, sf_dir):
    """A provider of one's own, registered by name."""
    turns = lambda spark, path: spark.read.parquet(path).select(F.col("conv_id").cast("string").alias("video_id"), "text")
    io.TRANSCRIPT_PROVIDERS["turns"] = turns
    return io.read_transcripts(spark, "turns", path=f"{sf_dir}/conversations.parquet")


@query("SELECT doc_id, NULL::BIGINT AS item_id, source, length(text) AS chars FROM documents UNION ALL SELECT NULL, item_id, 'benchmark', length(text) FROM benchmark UNION ALL SELECT NULL, NULL, role, length(text) FROM conversations")
def union_of_sources(spark, sf_dir):
    chars = F.length("text").cast("long").alias("chars")
    marks = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("item_id"), F.lit("benchmark").alias("source"), chars)
    turns = table(spark, sf_dir, "conversations").select(F.col("role").alias("source"), chars)
    return io.union_all(documents(spark, sf_dir).select("doc_id", "source", chars), marks, turns).select("doc_id", "item_id", "source", "chars")


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 20")
def per_source_cap(spark, sf_dir):
    return incremental.cap_per_source(documents(spark, sf_dir), 20, order="doc_id").select("doc_id", "source")


@query("SELECT doc_id, doc_id > min(doc_id) OVER (PARTITION BY lang, sha256(text)) AS is_dup FROM documents")
def duplicate_flag(spark, sf_dir):
    rows = documents(spark, sf_dir).select(F.col("doc_id").alias("seq"), "lang", F.sha2("text", 256).alias("id"))
    return dd.exact_duplicates(rows, ["lang", "id"]).select(F.col("seq").alias("doc_id"), "is_dup")


_SIGNAL = rf"h AS (SELECT doc_id, 'h' || (doc_id % 97) || '.org' AS site, {SQL_TITLE} || ' ' || CASE WHEN doc_id % 61 = 0 THEN regexp_replace(text, '[^{ACCENTED}]', '', 'g') ELSE text END AS t FROM documents)"


@query(f"WITH {_SIGNAL} SELECT site, count(*) AS n_hits FROM h GROUP BY site HAVING bool_or({_ratio('t')} >= 0.4)")
def relevance_gate(spark, sf_dir):
    """Unknown hosts stay if a hit is mostly written in the wanted script."""
    n = F.col("doc_id")
    host = F.concat(F.lit("h"), (n % 97).cast("string"), F.lit(".org"))
    snippet = F.when(n % 61 == 0, F.regexp_replace("text", f"[^{ACCENTED}]", "")).otherwise(F.col("text"))
    hits = documents(spark, sf_dir).select(n.alias("ord"), F.concat(F.lit("https://"), host, F.lit("/a/b/"), n.cast("string")).alias("url"), first_line().alias("title"), snippet.alias("snippet"), F.lit("google").alias("engine"))
    none = hits.filter("false").select(discovery.host(F.col("url")).alias("site"), F.lit("low").alias("confidence"))
    return discovery.domain_candidates(hits, none, none, wanted_script=ACCENTED).select("site", "n_hits")


def _escaped(text):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


@query(rf"SELECT doc_id AS post_id, sha256({_strip('text')}) AS text, 'https://t.me/' || source || '/' || doc_id AS permalink FROM documents WHERE doc_id % 10 > 0")
def channel_page_posts(spark, sf_dir):
    """Documents set as pages of a channel's web mirror, every tenth without an integer id."""
    number = F.when(F.col("doc_id") % 10 == 0, "none").otherwise(F.col("doc_id").cast("string"))
    html = F.concat(F.lit('<div class="tgme_widget_message"><a data-post="c/'), number, F.lit('"></a><div class="tgme_widget_message_text">'), _escaped(F.col("text")), F.lit('</div><time datetime="2020"></time></div>'))
    pages = documents(spark, sf_dir).select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), html.alias("html"))
    return pg.channel_posts(pages, F.col("url")).select("post_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text"), "permalink")


@query("SELECT doc_id::VARCHAR AS tweet_id, sha256(text) AS text, CASE WHEN doc_id % 3 = 0 THEN '/p/' || doc_id ELSE '/' || source || '/status/' || doc_id END AS permalink FROM documents WHERE doc_id % 7 > 0")
def timeline_posts(spark, sf_dir):
    """Documents embedded as JSON in pages, every seventh entry without a post."""
    n, own = F.col("doc_id"), F.col("doc_id").cast("string")
    tweet = F.struct(
        F.when(n % 2 == 0, own).alias("id_str"), n.alias("id"), F.when(n % 5 == 0, F.col("text")).otherwise("").alias("text"), F.when(n % 5 > 0, F.col("text")).alias("full_text"),
        F.when(n % 3 == 0, F.concat(F.lit("/p/"), own)).alias("permalink"), F.struct(F.col("source").alias("screen_name")).alias("user"),
    )
    entries = F.array(F.struct(F.struct(F.when(n % 7 > 0, tweet).alias("tweet")).alias("content")))
    document = F.to_json(F.struct(F.struct(F.struct(F.struct(entries.alias("entries")).alias("timeline")).alias("pageProps")).alias("props")))
    html = F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), document, F.lit("</script></html>"))
    pages = documents(spark, sf_dir).select(n.alias("page_id"), html.alias("html"))
    return pg.embedded_timeline(pages).select("tweet_id", F.sha2("text", 256).alias("text"), "permalink")


@query(rf"SELECT doc_id AS seq, left(sha256('||' || text), 16) AS id, {_WORDS}::INT AS word_count FROM (SELECT doc_id, {_clean('text')} AS text FROM documents) WHERE length(text) >= 20")
def streaming_clean(spark, sf_dir):
    """A raw log that grows twice, cleaned as a stream after each time."""
    log, path = scratch_path(spark, "raw-log"), scratch_path(spark, "cleaned")
    none = F.lit(None).cast("string")
    rows = documents(spark, sf_dir).select(F.col("doc_id").alias("seq"), "source", F.lit("x_syndication").alias("source_type"), none.alias("title"), "text", none.alias("source_url"), F.col("lang").alias("subject"))
    rules = {"x_syndication": rl.CleanRules(min_script_ratio=0.0, drop_url_dominated=False)}
    for part in (rows.filter("seq % 2 = 0"), rows.filter("seq % 2 = 1")):
        part.write.mode("append").parquet(log)
        stream = st.read_log(spark, log, "seq long, source string, source_type string, title string, text string, source_url string, subject string")
        st.clean_increment(stream, f"{path}/out", f"{path}/state", rules)
    return spark.read.parquet(f"{path}/out").select("seq", "id", "word_count")


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS source, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY ALL")
def source_discovery(spark, sf_dir):
    """Sources found in a stage's folder: JSON lines before Parquet of the same name, names that start with '_' left out."""
    folder = scratch_path(spark, "stage")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    even = docs.filter("doc_id % 2 = 0")
    even.select(F.to_json(F.struct("*"))).write.text(f"{folder}/even.jsonl")
    even.withColumn("text", F.lit("")).write.parquet(f"{folder}/even.parquet")  # passed over
    docs.filter("doc_id % 2 <> 0").write.parquet(f"{folder}/odd.parquet")
    docs.select("text").write.text(f"{folder}/_index.jsonl")
    found = io.read_stage(spark, folder, "doc_id long, text string")
    return found.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
