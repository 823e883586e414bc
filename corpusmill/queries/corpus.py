"""Cleaning runs, categories, curation, statistics, facets and incremental state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as rl
from ..functions import text as tx
from ..operators import browse, curation, incremental, stats
from ..operators import categorize as ct
from ..operators import dedup as dd
from ..scratch import scratch_path, stored
from ..sources import io
from ..streaming import corpus as st
from .registry import query, table
from .text import SP, SQL_LINES, SQL_TITLE, documents, first_line


def records(spark, sf_dir):
    """Documents as clean records: bucket = lang, topics = the words of the first line, joined."""
    topics = F.array_join(F.split(F.lower(first_line()), "[^\\p{L}]+"), "|")
    return documents(spark, sf_dir).select("doc_id", "text", "lang", "source", topics.alias("topics"), first_line().alias("title"), tx.word_count(F.col("text")).alias("word_count"), tx.line_count(F.col("text")).alias("line_count"))


_WORDS = rf"len(list_filter(string_split_regex(text, '{SP}+'), lambda w: w <> ''))"
_LINES = rf"len(list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '{SP}+', '', 'g') <> ''))"
_TOPICS = rf"array_to_string(string_split_regex(lower({SQL_TITLE}), '[^\p{{L}}]+'), '|')"
_R = f"r AS (SELECT doc_id, text, lang, source, {_TOPICS} AS topics, {SQL_TITLE} AS title, {_WORDS} AS word_count, {_LINES} AS line_count FROM documents)"


@query(rf"""WITH c AS (SELECT doc_id, lang, source, regexp_replace(regexp_replace(regexp_replace(text, '\n{{3,}}', chr(10) || chr(10), 'g'), '(?m)[\p{{Zs}}\t\f\r\x0B]+$', '', 'g'), '^{SP}+|{SP}+$', '', 'g') AS text FROM documents),
 k AS (SELECT *, left(sha256('||' || text), 16) AS id FROM c WHERE length(text) >= 20),
 s AS (SELECT lang, id, min(doc_id) AS doc_id, count(*) AS n_records FROM k GROUP BY lang, id),
 o AS (SELECT lang, id, source, min(doc_id) AS first FROM k GROUP BY lang, id, source),
 p AS (SELECT lang, id, array_to_string(list(source ORDER BY first, source), '|') AS sources FROM o GROUP BY lang, id)
 SELECT s.doc_id, s.id, s.lang AS bucket, s.n_records, p.sources, {_WORDS}::INT AS word_count, {_LINES}::INT AS line_count FROM s JOIN p ON s.lang = p.lang AND s.id = p.id JOIN k ON k.doc_id = s.doc_id""")
def clean_slice(spark, sf_dir):
    """Normalise, filter, exact deduplication with provenance."""
    rules = rl.CleanRules(min_script_ratio=0.0, drop_url_dominated=False)
    rows = documents(spark, sf_dir).select(F.col("doc_id").alias("seq"), F.col("lang").alias("bucket"), "source", F.lit(None).cast("string").alias("source_url"), rl.clean_text(F.col("text"), rules)[0].alias("text"))
    rows = stored(rows, "cleaned")  # read by several branches
    kept = rows.filter(rl.reject_reason(F.col("text"), rules).isNull()).withColumn("id", tx.content_id(F.lit(None), F.col("text")))
    firsts = dd.provenance(kept, ["bucket", "id"])
    text = kept.select(F.col("seq").alias("survivor_seq"), tx.word_count(F.col("text")).alias("word_count"), tx.line_count(F.col("text")).alias("line_count"))
    return firsts.join(text, "survivor_seq").select(F.col("survivor_seq").alias("doc_id"), "id", "bucket", "n_records", F.array_join("sources", "|").alias("sources"), "word_count", "line_count")


@query("SELECT source, count(*) AS n, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents GROUP BY source")
def source_counts(spark, sf_dir):
    return io.stage_counts(documents(spark, sf_dir))


@query("""WITH l AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN left(props, 5) ELSE ' ' || props || ' ' END AS line FROM events)
 SELECT count(*) AS lines, count(*) FILTER (WHERE trim(line) = '') AS blank, count(*) FILTER (WHERE trim(line) <> '' AND NOT (json_valid(trim(line)) AND trim(line) LIKE '{%')) AS malformed FROM l""")
def jsonl_tolerant_read(spark, sf_dir):
    n = F.col("event_id")
    line = F.when(n % 5 == 0, "").when(n % 5 == 1, F.left("props", F.lit(5))).otherwise(F.concat(F.lit(" "), "props", F.lit(" ")))
    return io.rejected_lines(table(spark, sf_dir, "events").select("event_id", line.alias("value")))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id ELSE 42 END AS _run_id FROM events")
def run_stamp(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("_run_id"))
    return io.with_run(rows, 42)


@query("SELECT doc_id, coalesce(CASE WHEN contains(text, '!!') THEN 'loud' WHEN contains(text, ' | ') OR contains(text, '###') THEN 'table' END, CASE WHEN doc_id % 2 = 0 THEN 'other' END, lang) AS category FROM documents")
def categorize_rules(spark, sf_dir):
    rules = [(["!!"], "loud"), ([" | ", "###"], "table")]
    fallback = F.when(F.col("doc_id") % 2 == 0, "other")
    return documents(spark, sf_dir).select("doc_id", ct.categorize(F.col("text"), rules, F.col("lang"), fallback).alias("category"))


@query("""WITH n AS (SELECT n_name AS needle, 'nation' || (n_nationkey % 5) AS category, n_nationkey AS ord, left(n_name, 2) AS s FROM nation),
 h AS (SELECT doc_id, min_by(category, ord) AS hit FROM documents JOIN n ON contains(upper(text), n.s) GROUP BY doc_id)
 SELECT doc_id, coalesce(hit, lang) AS category FROM documents LEFT JOIN h USING (doc_id)""")
def categorize_by_rule_table(spark, sf_dir):
    """Rules from a table: two letters of nations' names as needles."""
    rows = documents(spark, sf_dir).select(F.col("doc_id").alias("seq"), F.lit("all").alias("source"), F.upper("text").alias("haystack"), F.col("lang").alias("primary"))
    rules = table(spark, sf_dir, "nation").select(F.lit("all").alias("source"), F.col("n_nationkey").alias("ord"), F.left("n_name", F.lit(2)).alias("needle"), F.concat(F.lit("nation"), (F.col("n_nationkey") % 5).cast("string")).alias("category"))
    return ct.categorize_by_table(rows, rules).select(F.col("seq").alias("doc_id"), "category")


@query("""WITH o AS (SELECT DISTINCT lang AS subject, 'cat' || min(source) OVER (PARTITION BY lang) AS category FROM documents WHERE lang <> 'es'),
 d AS (SELECT doc_id, CASE WHEN doc_id % 7 > 0 THEN lang ELSE '_unattributed' END AS subject, CASE WHEN doc_id % 3 = 0 THEN 'poetry' ELSE 'cat' || source END AS category FROM documents),
 p AS (SELECT d.*, o.subject IS NOT NULL OR (d.category = 'poetry' AND d.subject NOT IN (SELECT subject FROM o)) AS is_primary FROM d LEFT JOIN o ON o.subject = d.subject AND o.category = d.category)
 SELECT doc_id, is_primary, CASE WHEN is_primary THEN subject ELSE subject || '__' || category END AS bucket FROM p""")
def bucket_assign(spark, sf_dir):
    docs = documents(spark, sf_dir)
    sources = docs.filter("lang <> 'es'").groupBy("lang").agg(F.min("source").alias("s")).select(F.lit(None).cast("string").alias("subject"), F.col("lang").alias("poet"), F.concat(F.lit("cat"), "s").alias("primary_category"))
    rows = docs.select("doc_id", F.when(F.col("doc_id") % 7 > 0, F.col("lang")).alias("subject"), F.when(F.col("doc_id") % 3 == 0, "poetry").otherwise(F.concat(F.lit("cat"), "source")).alias("category"))
    return ct.with_bucket(rows, sources).select("doc_id", "is_primary", "bucket")


def _actions(spark, sf_dir):
    """The event log as curation actions on documents."""
    n = F.col("event_id")
    action = F.element_at(F.array(*map(F.lit, (*curation.ACTIONS, "unknown"))), (n % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(n.alias("seq"), F.when(n % 11 > 0, F.col("user_id").cast("string")).alias("id"), action.alias("action"), F.col("event_type").alias("category"), F.concat(F.lit("s"), (n % 3).cast("string")).alias("subject"), F.when(n % 2 == 0, F.lit("2020")).alias("at"))


_ACTIONS = "a AS (SELECT event_id AS seq, CASE WHEN event_id % 11 > 0 THEN user_id::VARCHAR END AS id, ['discard', 'undo_discard', 'set_category', 'set_subject', 'unknown'][(event_id % 5 + 1)::INT] AS action, event_type AS category, 's' || (event_id % 3) AS subject, CASE WHEN event_id % 2 = 0 THEN '2020' END AS \"at\" FROM events)"
_OVERLAY = "v AS (SELECT id, coalesce(max_by(action, seq) FILTER (WHERE action IN ('discard', 'undo_discard')) = 'discard', false) AS discarded, max_by(category, seq) FILTER (WHERE action = 'set_category') AS category, max_by(subject, seq) FILTER (WHERE action = 'set_subject') AS subject FROM a WHERE id IS NOT NULL GROUP BY id)"


@query(f"WITH {_ACTIONS}, {_OVERLAY} SELECT * FROM v")
def overlay_collapse(spark, sf_dir):
    return curation.overlay(_actions(spark, sf_dir))


@query(f"WITH {_ACTIONS}, {_OVERLAY} SELECT doc_id, coalesce(v.category, 'poetry') AS category, coalesce(v.subject, d.lang) AS subject FROM documents d LEFT JOIN v ON v.id = d.doc_id::VARCHAR WHERE NOT coalesce(discarded, false)")
def curation_overlay(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.col("doc_id").cast("string").alias("id"), F.lit("poetry").alias("category"), F.col("lang").alias("subject"))
    return curation.apply_overlay(rows, curation.overlay(_actions(spark, sf_dir))).select("doc_id", "category", "subject")


@query(f"WITH {_ACTIONS} SELECT seq, id, action, coalesce(\"at\", '2024') AS \"at\" FROM a WHERE action <> 'unknown' AND id IS NOT NULL")
def curation_valid_actions(spark, sf_dir):
    return curation.valid_actions(_actions(spark, sf_dir), F.lit("2024")).select("seq", "id", "action", "at")


@query(f"WITH {_ACTIONS} SELECT seq, action FROM a ORDER BY seq DESC LIMIT 200")
def curation_last_actions(spark, sf_dir):
    return curation.last_actions(_actions(spark, sf_dir)).select("seq", "action")


_KINDS = "t AS (SELECT doc_id, lang, left(sha256(text), 16) AS id, source, ['telegram_mtproto', 'list_detail', 'telegram_web', 'x_syndication', 'youtube_channel', 'fixture'][(doc_id % 6 + 1)::INT] AS type FROM documents)"


@query(f"WITH {_KINDS}, p AS (SELECT *, CASE type WHEN 'telegram_mtproto' THEN 10 WHEN 'list_detail' THEN 20 WHEN 'telegram_web' THEN 50 WHEN 'x_syndication' THEN 60 WHEN 'fixture' THEN 100 ELSE 90 END AS priority, CASE type WHEN 'list_detail' THEN 'aldiwan' WHEN 'x_syndication' THEN 'x' WHEN 'fixture' THEN 'fixture' WHEN 'youtube_channel' THEN 'youtube_channel' ELSE 'telegram' END AS kind FROM t) SELECT doc_id, lang, id, source, kind FROM p QUALIFY row_number() OVER (PARTITION BY lang, id ORDER BY priority, source, doc_id) = 1")
def source_priority_first(spark, sf_dir):
    types = ("telegram_mtproto", "list_detail", "telegram_web", "x_syndication", "youtube_channel", "fixture")
    kind = F.element_at(F.array(*map(F.lit, types)), (F.col("doc_id") % 6 + 1).cast("int"))
    rows = documents(spark, sf_dir).select("doc_id", "lang", F.left(F.sha2("text", 256), F.lit(16)).alias("id"), "source", kind.alias("type"))
    first = dd.first_of_each(rows, ["lang", "id"], [ct.source_priority(F.col("type")), F.col("source"), F.col("doc_id")])
    return first.select("doc_id", "lang", "id", "source", ct.source_kind(F.col("type")).alias("kind"))


@query("SELECT source, CASE WHEN contains(source, '1') THEN 'list_detail' ELSE 'unknown' END AS source_type, count(*) AS n FROM documents GROUP BY source")
def source_config_join(spark, sf_dir):
    """Sources with a 1 in their name are configured; the others' type is guessed from the name."""
    docs = documents(spark, sf_dir).select("doc_id", "source")
    config = docs.select(F.col("source").alias("name")).filter(F.contains("name", F.lit("1"))).distinct().withColumn("type", F.lit("list_detail"))
    return ct.join_sources(docs, config).groupBy("source", "source_type").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT DISTINCT 'feed-' || lower(c_mktsegment) || '_' || lower(replace(n_name, ' ', '-')) AS source FROM customer JOIN nation ON c_nationkey = n_nationkey),
 k AS (SELECT lower(replace(n_name, ' ', '-')) AS slug, n_nationkey AS ord FROM nation WHERE n_nationkey % 2 = 0), a AS (SELECT left(lower(n_name), 5) AS needle, lower(replace(n_name, ' ', '-')) AS slug, n_nationkey AS ord FROM nation),
 f AS (SELECT source, slug, 0 AS r, ord FROM s JOIN k ON contains(source, slug) OR contains(replace(source, '-', ''), replace(slug, '-', '')) UNION ALL SELECT source, a.slug, 1, a.ord FROM s JOIN a ON contains(source, needle) WHERE a.slug IN (SELECT slug FROM k))
 SELECT s.source, (SELECT min_by(slug, r * 1000 + ord) FROM f WHERE f.source = s.source) AS subject FROM s""")
def subject_guess(spark, sf_dir):
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    slug = F.lower(F.replace(F.col("n_name"), F.lit(" "), F.lit("-")))
    names = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("feed-"), F.lower("c_mktsegment"), F.lit("_"), slug).alias("source")).distinct()
    subjects = nation.filter("n_nationkey % 2 = 0").select(slug.alias("slug"), F.col("n_nationkey").alias("ord"))
    aliases = nation.select(F.left(F.lower("n_name"), F.lit(5)).alias("needle"), slug.alias("slug"), F.col("n_nationkey").alias("ord"))
    return ct.guess_subjects(names, subjects, aliases)


_OUTCOMES = "o AS (SELECT doc_id, source, lang, CASE WHEN length(text) < 400 THEN 'filtered' WHEN row_number() OVER (PARTITION BY lang, sha256(text) ORDER BY doc_id) > 1 THEN 'duplicate' ELSE 'kept' END AS status FROM documents)"


@query(f"WITH {_OUTCOMES} SELECT source, lang, count(*) AS input, count(*) FILTER (WHERE status = 'kept') AS kept, count(*) FILTER (WHERE status = 'filtered') AS dropped_filter, count(*) FILTER (WHERE status IN ('duplicate', 'fragment')) AS dropped_dedup FROM o GROUP BY source, lang")
def clean_status_stats(spark, sf_dir):
    rows = documents(spark, sf_dir).select(F.col("doc_id").alias("seq"), "source", "lang", F.length("text").alias("chars"), F.sha2("text", 256).alias("id"))
    first = rows.filter("chars >= 400").groupBy("lang", "id").agg(F.min("seq").alias("first"))
    status = F.when(F.col("chars") < 400, "filtered").when(F.col("seq") > F.col("first"), "duplicate").otherwise("kept")
    return stats.status_counts(rows.join(first, ["lang", "id"], "left").withColumn("status", status), ["source", "lang"])


@query(f"WITH {_R} SELECT lang AS bucket, count(*) AS n_rows, sum(word_count)::BIGINT AS words, sum(line_count)::BIGINT AS lines, false AS sidecar FROM r GROUP BY lang")
def bucket_stats(spark, sf_dir):
    return stats.bucket_totals(records(spark, sf_dir).withColumnRenamed("lang", "bucket"))


@query(f"WITH {_R}, v AS (SELECT list(word_count ORDER BY word_count) AS l, count(*) AS n FROM r), p AS (SELECT unnest([50, 90, 99]) AS percent) SELECT percent, l[(round_even(percent / 100.0 * (n - 1), 0) + 1)::BIGINT]::INT AS value FROM v, p")
def corpus_percentiles(spark, sf_dir):
    return stats.nearest_rank_percentiles(records(spark, sf_dir), "word_count")


@query("SELECT count(*) FILTER (WHERE s > 1) AS multi_source, count(*) AS texts FROM (SELECT count(DISTINCT source) AS s FROM documents GROUP BY sha256(text))")
def multi_source_count(spark, sf_dir):
    rows = documents(spark, sf_dir).select(F.sha2("text", 256).alias("id"), "source", F.lit(None).cast("string").alias("source_url"), F.col("doc_id").alias("seq"))
    return dd.provenance(rows, ["id"]).agg(F.count_if(F.size("sources") > 1).alias("multi_source"), F.count("*").alias("texts"))


@query("WITH s AS (SELECT sha256(text) AS id, source FROM documents GROUP BY ALL) SELECT source AS value, count(*) AS n FROM s GROUP BY source ORDER BY n DESC, value LIMIT 30")
def source_frequency(spark, sf_dir):
    rows = documents(spark, sf_dir).select(F.sha2("text", 256).alias("id"), "source", F.lit(None).cast("string").alias("source_url"), F.col("doc_id").alias("seq"))
    return stats.source_frequency(dd.provenance(rows, ["id"]))


_FACETS = f"{_R}, f AS (SELECT source, 'topics' AS facet, trim(unnest(string_split(topics, '|'))) AS value FROM r UNION ALL SELECT source, 'lang', lang FROM r), c AS (SELECT source, facet, value, count(*) AS n FROM f WHERE value <> '' GROUP BY source, facet, value)"


@query(f"WITH {_FACETS} SELECT source, facet, value, n FROM c QUALIFY row_number() OVER (PARTITION BY source, facet ORDER BY n DESC, value) <= CASE facet WHEN 'topics' THEN 50 ELSE 20 END")
def facet_counts(spark, sf_dir):
    return stats.facet_counts(records(spark, sf_dir), {"topics": 50, "lang": 20}, multi=("topics",), by=("source",))


@query(f"WITH {_FACETS} SELECT value, sum(n)::BIGINT AS n FROM c WHERE facet = 'topics' GROUP BY value ORDER BY n DESC, value LIMIT 50")
def top_topics(spark, sf_dir):
    return stats.top_counts(stats.multi_values(records(spark, sf_dir), "topics"), "topics", 50)


@query(f"WITH {_R}, m AS (SELECT * FROM r WHERE lang = 'en' AND contains(topics, 'th') AND contains(lower(text), 'idiot') = false) SELECT doc_id, (SELECT count(*) FROM m) AS total FROM m ORDER BY doc_id LIMIT 50 OFFSET 20")
def facet_filter_page(spark, sf_dir):
    rows = browse.facet_filter(records(spark, sf_dir), equal={"lang": "en"}, part={"topics": "th"}).filter(~F.contains(F.lower("text"), F.lit("idiot")))
    return browse.page(rows, "doc_id", 20, 50).select("doc_id", "total")


@query(f"WITH {_R} SELECT doc_id FROM r WHERE list_contains(string_split(topics, '|'), 'the')")
def facet_filter_exact(spark, sf_dir):
    return browse.facet_filter(records(spark, sf_dir), among={"topics": "the"}).select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'worthless') OR contains(lower(source), 'worthless')")
def free_text_filter(spark, sf_dir):
    return browse.free_text(documents(spark, sf_dir), "Worthless").select("doc_id")


@query("SELECT event_id FROM events WHERE coalesce(CASE WHEN event_id % 2 = 0 THEN user_id END, event_id % 50) = 7")
def lineage_filter(spark, sf_dir):
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.when(n % 2 == 0, F.col("user_id")).alias("run_id"), (n % 50).alias("_run_id"))
    return browse.of_run(rows, 7).select("event_id")


_TITLED = f"t AS (SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN {SQL_TITLE} ELSE '' END AS title, CASE WHEN doc_id % 3 = 1 THEN source END AS date, sha256(doc_id::VARCHAR) AS id FROM documents), c AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY CASE WHEN title <> '' THEN 0 WHEN date IS NOT NULL THEN 1 ELSE 2 END, coalesce(nullif(title, ''), date, id), id) AS chapter FROM t)"


def _titled(spark, sf_dir):
    n = F.col("doc_id")
    return documents(spark, sf_dir).select("doc_id", "lang", "text", "source", F.when(n % 3 == 0, first_line()).otherwise("").alias("title"), F.when(n % 3 == 1, F.col("source")).alias("date"), F.sha2(n.cast("string"), 256).alias("id"))


@query(f"WITH {_TITLED} SELECT doc_id, chapter::INT AS chapter, CASE WHEN title <> '' THEN title ELSE '#' || chapter END AS chapter_title FROM c")
def reading_order(spark, sf_dir):
    return browse.chapters(_titled(spark, sf_dir), "lang", "title", "date", "id").select("doc_id", "chapter", "chapter_title")


@query(rf"""WITH {_TITLED}, x AS (SELECT c.*, text FROM c JOIN documents USING (doc_id))
 SELECT lang, chapter::INT AS chapter, sha256('## ' || CASE WHEN title <> '' THEN title ELSE '#' || chapter END || chr(10) || chr(10) || array_to_string(list_transform({SQL_LINES}, lambda l: l || '  '), chr(10)) || chr(10)) AS block FROM x""")
def markdown_blocks(spark, sf_dir):
    blocks = browse.markdown_blocks(_titled(spark, sf_dir), "lang", "title", "text", "date", "id")
    return blocks.select("lang", "chapter", F.sha2("block", 256).alias("block"))


@query(f"WITH {_TITLED} SELECT id, coalesce(title, '') AS title, lang, '' AS category, coalesce(date, '') AS date FROM c")
def export_flat_rows(spark, sf_dir):
    """Written as CSV and read back."""
    path = scratch_path(spark, "flat")
    io.write_csv(browse.flat_rows(_titled(spark, sf_dir)), path)
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\x00").csv(path)
    return rows.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("id", "title", "lang", "category", "date")))


@query("SELECT doc_id, lang AS bucket, '{\"source\":\"' || source || '\",\"n\":\"' || n_chars || '\"}' AS meta_json FROM documents")
def parquet_export(spark, sf_dir):
    """Written by bucket and read back."""
    path = scratch_path(spark, "export")
    meta = F.create_map(F.lit("source"), "source", F.lit("n"), F.col("n_chars").cast("string"))
    io.write_export(documents(spark, sf_dir).select("doc_id", F.col("lang").alias("bucket"), meta.alias("meta")), path)
    return spark.read.parquet(path).select("doc_id", "bucket", "meta_json")


@query("WITH n AS (SELECT n_nationkey % 20 AS k, n_name AS slug FROM nation) SELECT 'k' || o.r AS slug, coalesce(CASE WHEN n.slug LIKE '%A%' THEN n.slug END, o.r_name) AS name, 'poet' AS type FROM (SELECT r_regionkey AS r, r_name FROM region) o LEFT JOIN (SELECT n_regionkey, max(n_name) AS slug FROM nation GROUP BY n_regionkey) n ON n.n_regionkey = o.r")
def manifest_merge(spark, sf_dir):
    key = lambda c: F.concat(F.lit("k"), F.col(c).cast("string")).alias("slug")
    old = table(spark, sf_dir, "region").select(key("r_regionkey"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("type"))
    new = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.max("n_name").alias("n")).select(key("n_regionkey"), F.when(F.contains("n", F.lit("A")), F.col("n")).otherwise("").alias("name"))
    return io.merge_manifests(old, new)


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_per_key(spark, sf_dir):
    return incremental.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


_POSTS = "p AS (SELECT event_type AS source, CASE WHEN event_id % 10 = 0 THEN 'x' ELSE event_id::VARCHAR END AS post_id FROM events)"


def _posts(spark, sf_dir):
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.when(n % 10 == 0, "x").otherwise(n.cast("string")).alias("post_id"))


@query(f"WITH {_POSTS} SELECT source, min(try_cast(post_id AS BIGINT)) AS min_id, max(try_cast(post_id AS BIGINT)) AS max_id, count(try_cast(post_id AS BIGINT)) AS n FROM p GROUP BY source")
def high_watermark(spark, sf_dir):
    return incremental.watermarks(_posts(spark, sf_dir))


@query(f"WITH {_POSTS}, o AS (SELECT source, max(try_cast(post_id AS BIGINT)) AS m, count(*) AS c FROM p WHERE try_cast(post_id AS BIGINT) < 400 AND source < 'p' GROUP BY source), b AS (SELECT p.* FROM p LEFT JOIN o USING (source) WHERE try_cast(post_id AS BIGINT) > coalesce(m, -1)) SELECT source, max(try_cast(post_id AS BIGINT)) AS max_id, o.m AS previous_max, coalesce(o.c, 0) + count(*) AS count_total, CASE WHEN o.m IS NULL THEN 'backfill' ELSE 'incremental' END AS mode FROM b LEFT JOIN o USING (source) GROUP BY source, o.m, o.c")
def checkpoint_advance(spark, sf_dir):
    posts = _posts(spark, sf_dir)
    old = incremental.watermarks(posts.filter((F.col("post_id").try_cast("long") < 400) & (F.col("source") < "p"))).select("source", "max_id", F.col("n").alias("count_total"))
    return incremental.advance(old, incremental.newer_than(posts, old))


@query(f"WITH {_POSTS}, l AS (SELECT source, min(try_cast(post_id AS BIGINT)) AS low FROM p WHERE try_cast(post_id AS BIGINT) > 500 GROUP BY source) SELECT source, post_id FROM p JOIN l USING (source) WHERE try_cast(post_id AS BIGINT) >= 1 AND try_cast(post_id AS BIGINT) < low")
def tail_window(spark, sf_dir):
    posts = _posts(spark, sf_dir)
    return incremental.tail_window(posts, incremental.watermarks(posts.filter(F.col("post_id").try_cast("long") > 500)))


@query("SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL WHEN value < 10 THEN 'skipped_short' WHEN value > 60 THEN 'skipped_long' END AS status FROM events")
def duration_window(spark, sf_dir):
    seconds = F.when(F.col("event_id") % 9 > 0, F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", incremental.duration_status(seconds, 10, 60).alias("status"))


def _media(spark, sf_dir):
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(n.alias("seq"), F.col("user_id").alias("video_id"), F.element_at(F.array(*map(F.lit, ("downloaded", "transcribed", "failed"))), (n % 3 + 1).cast("int")).alias("status"), F.when(n % 5 > 0, F.col("event_type")).alias("audio_path"))


_MEDIA = "m AS (SELECT event_id AS seq, user_id AS video_id, ['downloaded', 'transcribed', 'failed'][(event_id % 3 + 1)::INT] AS status, CASE WHEN event_id % 5 > 0 THEN event_type END AS audio_path FROM events), l AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY seq DESC) = 1)"


@query(f"WITH {_MEDIA} SELECT video_id, audio_path FROM l WHERE status = 'downloaded' AND audio_path IS NOT NULL AND video_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0) ORDER BY video_id LIMIT 100")
def pending_selection(spark, sf_dir):
    done = table(spark, sf_dir, "customer").filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("video_id"))
    return incremental.pending(_media(spark, sf_dir), done, most=100).select("video_id", "audio_path")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source WHEN t.text IS NOT NULL THEN t.text ELSE NULL END AS text FROM documents LEFT JOIN (SELECT conv_id, max(text) AS text FROM conversations GROUP BY conv_id) t ON t.conv_id = doc_id")
def transcript_fold(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.col("doc_id").alias("video_id"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("").alias("text"))
    spoken = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("video_id")).agg(F.max("text").alias("text"))
    return incremental.fold_transcripts(rows, spoken).select("doc_id", "text")


@query("SELECT o_orderkey AS id, l_linenumber AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 3 = 0 AND l_linenumber <> 2 UNION ALL SELECT o_orderkey, 0 FROM orders WHERE o_orderkey % 3 > 0 OR o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def nested_flatten(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_linenumber") != 2, F.struct(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("int").alias("n")))).alias("e"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return incremental.flatten_entries(orders.select(F.col("o_orderkey").alias("id"), F.lit(0).alias("n"), F.when(F.col("o_orderkey") % 3 == 0, F.col("e")).alias("entries")))


@query("""WITH c AS (SELECT lang, source, count(*) AS n, count(*) FILTER (WHERE length(text) >= 400) AS k FROM documents GROUP BY ALL) SELECT lang AS subject, sum(n)::BIGINT AS raw, sum(k)::BIGINT AS clean, 0::BIGINT AS export, (SELECT source FROM c d WHERE d.lang = c.lang ORDER BY n DESC, source DESC LIMIT 1) AS primary_source, count(*) AS raw_sources FROM c GROUP BY lang""")
def subject_stage_totals(spark, sf_dir):
    docs = documents(spark, sf_dir)
    raw = docs.groupBy(F.col("lang").alias("subject"), "source").agg(F.count("*").alias("n")).withColumn("stage", F.lit("raw"))
    clean = docs.filter(F.length("text") >= 400).groupBy(F.col("lang").alias("subject"), "source").agg(F.count("*").alias("n")).withColumn("stage", F.lit("clean"))
    return stats.subject_totals(raw.unionByName(clean))


@query("SELECT '»' AS separator, count(*) FILTER (WHERE doc_id % 10 < 8 OR contains(string_split(text, chr(10))[1], '»')) AS hits, 'Site' AS if_starts_with FROM documents")
def suggest_title_ops(spark, sf_dir):
    """Titles of pages are joined with their site: the separator and the commonest start are found."""
    rows = documents(spark, sf_dir).select(F.concat(F.when(F.col("doc_id") % 10 < 8, "Site » ").otherwise(""), first_line()).alias("title"))
    return stats.suggest_title_ops(rows)


@query(rf"""WITH d AS (SELECT text || chr(10) || 'Read more at ' || lang || chr(10) || CASE WHEN doc_id % 4 > 0 THEN 'Share this' ELSE source END AS text FROM documents),
 l AS (SELECT list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{SP}+|{SP}+$', '', 'g')), lambda x: x <> '') AS p FROM d), t AS (SELECT unnest(p[greatest(len(p) - 2, 1):]) AS line FROM l)
 SELECT line, count(*) AS n FROM t WHERE length(line) BETWEEN 4 AND 79 GROUP BY line HAVING count(*) >= greatest(2, (SELECT count(*) FROM d) // 2) ORDER BY n DESC, line LIMIT 6""")
def suggest_footer(spark, sf_dir):
    tail = F.concat(F.lit("\nRead more at "), "lang", F.lit("\n"), F.when(F.col("doc_id") % 4 > 0, "Share this").otherwise(F.col("source")))
    return stats.suggest_footers(documents(spark, sf_dir).select(F.concat("text", tail).alias("text")))


@query("""WITH d AS (SELECT length(text) AS c FROM documents WHERE text <> ''), s AS (SELECT list(c ORDER BY c) AS l, count(*) AS n, median(c) AS m FROM d)
 SELECT greatest(20, least(l[n // 4 + 1], floor(m * 0.5)::INT))::INT AS min_chars, 0.0::DOUBLE AS min_script_ratio, n, floor(m)::BIGINT AS median_chars, 0.0::DOUBLE AS median_ratio FROM s""")
def suggest_thresholds(spark, sf_dir):
    out = stats.suggest_thresholds(documents(spark, sf_dir))
    return out.select("min_chars", F.col("min_script_ratio").cast("double").alias("min_script_ratio"), "n", "median_chars", "median_ratio")


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def streaming_facet_counts(spark, sf_dir):
    """The documents as a stream, counted as they arrive."""
    docs = documents(spark, sf_dir)
    rows = spark.readStream.schema(docs.schema).parquet(f"{sf_dir}/documents.parquet*")
    return st.to_table(st.running_counts(rows, "lang", "source"), scratch_path(spark, "running-counts"))


@query("SELECT lang, left(sha256(text), 16) AS id FROM documents GROUP BY ALL")
def streaming_exact_dedup(spark, sf_dir):
    """A stream's distinct records, appended to a table."""
    docs = documents(spark, sf_dir)
    path = scratch_path(spark, "stream")
    rows = spark.readStream.schema(docs.schema).parquet(f"{sf_dir}/documents.parquet*")
    rows = rows.select("lang", F.left(F.sha2("text", 256), F.lit(16)).alias("id"))
    st.incremental(st.exact_dedup(rows, ["lang", "id"]), f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query("SELECT lang AS bucket, left(sha256(text), 16) AS id, min(doc_id) AS seq FROM documents GROUP BY ALL")
def streaming_fold(spark, sf_dir):
    """Two batches folded into clean buckets, each replacing the buckets that it touches."""
    docs = documents(spark, sf_dir)
    log, path = scratch_path(spark, "log"), scratch_path(spark, "folded")
    rows = docs.select(F.col("lang").alias("bucket"), F.left(F.sha2("text", 256), F.lit(16)).alias("id"), F.col("doc_id").alias("seq"))
    schema = "bucket string, id string, seq long"
    dedup = lambda batch: batch.groupBy("bucket", "id").agg(F.min("seq").alias("seq"))
    for part in (rows.filter("seq % 2 = 0"), rows.filter("seq % 2 = 1")):
        part.write.mode("append").parquet(log)
        st.fold_batches(st.read_log(spark, log, schema), f"{path}/clean", f"{path}/state", dedup).awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/clean")
