"""Text expressions, rules and filters over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as rl
from ..functions import text as tx
from ..functions.repair import repaired
from ..scratch import stored
from .registry import query, table


def first_line():
    """A document's first line stands in for its title."""
    return F.element_at(F.split("text", "\n", -1), 1)


SQL_TITLE = "string_split(text, chr(10))[1]"
SP = r"[\s\x0B\x1C-\x1F\x{0085}\p{Z}]"
SQL_LINES = "(CASE WHEN text LIKE '%' || chr(10) THEN list_slice(string_split(text, chr(10)), 1, -2) ELSE string_split(text, chr(10)) END)"
#: Accented letters: a script class that the documents have.
ACCENTED = r"\x{00C0}-\x{024F}"


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(f"SELECT doc_id, left(sha256({SQL_TITLE} || '||' || text), 16) AS id FROM documents")
def content_id(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.content_id(first_line(), F.col("text")).alias("id"))


@query(rf"""SELECT doc_id, len(list_filter(string_split_regex(text, '{SP}+'), lambda w: w <> ''))::INT AS n_words,
 len(list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '{SP}+', '', 'g') <> ''))::INT AS n_lines FROM documents""")
def word_line_counts(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.word_count(F.col("text")).alias("n_words"), tx.line_count(F.col("text")).alias("n_lines"))


@query(rf"""SELECT doc_id, round(r, 9) AS ratio, CASE WHEN r >= 0.05 THEN 'accented' ELSE 'other' END AS lang FROM (SELECT doc_id,
 CASE WHEN n > 0 THEN len(regexp_extract_all(text, '[{ACCENTED}]')) / n::DOUBLE ELSE 0.0 END AS r FROM (SELECT *, length(regexp_replace(text, '{SP}', '', 'g')) AS n FROM documents))""")
def script_ratio_lang(spark, sf_dir):
    text = F.col("text")
    return documents(spark, sf_dir).select("doc_id", F.round(tx.script_ratio(text, ACCENTED), 9).alias("ratio"), tx.language(text, ACCENTED, "accented", 0.05).alias("lang"))


@query(rf"SELECT doc_id, nullif(regexp_replace(regexp_replace(text, '{SP}+', ' ', 'g'), '^{SP}+|{SP}+$', '', 'g'), '') AS title FROM documents")
def title_space(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.clean_title_space(F.col("text")).alias("title"))


@query(rf"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(text, '. ', '  ' || chr(10) || chr(10) || chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '(?m)[\p{{Zs}}\t\f\r\x0B]+$', '', 'g'), '^{SP}+|{SP}+$', '', 'g') AS text FROM documents""")
def text_space(spark, sf_dir):
    loose = F.replace(F.col("text"), F.lit(". "), F.lit("  \n\n\n"))
    return documents(spark, sf_dir).select("doc_id", tx.clean_text_space(loose).alias("text"))


@query(rf"""SELECT doc_id, CASE WHEN starts_with(t, 'Th') AND contains(t, ', ') THEN coalesce(nullif(trim(list_last(string_split(t, ', '))), ''), t) ELSE t END AS title
 FROM (SELECT doc_id, {SQL_TITLE} AS t FROM documents)""")
def title_split_last(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.split_last(first_line(), ", ", "Th").alias("title"))


@query(r"SELECT doc_id, regexp_replace(text, '([A-Za-z]+)!!', '<\1>', 'g') AS text FROM documents")
def regex_replace_op(spark, sf_dir):
    op = {"op": "regex_replace", "pattern": r"([A-Za-z]+)!!", "replacement": r"<\1>"}
    return documents(spark, sf_dir).select("doc_id", rl.TEXT_OPS["regex_replace"](F.col("text"), op).alias("text"))


MARKERS = ["All rights", "Copyright", "License", "SPDX", "de la ", "of the "]


@query(f"""SELECT doc_id, array_to_string(list_slice(l, 1, coalesce(list_min(list_filter([CASE WHEN {' OR '.join(f"contains(l[i], '{m}')" for m in MARKERS)} THEN i - 1 END FOR i IN range(1, len(l) + 1)], lambda i: i IS NOT NULL)), len(l))), chr(10)) AS text
 FROM (SELECT doc_id, {SQL_LINES} AS l FROM documents)""")
def truncate_before_markers(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.truncate_before_first_of(F.col("text"), MARKERS).alias("text"))


@query(f"SELECT doc_id, array_to_string(list_filter({SQL_LINES}, lambda x: NOT regexp_matches(x, '[|#@]|!!')), chr(10)) AS text FROM documents")
def strip_lines(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.strip_lines_matching(F.col("text"), "[|#@]|!!").alias("text"))


@query(r"""WITH e AS (SELECT event_id, 'on ' || (day(ts) + 20 * (event_id % 3)) || '/' || (month(ts) + 3 * (event_id % 2)) || '/' || (year(ts) + 60 * (event_id % 5)) || ' ' || event_type || ' 1/1/2001' AS text FROM events),
 m AS (SELECT *, regexp_extract(text, '(\d{1,2})/(\d{1,2})/(\d{4})', ['d', 'm', 'y']) AS g FROM e),
 v AS (SELECT *, g.d::INT BETWEEN 1 AND 31 AND g.m::INT BETWEEN 1 AND 12 AND g.y::INT BETWEEN 1900 AND 2100 AS ok FROM m)
 SELECT event_id, CASE WHEN ok THEN regexp_replace(regexp_replace(text, '(\d{1,2})/(\d{1,2})/(\d{4})', ''), ' +$', '') ELSE text END AS text, CASE WHEN ok THEN g.y || '-' || lpad(g.m, 2, '0') || '-' || lpad(g.d, 2, '0') END AS date FROM v""")
def extract_date_meta(spark, sf_dir):
    """Dates from the event log, written the day-first way, some of them impossible."""
    number = lambda c: c.cast("string")
    n = F.col("event_id")
    day, month, year = F.dayofmonth("ts") + 20 * (n % 3), F.month("ts") + 3 * (n % 2), F.year("ts") + 60 * (n % 5)
    text = F.concat(F.lit("on "), number(day), F.lit("/"), number(month), F.lit("/"), number(year), F.lit(" "), "event_type", F.lit(" 1/1/2001"))
    rules = rl.CleanRules(text_ops=[{"op": "extract_to_meta", "pattern": r"(\d{1,2})/(\d{1,2})/(\d{4})", "as": "iso_date_dmy", "meta_key": "date"}])
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("text"))
    cleaned, meta = rl.clean_text(F.col("text"), rules)
    return rows.select("event_id", cleaned.alias("text"), meta["date"].alias("date"))


_CHANNEL = rf"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[\x{{200C}}-\x{{200F}}\x{{202A}}-\x{{202E}}\x{{2066}}-\x{{2069}}\x{{FEFF}}]', '', 'g'), '[\x{{2600}}-\x{{27BF}}\x{{1F000}}-\x{{1FBFF}}]+', '', 'g') AS text FROM documents),
 b AS (SELECT doc_id, array_to_string(list_filter({SQL_LINES}, lambda x: NOT regexp_matches(x, '^\s*#\S+\s*$') AND NOT regexp_matches(x, '^\s*@[A-Za-z0-9_]+\s*$') AND NOT regexp_matches(x, '^[\s.\-_=•·]+$')), chr(10)) AS text FROM a),
 c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\n{{3,}}', chr(10) || chr(10), 'g'), '(?m)[\p{{Zs}}\t\f\r\x0B]+$', '', 'g'), '^{SP}+|{SP}+$', '', 'g') AS text FROM b)"""


@query(_CHANNEL + " SELECT doc_id, text FROM c")
def default_channel_rules(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", rl.clean_text(F.col("text"), rl.default_rules("telegram_web"))[0].alias("text"))


@query(_CHANNEL + rf""" SELECT doc_id, CASE WHEN text = '' THEN 'empty' WHEN length(text) < 100 THEN 'chars' WHEN len(list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '{SP}+', '', 'g') <> '')) < 2 THEN 'lines'
 WHEN len(regexp_extract_all(text, '[{ACCENTED}]')) / length(regexp_replace(text, '{SP}', '', 'g'))::DOUBLE < 0.02 THEN 'ratio' END AS reject_reason FROM c""")
def quality_filter(spark, sf_dir):
    rules = rl.default_rules("telegram_web").extended(min_chars=100, min_lines=2, min_script_ratio=0.02, script=ACCENTED)
    rows = stored(documents(spark, sf_dir).select("doc_id", rl.clean_text(F.col("text"), rules)[0].alias("text")), "cleaned")  # tested several times
    return rows.select("doc_id", rl.reject_reason(F.col("text"), rules).alias("reject_reason"))


@query(r"SELECT page_id, regexp_matches(text, 'https?://\S+') AND length(replace(text, ' ', '')) < 80 AS dominated FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'see ' ELSE url || ' ' END || CASE WHEN page_id % 3 = 0 THEN '' ELSE regexp_replace(html, '<[^>]*>', '', 'g') END AS text FROM pages)")
def url_dominated_filter(spark, sf_dir):
    start = F.when(F.col("page_id") % 4 == 0, "see ").otherwise(F.concat("url", F.lit(" ")))
    body = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.regexp_replace("html", "<[^>]*>", ""))
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(start, body).alias("text"))
    return rows.select("page_id", rl.url_dominated(F.col("text")).alias("dominated"))


_SQL_SIGNATURE = r"trim(regexp_replace(lower(regexp_replace(text, '[\x{064B}-\x{0670}\x{065F}\x{0640}]', '', 'g')), '[^\p{L}\p{N}_\x{0600}-\x{06FF}]+', ' ', 'g'))"


@query(f"SELECT doc_id, {_SQL_SIGNATURE} AS signature FROM documents")
def signature(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.signature(F.col("text")).alias("signature"))


@query(f"SELECT doc_id, CASE WHEN s = '' THEN 0 ELSE len(list_distinct([substr(s, i, 5) FOR i IN range(1, greatest(length(s) - 4, 1) + 1)])) END::INT AS n_shingles FROM (SELECT doc_id, {_SQL_SIGNATURE} AS s FROM documents)")
def shingles(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.size(tx.shingles(tx.signature(F.col("text")))).alias("n_shingles"))


@query(rf"SELECT doc_id, nullif(array_to_string(list_filter(list_transform(string_split(replace({SQL_TITLE}, ' ', '|'), '|'), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, 'th') AND x <> 'of'), '|'), '') AS labels FROM documents")
def related_labels(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.clean_labels(F.replace(first_line(), F.lit(" "), F.lit("|")), "th", "of").alias("labels"))


@query(f"SELECT doc_id, 'passage: ' || CASE WHEN t = '' OR starts_with(text, t) THEN text ELSE t || chr(10) || chr(10) || text END AS passage FROM (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN {SQL_TITLE} ELSE source END AS t FROM documents)")
def passage_builder(spark, sf_dir):
    title = F.when(F.col("doc_id") % 2 == 0, first_line()).otherwise(F.col("source"))
    return documents(spark, sf_dir).select("doc_id", tx.passage(title, F.col("text")).alias("passage"))


@query("""SELECT event_id, coalesce(CASE len(p) WHEN 3 THEN TRY_CAST(p[1] AS DOUBLE) * 3600 + TRY_CAST(p[2] AS DOUBLE) * 60 + TRY_CAST(p[3] AS DOUBLE) WHEN 2 THEN TRY_CAST(p[1] AS DOUBLE) * 60 + TRY_CAST(p[2] AS DOUBLE) WHEN 1 THEN TRY_CAST(p[1] AS DOUBLE) END, 0.0) AS seconds
 FROM (SELECT event_id, string_split(CASE event_id % 4 WHEN 0 THEN (user_id % 3) || ':' || (user_id % 60) || ':' || (event_id % 60) WHEN 1 THEN (user_id % 60) || ':' || (event_id % 60) WHEN 2 THEN (event_id % 60)::VARCHAR ELSE event_type || ':1' END, ':') AS p FROM events)""")
def duration_parse(spark, sf_dir):
    n, u = F.col("event_id"), F.col("user_id")
    s = lambda c: c.cast("string")
    hms = F.when(n % 4 == 0, F.concat_ws(":", s(u % 3), s(u % 60), s(n % 60))).when(n % 4 == 1, F.concat_ws(":", s(u % 60), s(n % 60))).when(n % 4 == 2, s(n % 60)).otherwise(F.concat("event_type", F.lit(":1")))
    return table(spark, sf_dir, "events").select("event_id", tx.seconds(hms).alias("seconds"))


@query(rf"SELECT conv_id, array_to_string(list_filter(list(regexp_replace(text, '^{SP}+|{SP}+$', '', 'g') ORDER BY turn, role, text), lambda s: s <> ''), chr(10)) AS text, count(*)::INT AS segments FROM conversations GROUP BY conv_id")
def segment_join(spark, sf_dir):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: x["text"])
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(ordered.alias("segments"))
    return rows.select("conv_id", tx.join_segments(F.col("segments")).alias("text"), F.size("segments").alias("segments"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN 'm' || user_id END, CASE WHEN event_id % 2 = 0 THEN 'd' || user_id END, 'g' || user_id) AS track FROM events")
def track_preference(spark, sf_dir):
    n, name = F.col("event_id"), lambda p: F.concat(F.lit(p), F.col("user_id").cast("string"))
    tracks = F.map_filter(F.create_map(F.lit("manual"), F.when(n % 3 == 0, name("m")), F.lit("dialect"), F.when(n % 2 == 0, name("d")), F.lit("auto"), name("g")), lambda k, v: v.isNotNull())
    return table(spark, sf_dir, "events").select("event_id", tx.preferred(tracks, "manual", "dialect", "auto").alias("track"))


@query(rf"SELECT doc_id, coalesce(nullif(trim(regexp_replace(lower(trim({SQL_TITLE})), '[^\p{{L}}\p{{N}}_]+', '-', 'g'), '-'), ''), 'poem-' || doc_id) AS anchor FROM documents")
def markdown_anchor(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.anchor(first_line(), F.col("doc_id")).alias("anchor"))


@query("SELECT lang, CASE WHEN n < 1000 THEN 'n<1K' WHEN n < 10000 THEN '1K<n<10K' WHEN n < 100000 THEN '10K<n<100K' WHEN n < 1000000 THEN '100K<n<1M' ELSE 'n>1M' END AS bracket FROM (SELECT lang, sum(n_chars) AS n FROM documents GROUP BY lang)")
def size_bracket(spark, sf_dir):
    return documents(spark, sf_dir).groupBy("lang").agg(F.sum("n_chars").alias("n")).select("lang", tx.size_bracket(F.col("n")).alias("bracket"))


@query("SELECT c_custkey, CASE WHEN n IS NOT NULL AND e IS NOT NULL THEN n || ' (' || e || ')' ELSE coalesce(n, e, c_custkey::VARCHAR) END AS label FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS n, CASE WHEN c_custkey % 2 = 0 THEN n_name END AS e FROM customer JOIN nation ON c_nationkey = n_nationkey)")
def subject_label(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("c_custkey", tx.subject_label(F.when(k % 3 > 0, F.col("c_name")), F.when(k % 2 == 0, F.col("n_name")), k.cast("string")).alias("label"))


@query("SELECT source, left(sha256('Transcribe ' || source || '. Subject: ' || lang || '.'), 12) AS prompt_hash, count(*) AS n FROM documents GROUP BY source, lang")
def prompt_hash(spark, sf_dir):
    prompt = F.concat(F.lit("Transcribe "), "source", F.lit(". Subject: "), "lang", F.lit("."))
    return documents(spark, sf_dir).groupBy("source", "lang").agg(F.count("*").alias("n")).select("source", tx.prompt_hash(prompt).alias("prompt_hash"), "n")


@query("SELECT doc_id, text FROM (SELECT doc_id, coalesce(CASE WHEN kind = 'telegram' THEN t WHEN kind = 'aldiwan' THEN coalesce(v, t) WHEN kind = 'fixture' THEN coalesce(t, v) ELSE coalesce(t, v, b) END, '') AS text FROM (SELECT doc_id, ['telegram', 'aldiwan', 'fixture', 'other'][(doc_id % 4 + 1)::INT] AS kind, nullif(CASE WHEN doc_id % 3 = 0 THEN text ELSE '' END, '') AS t, CASE WHEN doc_id % 5 = 0 THEN source END AS v, lang AS b FROM documents))")
def body_by_kind(spark, sf_dir):
    from ..operators.categorize import body

    n = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, ("telegram", "aldiwan", "fixture", "other"))), (n % 4 + 1).cast("int"))
    text, verses = F.when(n % 3 == 0, F.col("text")).otherwise(""), F.when(n % 5 == 0, F.col("source"))
    return documents(spark, sf_dir).select("doc_id", body(kind, text, verses, F.col("lang")).alias("text"))


@query("SELECT doc_id, text FROM (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM documents)")
def text_repair(spark, sf_dir):
    """Texts garbled on purpose, bytes of UTF-8 read as a single-byte code, come back as they were."""
    garbled = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    text = F.when(F.rlike(F.col("text"), F.lit(r"[\x{0080}-\x{FFFF}]")), garbled).otherwise(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", repaired(text).alias("text"))
