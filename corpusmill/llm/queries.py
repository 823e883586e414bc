"""The registered queries of this subpackage: each applies one operator to its whole table and derives digests from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, embedding_dedup, line_dedup, periodic_runs, pii, prefix_trie, quality, sentencepiece_codec, simhash, suffix_tree_lm, token_files, toxicity, warc
from .labelled import held_out


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer("piece_bpe_32k.model")
    tokens = sentencepiece_codec.encode(_table(spark, sf_dir, "documents"), model)
    return sentencepiece_codec.decode(tokens, model).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontamination.is_contaminated().alias("contaminated"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_round_trip(_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op6_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, docs = suffix_tree_lm.split(_table(spark, sf_dir, "documents"))
    return suffix_tree_lm.learn_and_score(docs, "held_out", keep=("doc_id", "held_out"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_files.token_round_trip(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(_table(spark, sf_dir, "documents"), plant="doc_id")
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.*",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    of_kind = lambda k: F.filter("base", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.as_text(F.col("base")), 256).alias("base_sha256"), pii.as_text(F.col("spans")).alias("spans"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie.build(_table(spark, sf_dir, "conversations")).report()
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_sentencepiece, op2_toxicity, op3_decontamination, op4_warc, op5_simhash, op6_suffix_tree_lm, op7_line_dedup, op8_quality, op9_token_files, op10_embedding_dedup, op11_periodic_runs, op12_pii, op13_prefix_trie, pipeline)
    return {q.__name__: q for q in every}


_OP3 = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
n AS (SELECT item_id, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0 AND item_id IS NOT NULL),
g AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS win FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM n)),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
s AS (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS win FROM p, (SELECT DISTINCT k FROM g) AS kk WHERE i + k - 1 <= len(w)),
h AS (SELECT s.doc_id, s.i, g.k, g.item_id FROM s JOIN g ON s.win = g.win AND s.k = g.k),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_OP7 = """
WITH l AS (SELECT doc_id, i, x[i] AS line, translate(trim(x[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))),
o AS (SELECT k, min(doc_id) AS owner FROM l WHERE length(k) >= 10 GROUP BY k HAVING min(doc_id) <> max(doc_id)),
m AS (SELECT l.*, o.owner IS NOT NULL AND l.doc_id <> o.owner AS gone FROM l LEFT JOIN o ON l.k = o.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


#: Base32 of the 160 bits of a digest: eight groups of five bytes' hex digits, five bits a letter.
_OP4 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
o AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes,
  list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(p.h, 10 * (k // 8) + 1, 10))::BIGINT >> (35 - 5 * (k % 8))) & 31)::INT, 1) FOR k IN range(32)], 'string_agg', '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p JOIN o USING (h)
"""

_OP10 = """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (WITH RECURSIVE c(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a) SELECT a, min(b) AS component_id FROM c GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id)::BIGINT AS n_links, component_id, component_id = vec_id AS kept FROM embeddings JOIN r ON r.a = vec_id
"""

#: CRC-32 in SQL: a table of 256 remainders, eight steps each, then one look-up for each character of the decimal number.
_CRC_STEP = "CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END"
_CRC_TABLE = "SELECT i, i AS v FROM range(256) AS r(i)"
for _ in range(8):
    _CRC_TABLE = f"SELECT i, {_CRC_STEP} AS v FROM ({_CRC_TABLE})"


def sql_crc32(number: str) -> str:
    """The unsigned CRC-32 of a number's decimal digits, where ``crc`` is (t), the list of remainders."""
    codes = f"list_transform(string_split({number}::VARCHAR, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda s, c: xor(s >> 8, t[1 + (xor(s, c) & 255)])), 4294967295)"


#: A node is the sequence of its turns' digests; pairs (node, node below it) come from conversations that have both.
_OP13 = f"""
WITH crc AS (SELECT list(v ORDER BY i) AS t FROM ({_CRC_TABLE})),
o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) - 1 AS p, k, n FROM
  (SELECT conv_id, turn, left(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS k, octet_length(encode(coalesce(text, ''))) AS n FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT c, c - c % 5 AS b, {sql_crc32('c')} % 9 AS h FROM (SELECT DISTINCT c FROM o), crc),
r AS (SELECT c.c, o.p, o.k, o.n FROM c JOIN o ON o.c = c.b AND o.p < c.h UNION ALL SELECT c.c, o.p, o.k, o.n FROM c JOIN o ON o.c = c.c AND o.p >= c.h),
s AS (SELECT c, row_number() OVER w AS d, string_agg(k, '') OVER w AS x, n FROM r WINDOW w AS (PARTITION BY c ORDER BY p ROWS UNBOUNDED PRECEDING)),
a AS (SELECT c, d, x, n FROM s UNION ALL SELECT c, 0, '', 0 FROM c),
g AS (SELECT x, any_value(d) AS d, any_value(n) AS n, count(*) AS m, min(c) AS first, any_value(CASE WHEN d > 0 THEN left(x, -32) END) AS up FROM a GROUP BY x),
kids AS (SELECT up AS x, count(*) AS kids FROM g WHERE up IS NOT NULL GROUP BY up),
pairs AS (SELECT DISTINCT a.x, z.x AS y FROM a JOIN a z ON a.c = z.c AND z.d >= a.d),
below AS (SELECT pairs.x, count(*) FILTER (WHERE kids.x IS NULL) AS leaves, sum((g.m - 1) * g.n) AS saved FROM pairs JOIN g ON g.x = pairs.y LEFT JOIN kids ON kids.x = pairs.y GROUP BY pairs.x),
lasts AS (SELECT c, max(d) AS d FROM a GROUP BY c),
ends AS (SELECT x, string_agg(a.c::VARCHAR, ',' ORDER BY a.c) AS ids FROM a JOIN lasts l ON a.c = l.c AND a.d = l.d GROUP BY x)
SELECT g.first::BIGINT AS conv_id, g.d::BIGINT AS depth, u.first::BIGINT AS parent_conv_id, g.m::BIGINT AS n_convs, coalesce(kids, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves,
  saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM g LEFT JOIN g u ON u.x = g.up LEFT JOIN kids ON kids.x = g.x JOIN below ON below.x = g.x LEFT JOIN ends ON ends.x = g.x
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": _OP3, "op4_warc": _OP4, "op7_line_dedup": _OP7, "op10_embedding_dedup": _OP10, "op13_prefix_trie": _OP13}
