"""A corpus pipeline of five stages: toxic documents go, repeated lines go, one document of each near-duplicate group stays,
contaminated documents go, and what is left is encoded.

Each stage works on all that its predecessor kept. A document whose text becomes empty stays; a null text stays null. Empty
documents are near duplicates of each other, so one of them stays.
"""

from __future__ import annotations

from corpusmill.llm import decontamination, line_dedup, sentencepiece_codec, simhash, toxicity
from corpusmill.llm.common import written
from corpusmill.llm.queries import tokenizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go. Null and empty texts stay, repeated rows fare alike; without labels the prior
    weights and an empty lexicon let all stay."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.remove_toxic(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds too go; n_chars, where documents have it, follows. A null text stays null, repeated
    ids lose no lines to each other, an empty table stays empty."""
    kept = line_dedup.dedup_lines(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near fingerprints, that with the smallest id stays. Null and empty texts are near each other;
    rows that repeat the smallest id all stay, and so do rows without an id."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words in benchmark windows go. Null and empty texts stay; repeated rows fare alike."""
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and digests of them and of the decoded text; a null text has no ids and decodes to ''."""
    model = tokenizer("piece_bpe_32k.model")
    tokens = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, model), model)
    return tokens.select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece", encode),
]

#: The first stage's model is learned from labels by Newton's method, which SQL can't express; tests hold each stage against
#: a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0].lower()}")
    return docs
