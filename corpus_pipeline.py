"""From documents to token ids: five stages, each over all that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenegrain.llm import bitplanes, budget_mix, byte_cnn, fragment_jaccard, suffix_decontam
from scenegrain.llm.queries import TOKENIZER
from scenegrain.llm.rows import free_names
from scenegrain.sources.tables import shared_dir, table

#: Below this score a language counts as unknown.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no known language: null or letterless texts, and scores under LEAST_SCORE.

    Each row is judged by its whole text, however long; repeated rows stay together. Without labelled rows nothing is
    known, so all rows go; an empty table gives an empty one.
    """
    net = byte_cnn.learn(docs, byte_cnn.crc_fold(F.col("doc_id"), 5) != 0)
    (name,) = free_names(docs, "language")
    p = docs.withColumn(name, byte_cnn.language(net, F.col("text")))
    return p.where((F.col(f"{name}.lang") != "und") & (F.col(f"{name}.score") >= LEAST_SCORE)).select(*docs.columns)


def jaccard_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: the one with the smallest doc_id (null last), then by its text.

    Rows are judged by id and text: of repeated rows one stays, texts that share an id are judged each on its own. Rows
    without words (null, empty) all stay; an empty table gives an empty one.
    """
    return fragment_jaccard.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages by the contamination rule.

    Null and empty texts hold none and stay, repeated rows share their fate, very long texts are searched whole. An empty
    benchmark drops nothing; an empty table gives an empty one.
    """
    return suffix_decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix to target weights takes them, which may be never or up to three times.

    Null sources are one source. Rows without words (null, empty) come once for each whole round of their source. What is
    taken of repeated rows is dealt out among them. An empty table gives an empty one.
    """
    return budget_mix.mixed_rows(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the ids of what is left as byte planes; returns what the files hold of each document.

    Each row is a document of its own, repeated ones too; null ids come first. Null and empty texts have the end id alone.
    Very long texts are whole. An empty table gives empty files and no rows.
    """
    path = f"{shared_dir(spark)}/scenegrain/planes-{uuid.uuid4().hex}"
    # Small batches: the workers still hold what earlier stages loaded.
    bitplanes.write_planes(docs, path, TOKENIZER, batch_chars=2_000_000)
    return bitplanes.read_planes(spark, path)


STAGES = [
    ("language_id", language_id),
    ("jaccard_dedup", jaccard_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: A trained network decides in the first stage; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/scenegrain/pipeline-{uuid.uuid4().hex}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
