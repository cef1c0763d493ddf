"""Corpus pipeline: language ID, near duplicates, secrets, mixing, packing.

Each stage works on all rows that the one before kept and returns the columns of documents, but the last, which
returns packed pieces. Language ID drops documents without a language; of each group of near duplicates the
document with the smallest doc_id stays; secrets are replaced by a mark; the mix repeats or shortens documents to
meet its sources' targets; packing lays the mix out in sequences.

Defined cases: rows that agree in doc_id and text are one document to the join; rows of one doc_id with other texts
are documents each for itself, and null ids are last. Null and empty texts go with the first stage. Ties fall to the
smallest doc_id, then a hash of the text. Texts count whole. Extra columns of documents are left out, whatever their
names; empty tables give empty tables.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.llm import lang_id, mixing, ngram_join, packing, secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a learned language is found; text without any letter goes. Where nothing can be learned, a letter suffices."""
    profiles = lang_id.learn(lang_id.training_rows(docs)) or {"any": np.zeros(1, np.uint64)}
    return lang_id.identify(docs.select(*COLUMNS), profiles).filter(F.col("lang_pred") != lang_id.UND).select(*COLUMNS)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest doc_id (null last); rows without words stay."""
    return ngram_join.survivors(docs.select(*COLUMNS))


def cleaned(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in them replaced by a mark."""
    return secrets.redact(docs.select(*COLUMNS), secrets.scan(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' words that the mix takes, a row for each pass over a source."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in sequences: a row for each piece."""
    import public_tokenizers

    return packing.pack(packing.piece_rows(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("language ID", identified), ("n-gram Jaccard join", deduplicated), ("secret scans", cleaned), ("mixing sources", mixed), ("best-fit packing", packed)]
#: None of the stages' tokens, profiles and draws can be said in SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the rows are written and read again."""
    from quillet.llm.common import stage

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, step) in enumerate(STAGES, 1):
        docs = step(spark, docs, sf_dir)
        if place < len(STAGES):
            docs = stage(docs, f"stage{place}")
    return docs
