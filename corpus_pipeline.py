"""Corpus pipeline: language ID, line dedup, near-dedup, decontamination and tokenisation.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a
DataFrame; all but the last return the columns of documents. A stage's result is written to the
shared folder before the next one starts, so a lost executor never costs more than a stage.

No stage can be said in SQL as a whole (a trained model, SimHash groups, alignment, merges), so
the tests hold each against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from endpointlens.llm import language_id, line_dedup, qgram_filter, sentencepiece_lattice, simhash_vptree
from endpointlens.llm.common import ready, store, table
from endpointlens.session import prepare

ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language ID rejects; learns from those that are not held out."""
    ready(prepare(spark))
    model = language_id.learn(docs.where(~language_id.held_out()))
    return language_id.keep_known(docs, model)


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one occurrence of every line; `n_chars` follows the text that is left."""
    ready(prepare(spark))
    return line_dedup.without_repeated_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def unlike_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every group of near duplicates."""
    ready(prepare(spark))
    return simhash_vptree.one_of_each(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    ready(prepare(spark))
    return qgram_filter.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token ids, and whether decoding gives the text back."""
    ready(prepare(spark))
    model = sentencepiece_lattice.load()
    both = sentencepiece_lattice.decode(sentencepiece_lattice.encode(docs, model), model)
    same = F.col("decoded").eqNullSafe(F.replace("text", F.lit(sentencepiece_lattice.SPACE), F.lit(" ")))
    return both.withColumn("round_trip", same).drop("decoded")


STAGES = [
    ("language_id", known_language),
    ("line_dedup", unrepeated_lines),
    ("near_dedup", unlike_documents),
    ("decontamination", uncontaminated),
    ("tokenisation", tokenised),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir))
    return docs
