"""From raw documents to packed training sequences, a stage at a time.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from incidara.llm import exact_dedup, language, near_copies, packing, quality
from incidara.llm.queries import vocabulary
from incidara.llm.support import read_table, settle, shared_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go, and documents that fail the rules or are depleted; null and empty texts fail."""
    return quality.clean(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no known language go: those without a letter and those far from every profile.  The others keep their ``lang``."""
    profiles = language.learn(docs.filter(~language.held_out()))
    return language.known_only(docs, profiles)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays; null counts as empty."""
    return exact_dedup.drop_copies(docs, keep="smallest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts whose five-word shingles agree to 0.8 the smallest id of each group stays."""
    return near_copies.drop_near_copies(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 4096 tokens."""
    return packing.pack(settle(packing.cut(docs, vocabulary("word_bpe_49k.json"), end_id=1)))


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("exact dedup", exact_dedup_stage),
    ("SimHash near-dedup", near_dedup),
    ("best-fit packing", pack_sequences),
]

#: Language profiles, fingerprints and packing are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``; each stage's are written to the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, name.replace(" ", "-").lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
