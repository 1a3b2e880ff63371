"""The training-corpus pipeline: quality rules, near-duplicate removal, substring dedup, mixing, and
SentencePiece encoding. Every stage takes (spark, docs, sf_dir); all but the last return the columns of
``documents``. ``run`` writes each stage's result as Parquet in the cluster's shared folder and reads it
back as the next stage's input.

Stages
1. quality rules: documents that the base rules or the learned cutoffs reject go.
2. near duplicates: of each component of 5-word-shingle links (Jaccard >= 0.75) the document with the
   smallest id stays. Rows without words link with nothing and stay; rows with a null id stay.
3. substring dedup: words in a 13-word window that also starts in a document with a smaller id are cut;
   ``n_chars`` follows the text.
4. mixing: a document row appears as often as the mix takes it.
5. encoding: (doc_id, ids, n_tokens, ids_crc32, lossless) of every row.

Cases common to all stages: null texts, null ids, repeated rows, empty tables and further columns are
handled as the operators' docstrings say; columns are passed on by name, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strata.llm import jaccard_join, mixing, quality, sampled_pieces, substring_dedup
from strata.llm.common import staged, table
from strata.session import ship_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows go if their component holds a smaller id, or an equal row came first. Only ids are joined
    back: the narrow list of ids that go, against the documents."""
    ship_package(spark)
    return jaccard_join.keep_first(docs)


def substring_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return substring_dedup.remove_repeats(docs, length="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return sampled_pieces.encode_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_repeats", substring_repeats),
    ("mix_sources", mix_sources),
    ("encode_pieces", encode_pieces),
]

#: The component search and the encoder have no SQL form; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
