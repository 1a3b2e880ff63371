"""One query per operator over its whole table, and the DuckDB twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import ann, conversations, jaccard_join, langid, license_scan, mixing, quality, quality_model, sampled_pieces, substring_dedup, token_files, url_rules, whitening
from .common import table
from .oracle import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.new_path(spark)
    token_files.write_tokens(table(spark, sf_dir, "documents"), path)
    return token_files.read_documents(spark, path)


@query
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_rules.judge(table(spark, sf_dir, "pages"), labels)


@query
def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality_model.staged_statistics(table(spark, sf_dir, "documents"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(langid.fold(F.col("doc_id"), 5) != 0)
    scored = quality_model.score(stats, quality_model.train(stats, labels))
    return scored.select("doc_id", (langid.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op7_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled_pieces.encode_documents(table(spark, sf_dir, "documents"))


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid.fold(F.col("doc_id"), 4) == 2
    dictionaries = langid.learn(docs.filter(~held_out), "doc_id", "text", "lang")
    return langid.predict(docs, dictionaries).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


@query
def op2_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.measure_repeats(table(spark, sf_dir, "documents"))


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))


@query
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.labelled(license_scan.scan(table(spark, sf_dir, "documents")))


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
