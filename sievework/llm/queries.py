"""The pN_ queries of this package, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load
from . import budget, cutoff, handwritten, languages, leaks, mixing, neardup, packing
from .sql import SQL


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.NearDuplicates(load(spark, d, "l2_dataset")).document_pairs()


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.NearDuplicates(load(spark, d, "l2_dataset")).groups()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_files(spark, d).select("doc_id")


def p2_files(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(load(spark, d, "l2_dataset"), load(spark, d, "chunk_pool"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    supply = budget.domain_supply(load(spark, d, "l2_dataset"), load(spark, d, "tokenizer_vocab"), load(spark, d, "mix_15b_stage1"))
    return supply.where("short").select("domain")


def p3_supply(spark: SparkSession, d: str) -> DataFrame:
    return budget.domain_supply(load(spark, d, "l2_dataset"), load(spark, d, "tokenizer_vocab"), load(spark, d, "mix_15b_stage1"))


def p3_cube(spark: SparkSession, d: str) -> DataFrame:
    return budget.token_cube(load(spark, d, "l2_dataset"), load(spark, d, "chunk_pool"), load(spark, d, "score_ledger"), load(spark, d, "tokenizer_vocab"))


def _cutoffs(spark: SparkSession, d: str) -> cutoff.Cutoffs:
    return cutoff.Cutoffs(cutoff.deciding_scores(load(spark, d, "score_ledger"), load(spark, d, "quota_targets")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _cutoffs(spark, d).kept().select("domain", "doc_id").distinct()


def p4_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    return _cutoffs(spark, d).report().select("domain", "scorer_name", "scorer_version", "n", "kept", "cutoff")


def p5_rows(spark: SparkSession, d: str) -> DataFrame:
    return packing.training_rows(load(spark, d, "l2_dataset"), load(spark, d, "tokenizer_vocab"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.split_by_packing(p5_rows(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    found = leaks.leaks(load(spark, d, "documents"), load(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("n_documents"))


def _mix(spark: SparkSession, d: str) -> mixing.Mix:
    return mixing.Mix(load(spark, d, "documents"), load(spark, d, "mix_sources"), load(spark, d, "tokenizer_vocab"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).shares().where("short").select("source")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).shares()


def p7_rows(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).selection()


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_documents(spark, d).where("not as_labelled").select("doc_id", "lang")


def p8_documents(spark: SparkSession, d: str) -> DataFrame:
    return languages.document_languages(load(spark, d, "documents"))


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    return languages.passage_languages(load(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
