"""Problem 3: token budget per source, language and domain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import base_language, clean_key
from .tokenizer import token_counter


def record_tokens(records: DataFrame, vocab: DataFrame) -> DataFrame:
    """Exact tokens per distinct (domain, doc_id, chunk_idx), the domain trimmed and lower-cased.

    Texts are counted where they are read; only keys and counts are shuffled. A record delivered twice counts once
    per domain (should its texts differ, the longer one counts). A null or empty text has 0 tokens.
    """
    n = token_counter(vocab)
    return (
        records.select(clean_key("domain").alias("domain"), "doc_id", "chunk_idx", n("text").alias("n_tokens"))
        .groupBy("domain", "doc_id", "chunk_idx")
        .agg(F.max("n_tokens").alias("n_tokens"))
    )


def mix_entries(mix: DataFrame) -> DataFrame:
    """One row per domain of a mix file. A null epochs counts as 1; a null tokens asks for nothing."""
    entry = F.col("entry")
    return (
        mix.select(F.explode("domains").alias("domain", "entry"))
        .select("domain", F.coalesce(entry["epochs"], F.lit(1)).alias("epochs"), F.coalesce(entry["tokens"], F.lit(0)).cast("long").alias("asked"))
        .groupBy("domain")
        .agg(F.max("epochs").alias("epochs"), F.max("asked").alias("asked"))
    )


def domain_supply(records: DataFrame, vocab: DataFrame, mix: DataFrame) -> DataFrame:
    """Each domain of the mix with what it can supply: domain, n_records, supply, epochs, asked, short."""
    have = record_tokens(records, vocab).where("domain is not null").groupBy("domain").agg(F.sum("n_tokens").alias("supply"), F.count("*").alias("n_records"))
    plan = mix_entries(mix)
    return (
        plan.withColumn("key", clean_key("domain"))
        .join(have.withColumnRenamed("domain", "key"), "key", "left")
        .select(
            "domain", F.coalesce("n_records", F.lit(0)).alias("n_records"), F.coalesce("supply", F.lit(0)).alias("supply"), "epochs", "asked",
            (F.coalesce("supply", F.lit(0)) * F.col("epochs") < F.col("asked")).alias("short"),
        )
    )


def token_cube(records: DataFrame, pool: DataFrame, ledger: DataFrame, vocab: DataFrame) -> DataFrame:
    """Token totals over the cube of source, language and domain.

    source is that of the pool row of (doc_id, chunk_idx), lang the base language that most ledger rows of the
    document name (ties: the first by name), domain the record's own. What is missing counts as 'unknown'; a null in
    the result stands for all values. One record counts once per domain it is listed under.
    """
    tokens = record_tokens(records, vocab)
    sources = (
        pool.select(F.col("parent_doc_id").alias("doc_id"), "chunk_idx", "source")
        .where("doc_id is not null and source is not null").groupBy("doc_id", "chunk_idx").agg(F.min("source").alias("source"))
    )
    langs = (
        ledger.select("doc_id", base_language("lang").alias("lang")).where("doc_id is not null and lang <> ''")
        .groupBy("doc_id", "lang").agg(F.count("*").alias("n"))
        .groupBy("doc_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "lang"))["lang"].alias("lang"))
    )
    known = lambda c: F.coalesce(F.col(c), F.lit("unknown")).alias(c)
    cells = (
        tokens.join(sources, ["doc_id", "chunk_idx"], "left").join(langs, "doc_id", "left")
        .groupBy(known("source"), known("lang"), known("domain"))
        .agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_records"))
    )
    return cells.cube("source", "lang", "domain").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_records").alias("n_records"))
