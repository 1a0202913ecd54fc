"""Readers: JSON lines (lenient), Parquet, specs, question-answer texts and nested leaves."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..operators.conversations import END, START

FIELDS = "content string, text string, instruction string, output string, url string, source string, id string, _corrupt string"


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """content, url, source, bad of every line that is not blank (SRC1, SRC4, SRC7, D2).

    content, else text, else the instruction and output as a chat. A malformed line is kept with bad true and no
    content. Lines end at a line feed only, whatever other separators a text holds. source is the file's name up to
    its first full stop where a row names none.
    """
    t = spark.read.schema(FIELDS).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("lineSep", "\n").json(path)
    has = lambda c: F.when(F.col(c) != "", F.col(c))
    chat = F.when(F.col("instruction").isNotNull(), F.concat(F.lit(f"{START}user\n"), "instruction", F.lit(f"{END}\n{START}assistant\n"), F.coalesce("output", F.lit("")), F.lit(END)))
    stem = F.regexp_extract(F.input_file_name(), r"([^/.]+)[^/]*$", 1)
    return t.select(F.coalesce(has("content"), has("text"), chat).alias("content"), "url", F.coalesce("source", stem).alias("source"), F.col("_corrupt").isNotNull().alias("bad"))


def parquet(spark: SparkSession, path: str, text: str = "text", url: str | None = "url") -> DataFrame:
    """content, url, source of the named columns only; null texts are empty (SRC2)."""
    t = spark.read.parquet(path)
    at = F.col(url) if url and url in t.columns else F.lit(None).cast("string")
    return t.select(F.coalesce(text, F.lit("")).alias("content"), at.alias("url"), F.regexp_extract(F.input_file_name(), r"([^/.]+)[^/]*$", 1).alias("source"))


def from_spec(spark: SparkSession, spec: str) -> DataFrame:
    """A reader by its spec: parquet:PATH or jsonl:PATH (SRC4)."""
    kind, _, path = spec.partition(":")
    if kind == "parquet":
        return parquet(spark, path)
    if kind == "jsonl":
        return jsonl(spark, path).select("content", "url", "source")
    raise ValueError(f"no reader for {kind!r}; parquet:PATH or jsonl:PATH")


def accounted(rows: DataFrame) -> DataFrame:
    """One row: input_rows, bad_rows, empty_rows (SRC7)."""
    return rows.agg(F.count("*").alias("input_rows"), F.count_if("bad").alias("bad_rows"), F.count_if(~F.col("bad") & (F.coalesce("content", F.lit("")) == "")).alias("empty_rows"))


def torn_tail(spark: SparkSession, path: str, key: str) -> DataFrame:
    """file, id of every readable line, and torn: the file's last line is cut off (SRC6). A broken line elsewhere is an error.

    A line's place in its file is the place of the split that holds it, then its order within the split.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    t = spark.read.text(path, lineSep="\n", wholetext=False).select("value", F.col("_metadata.file_path").alias("file"), place.alias("place")).where(F.trim("value") != "")
    t = t.select("file", "place", F.get_json_object("value", f"$.{key}").alias("id"), F.try_parse_json("value").isNotNull().alias("ok"))
    last = t.groupBy("file").agg(F.max("place").alias("last"))
    if not t.where("not ok").join(last, "file").where("place <> last").isEmpty():
        raise ValueError("a broken line that is not the last")
    return t.select("file", F.when(F.col("ok"), F.col("id")).alias("id"), (~F.col("ok")).alias("torn"))


def mapped(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """A source's columns under common names, each an expression (SRC12)."""
    return df.select(*(F.expr(e).alias(c) for c, e in columns.items()))


def question_answer(text: Column) -> Column:
    """Struct question, answer of a text with marks for both; nulls where a mark is missing (SRC13)."""
    q = F.regexp_extract(text, r"(?s)(?:问|Q|Question|User)\s*[：:]\s*(.*?)\n\s*(?:答|A|Answer|Assistant)\s*[：:]", 1)
    a = F.regexp_extract(text, r"(?s)\n\s*(?:答|A|Answer|Assistant)\s*[：:]\s*(.*)$", 1)
    return F.struct(F.when(q != "", F.trim(q)).alias("question"), F.when(a != "", F.trim(a)).alias("answer"))


_LEAF = ArrayType(StructType([StructField("kind", StringType()), StructField("key", StringType()), StructField("value", StringType())]))


def walk(value, key: str = "") -> Iterator[tuple[str, str, str]]:
    """(kind, key, text) of every string in nested data; kind by the key's name (SRC11)."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from walk(v, k)
    elif isinstance(value, list):
        for v in value:
            yield from walk(v, key)
    elif isinstance(value, str) and value:
        low = key.lower()
        kind = "question" if low in ("question", "prompt", "problem", "instruction", "query") else "answer" if low in ("answer", "output", "solution", "canonical_solution", "target", "response") else "other"
        yield kind, key, value


@F.pandas_udf(_LEAF)
def leaves(text: pd.Series) -> pd.Series:
    """walk() over each JSON text; a text that is no JSON has no leaves."""

    def one(t):
        try:
            return [{"kind": a, "key": b, "value": c} for a, b, c in walk(json.loads(t))] if t else []
        except ValueError:
            return []

    return text.map(one)
