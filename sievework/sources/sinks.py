"""Writers: sharded JSON lines, stamps, validated ledgers, asserted unions, packed rows, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ledger import violations
from ..operators.ordered import ranked


def jsonl_shards(df: DataFrame, path: str, rows: int = 50_000) -> None:
    """JSON lines of at most `rows` rows a file; the committer renames finished files into place (SNK1, SNK2)."""
    df.write.mode("errorifexists").option("maxRecordsPerFile", rows).json(path)


def stamp(df: DataFrame, domain: str, text: str, reasons: dict[str, int]) -> DataFrame:
    """One row of a build's closed set of statistics (D5, SNK3): tokens is null where none were counted, never 0."""
    r = F.map_from_arrays(F.array(*(F.lit(k) for k in sorted(reasons))), F.array(*(F.lit(reasons[k]).cast("long") for k in sorted(reasons)))) if reasons else F.create_map().cast("map<string,bigint>")
    return df.agg(F.count("*").alias("kept"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("kept_chars")).select(
        F.lit(domain).alias("domain"), "kept", "kept_chars", F.round(F.col("kept_chars") / 1.5).cast("long").alias("kept_tokens"), F.lit(None).cast("long").alias("tokens"), r.alias("reasons")
    )


def append_ledger(rows: DataFrame, path: str) -> int:
    """Append rows to a score ledger after every one has been found valid (SNK5, SNK8); their number."""
    bad = rows.withColumn("v", violations(rows)).where("v is not null").groupBy("v").agg(F.count("*").alias("n")).orderBy("v").collect()
    if bad:
        raise ValueError("invalid rows: " + ", ".join(f"{r['v']} {r['n']}" for r in bad))
    n = rows.count()
    rows.write.mode("append").parquet(path)
    return n


def union_all(parts: list[DataFrame], expect: int | None = None) -> DataFrame:
    """The parts by column name, refused if they don't have the expected number of rows (SNK7)."""
    out = reduce(lambda a, b: a.unionByName(b), parts)
    if expect is not None and (n := out.count()) != expect:
        raise ValueError(f"{n} rows, {expect} expected")
    return out


def packed(df: DataFrame, group: Sequence[str], order: Sequence[Column], ids: str, width: int) -> DataFrame:
    """group, row, ids: the token ids of each group, in order and end to end, as rows of `width`, the last one shorter (SNK9, D13).

    Places come from ordered.ranked, and a row is gathered from the pieces that fall into it, so no task holds a group.
    Null and empty ids fill nothing.
    """
    t = ranked(df.where(F.size(ids) > 0).withColumn("_n", F.size(ids)), group, order, "_n")
    row = F.explode(F.sequence(F.floor(F.col("before") / width), F.floor((F.col("before") + F.col("_n") - 1) / width)))
    t = t.select(*group, ids, "before", "_n", row.alias("row"))
    first = F.greatest(F.col("before"), F.col("row") * width)
    last = F.least(F.col("before") + F.col("_n"), (F.col("row") + 1) * width)
    piece = F.struct(first.alias("at"), F.slice(F.col(ids), (first - F.col("before") + 1).cast("int"), (last - first).cast("int")).alias("part"))
    return t.groupBy(*group, "row").agg(F.flatten(F.transform(F.sort_array(F.collect_list(piece)), lambda x: x["part"])).alias(ids))


def directory_fingerprint(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """files, bytes and a fingerprint of names and contents, times aside."""
    t = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    one = t.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sha"), "length")
    return one.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.substring(F.sha1(F.concat_ws("\n", F.sort_array(F.collect_list(F.concat_ws("\t", "name", "sha"))))), 1, 16).alias("fingerprint"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a tab-separated manifest: path, sha256, bytes, tier, producer."""
    return spark.read.option("sep", "\t").option("comment", "#").schema("path string, sha256 string, bytes long, tier string, producer string").csv(path)
