"""Exact deduplication and set operations over keyed tables.

Order is explicit: the least `order` value of a key comes first. Rows with a null key are never duplicates of
anything and are kept. Hot keys are folded map-side (min / count) before anything is shuffled, and winners are found
by aggregation and join, not by collecting a key's rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def first_rows(df: DataFrame, key: Column | str, order: Sequence[str]) -> DataFrame:
    """The first row of every key by `order` (X1-X3, X13, X15, X18). Ties in all of `order` keep every tied row, and rows without a key stay.

    Firsts are folded map-side and joined back on key and order together, so the rows of a key that most rows share are
    spread by their order.
    """
    k = F.col(key) if isinstance(key, str) else key
    t = df.withColumn("_key", k).withColumn("_at", F.struct(*order))
    least = t.where("_key is not null").groupBy("_key").agg(F.min("_at").alias("_at")).withColumn("_hit", F.lit(True))
    return t.join(least, ["_key", "_at"], "left").where("_key is null or _hit").select(*df.columns)


def duplicate_records(df: DataFrame, text: str, source: str, order: str) -> DataFrame:
    """One row per later occurrence: key, order, source, dup_of, the source of the first.

    Texts without letters or numbers have no identity: neither first nor duplicate.
    """
    t = df.where(T.squash(text) != "").select(T.exact_key(text).alias("key"), F.col(order).alias("ord"), F.col(source).alias("source"))
    first = t.groupBy("key").agg(F.min(F.struct("ord", "source")).alias("f"), F.count("*").alias("n")).where("n > 1")
    return t.join(first, "key").where(F.col("ord") > F.col("f.ord")).select("key", "ord", "source", F.col("f.source").alias("dup_of"))


def without_keys(df: DataFrame, key: Column, excluded: DataFrame, excluded_key: Column) -> DataFrame:
    """Rows whose key is not among the excluded rows' (X5, X7, X8, H21)."""
    out = excluded.select(excluded_key.alias("_key")).where("_key is not null").distinct()
    return df.withColumn("_key", key).join(out, "_key", "left_anti").select(*df.columns)


def overlaps(df: DataFrame, key: Column, group: str) -> DataFrame:
    """Pairs of groups that share keys: a, b, shared, share_a, share_b.

    Per key the distinct groups are listed (there are few groups), and pairs are counted from these lists.
    """
    sets = df.where(key.isNotNull() & F.col(group).isNotNull()).select(key.alias("key"), F.col(group).alias("g")).distinct()
    sizes = sets.groupBy("g").agg(F.count("*").alias("n"))
    lists = sets.groupBy("key").agg(F.collect_set("g").alias("gs")).where("size(gs) > 1").groupBy(F.sort_array("gs").alias("gs")).agg(F.count("*").alias("m"))
    pairs = lists.select(F.explode("gs").alias("a"), "gs", "m").select("a", F.explode("gs").alias("b"), "m").where("a < b").groupBy("a", "b").agg(F.sum("m").alias("shared"))
    return (
        pairs.join(sizes.withColumnsRenamed({"g": "a", "n": "na"}), "a").join(sizes.withColumnsRenamed({"g": "b", "n": "nb"}), "b")
        .select("a", "b", "shared", F.round(F.col("shared") / F.col("na"), 6).alias("share_a"), F.round(F.col("shared") / F.col("nb"), 6).alias("share_b"))
    )


def best_rows(df: DataFrame, key: Sequence[str], best: Sequence[Column]) -> DataFrame:
    """One row per key, the greatest by `best` (X10, X17): the winner carries the whole row, so ties are one row."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*df.columns), F.struct(*(b.alias(f"_{i}") for i, b in enumerate(best)))).alias("r")).select("r.*")


def two_level(df: DataFrame, full: Column, part: Column, order: str) -> DataFrame:
    """First row per full key, then of these the first per partial key (X12), each decided over all rows."""
    one = first_rows(df, full, [order])
    return first_rows(one, part, [order])


def in_many(df: DataFrame, key: str, container: str) -> DataFrame:
    """Keys that occur in more than one container: key, n."""
    return df.groupBy(key).agg(F.count_distinct(container).alias("n")).where("n > 1")


def compare_tables(a: DataFrame, b: DataFrame, key: str, fingerprint: Column) -> DataFrame:
    """Per key: same, changed, missing (only in a) or extra (only in b) (X19, X22, MAN). Keys must be unique."""
    x = a.select(F.col(key).alias("key"), fingerprint.alias("fa"))
    y = b.select(F.col(key).alias("key"), fingerprint.alias("fb"))
    state = F.when(F.col("fb").isNull(), "missing").when(F.col("fa").isNull(), "extra").when(F.col("fa") == F.col("fb"), "same").otherwise("changed")
    return x.join(y, "key", "full_outer").select("key", state.alias("state"))


def fingerprint(*columns: str) -> Column:
    """A key of several columns, nulls told apart from empty strings."""
    return F.sha2(F.concat_ws("\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in columns)), 256)


def pair_presence(pairs: DataFrame, a: str, b: str, kept: DataFrame, key: str, group: Column) -> DataFrame:
    """Per group of pairs: how many have both ends kept, one, or neither."""
    k = kept.select(F.col(key).alias("_k")).distinct()
    ka, kb = k.select(F.col("_k").alias("_a"), F.lit(1).alias("ia")), k.select(F.col("_k").alias("_b"), F.lit(1).alias("ib"))
    t = pairs.withColumn("g", group).join(ka, F.col(a) == F.col("_a"), "left").join(kb, F.col(b) == F.col("_b"), "left")
    n = F.coalesce("ia", F.lit(0)) + F.coalesce("ib", F.lit(0))
    return t.groupBy("g").agg(F.count_if(n == 2).alias("both"), F.count_if(n == 1).alias("one"), F.count_if(n == 0).alias("neither"))


def ledger_union(ours: DataFrame, theirs: DataFrame, key: str, values: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Union by key, ours first, nulls filled from theirs; and the conflicts: key, column, ours, theirs."""
    a, b = ours.select(key, *values), theirs.select(key, *(F.col(v).alias(f"_{v}") for v in values))
    both = a.join(b, key, "full_outer")
    merged = both.select(key, *(F.coalesce(v, f"_{v}").alias(v) for v in values))
    parts = [both.where(F.col(v).isNotNull() & F.col(f"_{v}").isNotNull() & (F.col(v) != F.col(f"_{v}"))).select(key, F.lit(v).alias("column"), F.col(v).cast("string").alias("ours"), F.col(f"_{v}").cast("string").alias("theirs")) for v in values]
    return merged, reduce(lambda x, y: x.unionByName(y), parts)
