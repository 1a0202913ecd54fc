"""Ranks and running totals within groups that may be very large."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[Column], value: str | None = None) -> DataFrame:
    """df with rank (1..), group_rows, and, given a value column, before (the sum over earlier rows of the group).

    Rows are range-partitioned on group and order and written with their partition's number; counts and sums per group
    and partition (a small table) give each partition's start, so a group that holds most rows is numbered by many
    tasks. The order must be total for the result to be determined. Null values add nothing.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g) for g in group]
    rows = materialize(df.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    total = F.sum(F.coalesce(value, F.lit(0))) if value else F.lit(0)
    per = rows.groupBy(*group, "_part").agg(F.count("*").alias("_m"), total.alias("_v") if value else F.max(F.lit(0)).alias("_v"))
    w = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    starts = per.select(
        *(F.col(g).alias(f"_{g}") for g in group), F.col("_part").alias("_p"), F.coalesce(F.sum("_m").over(w), F.lit(0)).alias("_m0"), F.coalesce(F.sum("_v").over(w), F.lit(0)).alias("_v0"),
        F.sum("_m").over(whole).alias("group_rows"),
    )
    same = F.col("_part") == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    inner = Window.partitionBy(*group, "_part").orderBy(*order)
    out = rows.join(starts, same).withColumn("rank", F.col("_m0") + F.row_number().over(inner))
    names = [*df.columns, "rank", "group_rows"]
    if value:
        here = F.coalesce(F.sum(F.coalesce(value, F.lit(0))).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        out = out.withColumn("before", F.col("_v0") + here)
        names.append("before")
    return out.select(*names)


def stars(df: DataFrame, bucket: str, member: str) -> DataFrame:
    """hub, member: the members of every bucket tied to the least one, whatever the bucket's size; distinct.

    Rows are range-partitioned on bucket and member, so a bucket that holds a third of all rows lies in many
    partitions. Each ties its part to the part's own least member in one pass over sorted rows; the parts' least
    members (two a partition at most) are then tied to each other. Null buckets and members tie nothing.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = {c: df.schema[c].dataType.simpleString() for c in (bucket, member)}
    rows = df.select(F.col(bucket).alias("b"), F.col(member).alias("m")).where("b is not null and m is not null").repartitionByRange(n, "b", "m").sortWithinPartitions("b", "m")
    out = materialize(rows.mapInArrow(_tie, f"b {kinds[bucket]}, hub {kinds[member]}, m {kinds[member]}"), "stars")
    heads = out.where("b is not null").groupBy("b").agg(F.min("hub").alias("top"), F.collect_set("hub").alias("hubs")).where("size(hubs) > 1")
    across = heads.select(F.col("top").alias("hub"), F.explode("hubs").alias("member")).where("hub <> member")
    return out.where("b is null").select("hub", F.col("m").alias("member")).unionByName(across).distinct()


def _tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(null, hub, m) of every tie; (b, hub, null) of the first and the last bucket of the partition."""
    last = None  # the bucket at hand and its hub
    kinds = None

    def batch(b, hub, m):
        return pa.RecordBatch.from_arrays([pa.array(b, kinds[0]), pa.array(hub, kinds[1]), pa.array(m, kinds[1])], ["b", "hub", "m"])

    for rows in batches:
        if not rows.num_rows:
            continue
        kinds = (rows.schema.field(0).type, rows.schema.field(1).type)
        b, m = (rows.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        new = np.ones(len(b), dtype=bool)
        new[1:] = b[1:] != b[:-1]
        at = np.flatnonzero(new)
        hubs = m[at].copy()
        if last is None:
            yield batch([b[0]], [m[0]], [None])
        elif last[0] == b[0]:
            hubs[0] = last[1]
        hub = np.repeat(hubs, np.diff(np.append(at, len(b))))
        tied = hub != m
        if tied.any():
            k = int(tied.sum())
            yield pa.RecordBatch.from_arrays([pa.nulls(k, kinds[0]), pa.array(hub[tied], kinds[1]), pa.array(m[tied], kinds[1])], ["b", "hub", "m"])
        last = (b[-1], hub[-1])
    if last is not None:
        yield batch([last[0]], [last[1]], [None])
