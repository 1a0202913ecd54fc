"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", most_rounds: int = 60) -> DataFrame:
    """node, component (the least node of the component) for every node of an edge.

    Each round hangs every node's larger neighbours on its least neighbour, then its smaller ones; the number of
    rounds grows with the logarithm of a component's size. Every round is written to the shared folder, so neither
    the plan grows nor is a round lost with an executor; the round before is removed then. Minima are combined map-side and joined back, so a node with
    very many neighbours is no single task's group. Null ends and self-loops link nothing.
    """
    a, b = F.col(u), F.col(v)
    now = materialize(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = _mark(now)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        next_ = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        done, now = now, None
        now = materialize(next_, "edges")
        discard(done)
        after = _mark(now)
        if after == before:
            stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = after
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")


def _mark(edges: DataFrame) -> tuple:
    """Number and order-free checksum of the edges."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]
