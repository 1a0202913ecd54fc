"""Problem 4: a score cutoff per source that keeps a target fraction of its records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import clean_key


def instant(name: str) -> Column:
    """A written time as an instant; without a zone it is UTC, whatever the session's zone. Unreadable times are null."""
    t = F.upper(F.trim(F.col(name)))
    t = F.regexp_replace(t, r"\s*(UTC|GMT)$", "Z")
    t = F.regexp_replace(t, r"([+-]\d\d)(\d\d)$", "$1:$2")
    t = F.regexp_replace(t, r"^(\d{4})/(\d\d)/(\d\d)", "$1-$2-$3")
    zoned = F.when(t.rlike(r"(Z|[+-]\d\d:\d\d)$"), t).otherwise(F.concat(t, F.lit("Z")))
    digits = F.col(name).rlike(r"^\d{10}$|^\d{13}$")
    epoch = F.when(F.length(name) == 13, F.expr(f"try_cast(`{name}` as double)") / 1000).otherwise(F.expr(f"try_cast(`{name}` as double)"))
    return F.when(digits, F.timestamp_seconds(epoch)).otherwise(zoned.try_cast("timestamp"))


def deciding_scores(ledger: DataFrame, targets: DataFrame) -> DataFrame:
    """The one score per quota row and document that decides: domain, scorer_name, scorer_version, quota, doc_id, score.

    Of a document's finite scores under the quota's scorer and version the one with the latest time counts, then the
    higher score. Rows without domain, doc_id or score, and NaN or infinite scores, decide nothing. A quota of null
    keeps nothing; quota rows are taken once each.
    """
    finite = ledger.where("score is not null and not isnan(score) and abs(score) <> double('infinity') and doc_id is not null").select(
        clean_key("domain").alias("key"), "scorer_name", "scorer_version", "doc_id", (F.col("score") + F.lit(0.0)).alias("score"), instant("ts").alias("at")
    )
    want = targets.select("domain", "scorer_name", "scorer_version", "quota").distinct().withColumn("key", clean_key("domain"))
    group = ["domain", "scorer_name", "scorer_version", "quota"]
    return (
        finite.join(want, ["key", "scorer_name", "scorer_version"])
        .groupBy(*group, "doc_id")
        .agg(F.max(F.struct("at", "score"))["score"].alias("score"))
    )


class Cutoffs:
    """Exact cut per group by range sort, partition counts and prefix sums.

    Rows are range-partitioned on (group, score descending, doc_id ascending) and written with the partition's number.
    Counts per group and partition, a table of at most groups + partitions rows, are summed from the front; that
    finds the partition in which a group's k-th row lies. Earlier partitions are kept whole, later ones dropped, and
    only the rows of that one are numbered. Ties at the cutoff go by doc_id, so exactly k = ceil(quota * n - 1e-9)
    documents are kept however often a score repeats.
    """

    group = ("domain", "scorer_name", "scorer_version", "quota")

    def __init__(self, scores: DataFrame, partitions: int | None = None):
        spark = scores.sparkSession
        n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        order = [F.col(c) for c in self.group] + [F.col("score").desc(), F.col("doc_id")]
        ranged = scores.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id())
        self.rows = materialize(ranged, "cutoff")
        counts = self.rows.groupBy(*self.group, "part").agg(F.count("*").alias("m"))
        w = Window.partitionBy(*self.group)
        before = F.coalesce(F.sum("m").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sized = counts.select(*self.group, "part", "m", before.alias("before"), F.sum("m").over(w).alias("n"))
        k = F.coalesce(F.greatest(F.lit(0), F.least(F.col("n"), F.ceil(F.col("quota") * F.col("n") - 1e-9))), F.lit(0)).cast("long")
        sized = sized.withColumn("k", k)
        #: per group: the partition of the k-th row, and the rows of the group before it
        self.edge = sized.where("before < k and k <= before + m").select(*self.group, F.col("part").alias("edge"), "before", "n", "k")
        self.sizes = sized.groupBy(*self.group).agg(F.max("n").alias("n"), F.max("k").alias("k"))

    def kept(self) -> DataFrame:
        """The kept rows, with their score."""
        joined = self.rows.join(self.edge, list(self.group))
        whole = joined.where("part < edge").select(*self.group, "doc_id", "score")
        w = Window.partitionBy(*self.group).orderBy(F.col("score").desc(), "doc_id")
        at_edge = joined.where("part = edge").withColumn("r", F.row_number().over(w)).where("r <= k - before").select(*self.group, "doc_id", "score")
        return whole.unionByName(at_edge)

    def report(self) -> DataFrame:
        """Per group: documents n, kept k and the cutoff, the score of the k-th document (null if none is kept)."""
        kept = self.kept().groupBy(*self.group).agg(F.min("score").alias("cutoff"), F.count("*").alias("kept"))
        return self.sizes.join(kept, list(self.group), "left").select(*self.group, "n", F.coalesce("kept", F.lit(0)).alias("kept"), "cutoff")
