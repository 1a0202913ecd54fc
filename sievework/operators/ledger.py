"""Append-only ledgers, logs and detectors, read in batch. Their streaming twins are in streaming/."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold_events(events: DataFrame, key: Sequence[str], status: str, order: Column, writer: Column | None = None, unretracts: Column | None = None) -> DataFrame:
    """One row per key: the event that stands (L1).

    Precedence by kind, not position: a retraction stands unless a later event names what it un-retracts; else a
    person's close before a monitor's, a close before a running row; among equals the latest by `order`.
    """
    s = F.col(status)
    revives = F.coalesce(unretracts, F.lit(False)) if unretracts is not None else F.lit(False)
    machine = F.coalesce(writer == "monitor", F.lit(False)) if writer is not None else F.lit(False)
    t = events.withColumn("_order", order)
    last = t.groupBy(*key).agg(F.max(F.when(s == "retracted", F.col("_order"))).alias("_retracted"))
    t = t.join(last, list(key))
    rank = (
        F.when(revives & (F.col("_order") > F.col("_retracted")), 4)
        .when(s == "retracted", 3)
        .when(s.isin("ok", "fail") & ~machine, 2)
        .when(s.isin("ok", "fail"), 1)
        .otherwise(0)
    )
    best = F.max_by(F.struct(*events.columns), F.struct(rank.alias("r"), F.col("_order").alias("o")))
    return t.groupBy(*key).agg(best.alias("e")).select("e.*")


def repeated_lines(ledger: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that were appended more than once, with their count (L2)."""
    return ledger.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def changed_values(ledger: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Keys under which different values were recorded: key, n_values (L2)."""
    return ledger.where(F.col(value).isNotNull()).groupBy(*key).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def row_fingerprint(columns: Sequence[str]) -> Column:
    """sha256 of a row's named values in name order, nulls left out (L3)."""
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in sorted(columns)]
    return F.sha2(F.concat_ws("\n", *parts), 256)


def violations(ledger: DataFrame) -> Column:
    """What is wrong with a score-ledger row, the first of: key, ts, both, neither, nonfinite, grade, sha; else null (D7, SNK5, C7, C12)."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    s, dims = F.col("score"), F.col("rubric_dims")
    return (
        F.when(blank("doc_id") | blank("domain") | blank("scorer_name") | blank("scorer_version"), "key")
        .when(~F.coalesce(F.col("ts"), F.lit("")).rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?Z$"), "ts")
        .when(s.isNotNull() & dims.isNotNull(), "both")
        .when(s.isNull() & dims.isNull(), "neither")
        .when(F.isnan(s) | (F.abs(s) == float("inf")), "nonfinite")
        .when(dims.isNotNull() & F.exists(F.map_values(dims), lambda x: (x < 1) | (x > 5)), "grade")
        .when(F.col("src_sha").isNotNull() & ~F.col("src_sha").rlike("^[0-9a-f]{64}$"), "sha")
    )


def parse_log(lines: DataFrame, line: str, number: str, metrics: dict[str, str], step: str = r"step (\d+)") -> DataFrame:
    """metric, step, value: of every metric and step the last finite reading by line number (L4).

    metrics: name to a pattern whose group 1 is the value. Lines without a step or value are no readings.
    """
    at = F.regexp_extract(line, step, 1).try_cast("long")
    found = F.array(*(F.struct(F.lit(k).alias("metric"), F.regexp_extract(line, p, 1).try_cast("double").alias("value")) for k, p in metrics.items()))
    t = lines.select(F.col(number).alias("_n"), at.alias("step"), F.explode(found).alias("m")).select("_n", "step", "m.metric", "m.value")
    t = t.where(F.col("step").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    return t.groupBy("metric", "step").agg(F.max_by("value", "_n").alias("value"))


def latest_with_previous(series: DataFrame, group: Sequence[str], step: str, value: str) -> DataFrame:
    """group, step, value, previous, arrow of the latest reading."""
    w = Window.partitionBy(*group)
    t = series.withColumn("previous", F.lag(value).over(w.orderBy(step))).withColumn("_last", F.max(step).over(w)).where(F.col(step) == F.col("_last"))
    arrow = F.when(F.col("previous").isNull(), "new").when(F.col(value) > F.col("previous"), "up").when(F.col(value) < F.col("previous"), "down").otherwise("flat")
    return t.select(*group, step, value, "previous", arrow.alias("arrow"))


def divergence(series: DataFrame, group: Sequence[str], step: str, loss: str, gnorm: str, g_thresh: float = 10.0, g_consec: int = 3, window: int = 50, loss_thresh: float = 3.0) -> DataFrame:
    """The first trigger per run: group, step, reason (ST3).

    A step counts once, its first row (echoes are dropped). A non-finite reading triggers at once; so do g_consec
    steps in a row above g_thresh, and a mean above loss_thresh over a full window.
    """
    one = series.groupBy(*group, step).agg(F.min(F.struct("_n", loss, gnorm)).alias("r")).select(*group, step, F.col(f"r.{loss}").alias("l"), F.col(f"r.{gnorm}").alias("g"))
    w = Window.partitionBy(*group).orderBy(step)
    bad = F.isnan("l") | F.isnan("g") | (F.abs("l") == float("inf")) | (F.abs("g") == float("inf"))
    t = one.withColumn("bad", bad).withColumn("high", F.when(F.col("g") > g_thresh, 1).otherwise(0))
    t = t.withColumn("run", F.sum("high").over(w.rowsBetween(-(g_consec - 1), 0))).withColumn("seen", F.row_number().over(w)).withColumn("mean", F.avg("l").over(w.rowsBetween(-(window - 1), 0)))
    reason = F.when(F.col("bad"), "nonfinite").when(F.col("run") >= g_consec, "gnorm").when((F.col("seen") >= window) & (F.col("mean") > loss_thresh), "loss")
    return t.withColumn("reason", reason).where("reason is not null").groupBy(*group).agg(F.min(F.struct(step, "reason")).alias("f")).select(*group, f"f.{step}", "f.reason")


def steady_rate(series: DataFrame, group: Sequence[str], step: str, rate: str, val_every: int, tail: int = 40, spread: float = 0.15) -> DataFrame:
    """Median of the last `tail` rates at steps that no validation falls on; null, and steady false, if they spread too far (ST4)."""
    clean = series.where((F.col(step) == 0) | (F.col(step) % val_every != 0))
    w = Window.partitionBy(*group).orderBy(F.desc(step))
    t = clean.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= tail)
    g = t.groupBy(*group).agg(F.min(rate).alias("lo"), F.max(rate).alias("hi"), F.percentile(rate, F.lit(0.5)).alias("median"), F.count("*").alias("n"))
    ok = (F.col("hi") == 0) | ((F.col("hi") - F.col("lo")) / F.col("hi") <= spread)
    return g.select(*group, "n", ok.alias("steady"), F.when(ok, F.col("median")).alias("rate"))


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, value: str) -> DataFrame:
    """left with the right value of the latest `at` not after its own (2.12 as-of).

    The two are merged and the last value carried on, so the join costs one sort per key. Equal times match.
    """
    a = left.select("*", F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_side"))
    names = [c for c in left.columns if c not in (*by, at)]
    b = right.select(*by, at, *(F.lit(None).cast(left.schema[c].dataType).alias(c) for c in names), F.col(value).alias("_v"), F.lit(0).alias("_side"))
    w = Window.partitionBy(*by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("as_of", F.last("_v", ignorenulls=True).over(w))
    return both.where("_side = 1").select(*left.columns, "as_of")


def daily(events: DataFrame, ts: str, aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates per UTC day."""
    return events.groupBy(F.to_date(ts).alias("day")).agg(*aggregates)
