"""Structured Streaming twins: idempotent ingest and the divergence detector with state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import scratch


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream over the Parquet files of a folder, or over one file, with the schema found in them."""
    schema = spark.read.parquet(path).schema
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return spark.readStream.schema(schema).option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return spark.readStream.schema(schema).parquet(path)


def run_once(stream: DataFrame, out: str, name: str) -> None:
    """Take in what is there and end (ST1). A file that was taken in before is skipped: the checkpoint names it."""
    q = stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()


def run_idempotent(stream: DataFrame, out: str, name: str) -> None:
    """Each batch written to a folder of its own number, ledger row last (ST2): repeating a batch replaces it."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={number}")
        batch.agg(F.count("*").alias("rows")).write.mode("overwrite").parquet(f"{out}/ledger/batch={number}")
        batch.unpersist()

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling windows with a watermark: an addition of this engine, not the reference's."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"), F.sum("value").alias("value"))


#: What is remembered of a run: its last step, how many steps up to it were high in a row, its latest losses, and whether it has diverged.
FRESH = (-1, 0, (), False)


def first_divergence(held: tuple, steps: np.ndarray, losses: np.ndarray, norms: np.ndarray, high: float = 10.0, in_a_row: int = 3, window: int = 50, mean_above: float = 3.0) -> tuple[tuple, tuple[int, str] | None]:
    """What to remember after some more readings of a run, and (step, reason) if they hold its first divergence.

    Same rule as operators.ledger.divergence: a reading that is not finite, in_a_row norms above high, or a mean above
    mean_above over a full window of losses. Steps not beyond the last one are echoes; of a step read twice the first
    reading counts. All readings of a batch are judged at once.
    """
    last, streak, tail, over = held
    order = np.argsort(steps, kind="stable")
    order = order[np.append(True, np.diff(steps[order]) > 0) & (steps[order] > last)] if len(order) else order
    if over or not len(order):
        return held, None
    steps, losses, norms = steps[order], losses[order].astype(float), norms[order].astype(float)
    at = np.arange(len(steps))
    above = norms > high
    calm = np.maximum.accumulate(np.where(above, -1, at))  # the latest step that was not high
    streaks = np.where(calm < 0, at + 1 + streak, at - calm)
    known = np.append(tail, losses)
    total = np.cumsum(np.append(0.0, np.where(np.isfinite(known), known, 0.0)))
    end = len(tail) + at + 1
    full = end >= window
    mean = np.where(full, (total[end] - total[np.maximum(end - window, 0)]) / window, -np.inf)
    why = np.select([~(np.isfinite(losses) & np.isfinite(norms)), streaks >= in_a_row, mean > mean_above], [1, 2, 3], 0)
    hits = np.flatnonzero(why)
    keep = (int(steps[-1]), int(streaks[-1] if above[-1] else 0), tuple(known[-window:].tolist()), bool(len(hits)))
    return keep, (int(steps[hits[0]]), ("nonfinite", "gnorm", "loss")[why[hits[0]] - 1]) if len(hits) else None


def divergence_stream(stream: DataFrame, key: str, step: str, loss: str, gnorm: str, **limits) -> DataFrame:
    """key, step, reason of the first trigger of every run (ST3), with what is remembered of each run as its state."""

    def judge(name, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat([b[[step, loss, gnorm]] for b in batches], ignore_index=True).dropna(subset=[step])
        held = tuple(state.get) if state.exists else FRESH
        held, hit = first_divergence(held, *(rows[c].to_numpy() for c in (step, loss, gnorm)), **limits)
        state.update(held)
        yield pd.DataFrame([(name[0], *hit)] if hit else [], columns=[key, "step", "reason"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(judge, f"{key} {kind}, step long, reason string", "last long, streak int, tail array<double>, over boolean", "append", GroupStateTimeout.NoTimeout)


def out_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one for a stream's output and checkpoint, removed when the process ends."""
    return scratch(spark, name)
