"""Session helpers: a tuned builder, the shared checkpoint folder, lineage cuts and table loading."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for one machine; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(master)
        .appName("sievework")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; a table of texts is spread over all cores if its files make fewer splits.

    Work on texts is bound by computation, and a small file is one split. Large tables have more splits than there
    are cores and are read as they lie, without that shuffle.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if "text" in df.columns and cores > 1 and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (only where that is unset) a folder of our own."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    own = getattr(shared_dir, "own", None)
    if own is None or not os.path.isdir(own):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="sievework-")
        shared_dir.own = own
        atexit.register(shutil.rmtree, own, True)
    return own


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/sievework/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back.

    The table outlives the loss of any executor. It stays until discard(), until the end of the temporary() it was
    written in, or until the driver's process ends.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the table behind a result of materialize(). Only for one whose successor is written."""
    if path := getattr(df, "written_to", None):
        for scope in _scopes:
            scope[:] = [x for x in scope if x[1] != path]
        _remove(df.sparkSession, path)


#: The tables written in each open temporary(), the innermost last.
_scopes: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def temporary() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside are removed at the end, but for those given to the function that it yields.

    What is handed out must rest on kept tables only.
    """
    own: list[tuple[SparkSession, str]] = []

    def keep(df: DataFrame) -> DataFrame:
        path = df.written_to
        for entry in [x for x in own if x[1] == path]:
            own.remove(entry)
            if len(_scopes) > 1:
                _scopes[-2].append(entry)
        return df

    _scopes.append(own)
    try:
        yield keep
    finally:
        _scopes.remove(own)
        for spark, path in own:
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    """Best effort; a stopped session leaves the folder to its owner."""
    try:
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(hadoop).delete(target, True)
    except Exception:
        if path.startswith("file:"):
            path = path[5:]
        shutil.rmtree(path, ignore_errors=True)
