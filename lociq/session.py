"""Session factory and the shared scratch area that cuts lineage."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(cores: int | str = "*", partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A local session with the settings every query of this library assumes (UTC, adaptive execution)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lociq")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and driver
    and executors are one process (tests)."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = context.getCheckpointDir()
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_dir(spark)}/lociq/{name}-{uuid.uuid4().hex[:12]}"


#: Bytes of a batch that goes to a Python worker and back while a table is written: both sides hold a few of them a task.
BATCH = "8m"


#: Settings of a written table's job: small batches, and no shuffle file outlives the job.
WRITING = {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH, "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """WRITING for what is executed within; the caller's settings come back afterwards."""
    before = {key: spark.conf.get(key, None) for key in WRITING}
    for key, value in WRITING.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written within go when it ends, but for those written with keep: their folders at once, the
    shuffle files of the finished jobs as soon as the driver has collected their plans."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            delete_path(spark, path)
        release(spark)


def release(spark: SparkSession) -> None:
    """Lets the context cleaner drop the shuffle files of jobs that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors.

    Within scratch() the table goes at its end, unless keep."""
    path = new_path(df.sparkSession, name)
    if _scratch and not keep:
        _scratch[-1].append(path)
    with writing(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def bucketed(df: DataFrame, by: str, name: str, then: Callable[[DataFrame], DataFrame] | None = None) -> Iterator[DataFrame]:
    """df in the shared folder, dealt out by one column into as many buckets as the session has shuffle partitions, so that
    joins and folds by that column send none of its rows. then: what is done with the rows where they are dealt out; it
    keeps the column. The table is there within the block only."""
    spark, path, n = df.sparkSession, new_path(df.sparkSession, name), partitions(df.sparkSession)
    dealt = df.repartition(n, by)
    called = f"lociq_{name}_{uuid.uuid4().hex[:12]}"
    with writing(spark):
        (dealt if then is None else then(dealt)).write.bucketBy(n, by).sortBy(by).option("path", path).saveAsTable(called, format="parquet")
    try:
        yield spark.table(called)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {called}")
        delete_path(spark, path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch path that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session is sized for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows that one task sorts.
SORTED = 1_000_000


def tasks(spark: SparkSession, rows: int) -> int:
    """The session's number of shuffle partitions, but at least one for SORTED of so many rows."""
    return max(partitions(spark), -(-rows // SORTED))


@contextmanager
def sized(spark: SparkSession, rows: int) -> Iterator[None]:
    """At least one shuffle partition for SORTED of so many rows, for what is executed within: a task then sorts in memory,
    however large the table is. Adaptive execution joins small ones again."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(tasks(spark, rows)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Told of every table that is read, so that what is built from it can be kept for as long as it holds.
on_read: Callable[[SparkSession, str], None] | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip(os.sep)}/{name}.parquet"
    if on_read is not None:
        on_read(spark, path)
    return spark.read.parquet(path)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly these columns by exact name, whatever other columns (or case variants of a name) the input carries."""
    at = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    flat = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_c{at[n]}").alias(n) for n in names])
