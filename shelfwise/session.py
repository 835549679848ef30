"""Session construction and the few settings the operators rely on."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def build_session(master: str | None = None, app_name: str = "shelfwise", **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution (skew splitting on)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        settings.setdefault("spark.sql.shuffle.partitions", "8")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def load_tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """Lazy Parquet readers for the named test tables (all of them by default)."""
    return {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in (names or TABLES)}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share.

    Only a local session without that setting gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return _local_folder()


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="shelfwise-")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new sub-folder of the shared folder for tables a job writes."""
    return f"{shared_folder(spark)}/shelfwise-{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside remove their shuffle files when they end, instead of whenever the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    former = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if former is None else spark.conf.set(name, former)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of :func:`work_folder` that is no longer read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder; survives the loss of executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def cut_partitioned(df: DataFrame, *keys: str) -> DataFrame:
    """Checkpoint hash-partitioned by the keys, so that later joins and groupings by
    them need no shuffle of this table.

    Adaptive execution is off for this one write: it may merge partitions, after
    which the planner no longer knows how the rows are placed.
    """
    spark = df.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut_lineage(df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def parallelism(spark: SparkSession) -> int:
    """Number of tasks worth creating for one stage of this session."""
    return max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        spark.sparkContext.defaultParallelism,
    )


def widen(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a file scan of fewer partitions than tasks before CPU-heavy row work.

    Large inputs already have enough partitions and are returned unchanged. For
    plain scans only: asking a plan with shuffles for its partitions would run it.
    """
    wanted = parallelism(df.sparkSession)
    return df.repartition(wanted, *keys) if df.rdd.getNumPartitions() < wanted else df
