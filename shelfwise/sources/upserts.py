"""Upsert tables with bounded reads: runs of changed rows, merged in levels.

Every batch writes one run of changed rows. When ``FAN`` neighbouring runs of a level are complete, the next batch first
merges them into one run of the level above, which keeps the newest row of every key. A reader therefore meets at most
``FAN - 1`` runs per level, whatever the number of batches, and reads a key at most that often. Merged runs are split into
``BUCKETS`` folders by a hash of the key, so that a reader with a list of keys opens the folders of these keys only, and carry
Bloom filters of the key columns for lookups of single keys.

A run is named by its level and first batch, which also says which batches it holds: runs need no list of their own, a batch
that is repeated writes the same folder again, and a merged run is complete once Spark has marked it. The runs that went into
a merged one stay until the merge after it, for readers that still hold them. One writer at a time.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators.sessions import latest_by_key
from shelfwise.sources.stores import exists

FAN, BUCKETS = 8, 16
BATCH, BUCKET, RUN = "_batch", "_bucket", "_run"


def bucket_of(keys: Sequence[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def cover(batches: int) -> list[tuple[int, int]]:
    """The runs (level, first batch) that hold batches 0 to ``batches`` - 1, the largest first."""
    runs, first = [], 0
    while first < batches:
        level = 0
        while first % FAN ** (level + 1) == 0 and first + FAN ** (level + 1) <= batches:
            level += 1
        runs.append((level, first))
        first += FAN**level
    return runs


def _run(path: str, level: int, first: int) -> str:
    return f"{path}/{RUN}={level}-{first}"


def _complete(spark: SparkSession, path: str, level: int, first: int) -> bool:
    return exists(spark, f"{_run(path, level, first)}/_SUCCESS")


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _size(spark: SparkSession, folder: str) -> int:
    files, where = _folder(spark, folder)
    return files.getContentSummary(where).getLength()


def written(spark: SparkSession, path: str) -> int:
    """Number of batches up to the newest complete run; 0 for a table that was never written."""
    if not exists(spark, path):
        return 0
    files, where = _folder(spark, path)
    names = [re.fullmatch(RUN + r"=(\d+)-(\d+)", status.getPath().getName()) for status in files.listStatus(where)]
    runs = [(int(name[1]), int(name[2])) for name in names if name]
    return max((first + FAN**level for level, first in runs if _complete(spark, path, level, first)), default=0)


def live_runs(spark: SparkSession, path: str, batches: int) -> list[str]:
    """Folders that hold the state after so many batches. A merged run that is missing is read through its parts;
    batches that were never written hold nothing."""

    def parts(level: int, first: int) -> list[str]:
        if _complete(spark, path, level, first):
            folder = _run(path, level, first)
            return [folder] if _size(spark, folder) else []  # a batch without rows has no files
        if level == 0:
            return []
        size = FAN ** (level - 1)
        return [folder for part in range(FAN) for folder in parts(level - 1, first + part * size)]

    return [folder for level, first in cover(batches) for folder in parts(level, first)]


def live_bytes(spark: SparkSession, path: str, batches: int | None = None) -> int:
    """Bytes in the runs that a reader of the whole table opens."""
    return sum(_size(spark, folder) for folder in live_runs(spark, path, written(spark, path) if batches is None else batches))


def _rows(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    return spark.read.option("basePath", path).parquet(*folders).drop(RUN)


def _read(spark: SparkSession, path: str, folders: list[str], keys: Sequence[str], only: DataFrame | None) -> DataFrame | None:
    if not folders:
        return None
    rows = _rows(spark, path, folders)
    if only is not None:
        # a part of the key does not tell the bucket
        if set(only.columns) == set(keys):
            wanted = [row[0] for row in only.select(bucket_of(keys).alias("b")).distinct().collect()]  # at most BUCKETS
            rows = rows.filter(F.col(BUCKET).isin(wanted))
        rows = rows.join(only.distinct(), only.columns, "left_semi")
    return latest_by_key(rows.drop(BUCKET), list(keys), BATCH)


def _write(rows: DataFrame, target: str, keys: Sequence[str]) -> None:
    writer = rows.withColumn(BUCKET, bucket_of(keys)).repartition(BUCKETS, BUCKET).write.mode("overwrite").partitionBy(BUCKET)
    for key in keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer.parquet(target)


def _merge(spark: SparkSession, path: str, keys: Sequence[str], batch: int) -> None:
    """Merge the runs that the batches before ``batch`` have completed."""
    level = 1
    while batch and batch % FAN**level == 0:
        size = FAN**level
        first = batch - size
        if not _complete(spark, path, level, first):
            parts = [_run(path, level - 1, first + i * size // FAN) for i in range(FAN)]
            rows = _read(spark, path, [part for part in parts if exists(spark, f"{part}/_SUCCESS") and _size(spark, part)], keys, None)
            if rows is not None:
                _write(rows, _run(path, level, first), keys)
        for i in range(FAN):
            files, where = _folder(spark, _run(path, level - 1, first - size + i * size // FAN))
            if first >= size and _complete(spark, path, level, first - size):
                files.delete(where, True)
        level += 1


def append(changes: DataFrame, path: str, keys: Sequence[str], batch: int) -> None:
    """Write the changed rows of a batch (one row per key). Writing a batch again replaces it."""
    spark = changes.sparkSession
    _merge(spark, path, keys, batch)
    _write(changes.withColumn(BATCH, F.lit(batch)), _run(path, 0, batch), keys)


def current(
    spark: SparkSession, path: str, keys: Sequence[str], *, before: int | None = None, only: DataFrame | None = None
) -> DataFrame | None:
    """Newest row of every key; None if nothing was ever written.

    ``before`` gives the state as it was before a batch, ``only`` (a table of key columns) limits the rows to these keys.
    """
    rows = _read(spark, path, live_runs(spark, path, written(spark, path) if before is None else before), keys, only)
    return None if rows is None else rows.drop(BATCH)


def lookup(spark: SparkSession, path: str, **key) -> DataFrame | None:
    """The row of one key (all key columns must be named), through its bucket and the Bloom filters of the runs."""
    folders = live_runs(spark, path, written(spark, path))
    if not folders:
        return None
    rows = _rows(spark, path, folders)
    types = dict(rows.dtypes)
    values = {name: F.lit(value).cast(types[name]) for name, value in key.items()}
    one = spark.range(1).select(F.pmod(F.xxhash64(*values.values()), F.lit(BUCKETS)).cast("int")).first()[0]
    rows = rows.filter(F.col(BUCKET) == one)
    for name, value in values.items():
        rows = rows.filter(F.col(name) == value)
    return latest_by_key(rows.drop(BUCKET), list(key), BATCH).drop(BATCH)
