"""Stored tables: append-only upsert stores, embedding runs and the catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators.sessions import latest_by_key


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


# ---- upsert store: changed rows per batch, the newest version of a key wins ----


def append_changes(changes: DataFrame, path: str, batch: int) -> None:
    """Write one batch of changed rows. Writing a batch again replaces it."""
    changes.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def current(
    spark: SparkSession,
    path: str,
    keys: Sequence[str],
    *,
    before: int | None = None,
    only: DataFrame | None = None,
) -> DataFrame | None:
    """Newest version of every key; None if nothing was ever written.

    ``before`` gives the state as it was before a batch, ``only`` (a table of
    some key columns) limits the work to matching keys.
    """
    if not exists(spark, path):
        return None
    rows = spark.read.parquet(path)
    if before is not None:
        rows = rows.filter(F.col("batch") < before)
    if only is not None:
        rows = rows.join(only.distinct(), only.columns, "left_semi")
    return latest_by_key(rows, list(keys), "batch").drop("batch")


def compact(spark: SparkSession, path: str, target: str, keys: Sequence[str]) -> str:
    """Rewrite the current versions as one batch of a new store."""
    append_changes(current(spark, path, keys), target, 0)
    return target


# ---- embedding runs ---------------------------------------------------------


def write_run(vectors: DataFrame, manifest: DataFrame, root: str, run_id: str) -> str:
    """Write the vectors, then the manifest row, whose presence completes the run."""
    vectors.write.mode("overwrite").parquet(f"{root}/vectors/run_id={run_id}")
    manifest.write.mode("append").parquet(f"{root}/manifest")
    return run_id


def latest_run(manifest: DataFrame) -> DataFrame:
    """The newest complete run (one row, or none)."""
    newest = manifest.filter("complete").agg(
        F.max_by(F.struct(*manifest.columns), F.struct("created_at", "run_id")).alias("r")
    )
    return newest.filter(F.col("r").isNotNull()).select("r.*")


def load_run(spark: SparkSession, root: str, run_id: str | None = None) -> DataFrame:
    """Vectors of a run (default: the latest), with ``norm``; an empty run is an error."""
    if run_id is None:
        if not exists(spark, f"{root}/manifest"):
            raise FileNotFoundError(f"no embedding runs at {root}")
        row = latest_run(spark.read.parquet(f"{root}/manifest")).first()
        if row is None:
            raise FileNotFoundError(f"no complete embedding run at {root}")
        run_id = row["run_id"]
    path = f"{root}/vectors/run_id={run_id}"
    if not exists(spark, path):
        raise FileNotFoundError(f"embedding run not found at {path}")
    return validated_vectors(spark.read.parquet(path))


def validated_vectors(vectors: DataFrame) -> DataFrame:
    """Check the columns of an embedding table and add the vector length."""
    from shelfwise.functions.numbers import l2_norm
    from shelfwise.plans.train import narrow_embedding

    if "item_id" not in vectors.columns:
        raise ValueError("embedding table has no item_id column")
    if "embedding" not in vectors.columns:
        vectors = narrow_embedding(vectors)
    if vectors.isEmpty():
        raise ValueError("embedding contains no rows; train first")
    return vectors.withColumn("norm", l2_norm(F.col("embedding")))
