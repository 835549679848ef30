"""Preference vectors: what a user's liked items have in common."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.config import Preferences
from shelfwise.functions.numbers import centroid_count
from shelfwise.operators.blocks import cogroup_cells, iter_cells, keyed_cells, matrix
from shelfwise.operators.order_stats import order_statistics
from shelfwise.operators.scoring import mean_vectors
from shelfwise.session import cut_lineage

# Users with more liked items than this are clustered by distributed iterations.
LOCAL_ROWS = 4096
MAX_ITERATIONS = 300


def cluster_count(liked: Column, prefs: Preferences) -> Column:
    """Number of clusters actually formed: the centroid count capped at half the items."""
    wanted = centroid_count(
        liked, min_samples=prefs.min_samples, dynamic=prefs.dynamic, scaling=prefs.scaling
    )
    half = F.greatest(F.lit(1), F.floor(liked / 2))
    return F.when(liked <= wanted, F.lit(1)).otherwise(F.least(wanted, half)).cast("int")


def centroids(
    liked: DataFrame,
    prefs: Preferences,
    *,
    by: str = "user_id",
    local_rows: int = LOCAL_ROWS,
    max_iterations: int = MAX_ITERATIONS,
) -> DataFrame:
    """Preference centroids (by, centroid, vector) of liked (by, item_id, vector) rows.

    One centroid is the mean of all liked vectors and stays in the JVM. Several
    are found by seeded k-means: per user in one task while the user's items fit
    a bounded task, by distributed iterations beyond that.
    """
    mean = lambda of: mean_vectors(of, [by]).select(by, F.lit(0).cast("bigint").alias("centroid"), "vector")
    if prefs.min_samples >= 2**31 - 1:
        return mean(liked)
    # sizes need no vectors, and those of users with several centroids are shuffled for these only
    sizes = liked.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    sized = sizes.withColumn("k", cluster_count(F.col("n"), prefs))
    alone = sized.filter("k = 1").select(F.col(by).alias("_alone"))
    single = mean(liked.join(alone, F.col(by).eqNullSafe(F.col("_alone")), "left_semi"))
    several = sized.filter("k > 1").select(by, "n", "k")
    # the seeded hash orders the points: the first k of a user start the clusters
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(prefs.seed), F.col("item_id")), 11)
    points = liked.select(by, "item_id", "vector", draw.alias("draw"))
    local = points.join(several.filter(F.col("n") <= local_rows), by)
    result = single.unionByName(_cluster_locally(local, by, max_iterations))
    large = several.filter(F.col("n") > local_rows)
    if not large.isEmpty():
        shared = _cluster_across_tasks(points.join(large, by), by, prefs, max_iterations)
        result = result.unionByName(shared)
    return result


def lloyd(vectors: np.ndarray, start: np.ndarray, max_iterations: int) -> np.ndarray:
    """Lloyd iterations from given starting centroids; an empty cluster keeps its centroid."""
    centers = start.copy()
    previous = None
    for _ in range(max_iterations):
        nearest = np.argmin(_distances(vectors, centers), axis=1)
        if previous is not None and np.array_equal(nearest, previous):
            break
        previous = nearest
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, vectors)
        sizes = np.bincount(nearest, minlength=len(centers))
        filled = sizes > 0
        centers[filled] = sums[filled] / sizes[filled][:, None]
    return centers


def _distances(vectors: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances up to a per-row constant, rounded so equal ones tie."""
    return np.round((centers * centers).sum(axis=1)[None, :] - 2.0 * (vectors @ centers.T), 12)


def _cluster_locally(points: DataFrame, by: str, max_iterations: int) -> DataFrame:
    key_type = points.schema[by].dataType.simpleString()

    def cluster(table: pa.Table) -> pa.Table:
        table = table.sort_by([("draw", "ascending"), ("item_id", "ascending")])
        vectors = matrix(table.column("vector"))
        k = table.column("k")[0].as_py()
        centers = lloyd(vectors, vectors[:k], max_iterations)
        return pa.table(
            {
                by: table.column(by).slice(0, k),
                "centroid": table.column("draw").slice(0, k),
                "vector": pa.array(list(centers), pa.list_(pa.float64())),
            }
        )

    schema = f"{by} {key_type}, centroid bigint, vector array<double>"
    # one group is one user, whose size the caller has bounded
    return points.groupBy(by).applyInArrow(cluster, schema)


def _cluster_across_tasks(points: DataFrame, by: str, prefs: Preferences, max_iterations: int) -> DataFrame:
    """The same iterations as :func:`lloyd` for users too large for one task."""
    points = cut_lineage(points.select(by, "item_id", "vector", "draw"))
    total = points.count()
    bar = order_statistics(points, [by], "draw", {"bar": lambda n: cluster_count(n, prefs) - 1})
    centers = cut_lineage(
        points.join(bar.select(by, "bar"), by)
        .filter(F.col("draw") <= F.col("bar"))
        .select(by, F.col("draw").alias("centroid"), "vector")
    )
    key_type = points.schema[by].dataType.simpleString()
    item_type = points.schema["item_id"].dataType.simpleString()

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        vectors, targets = matrix(left.column("vector")), matrix(right.column("vector"))
        ids = right.column("centroid").to_numpy() if right.num_rows else np.zeros(0, np.int64)
        rows, chosen, distance = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for mine, theirs in iter_cells(left, right, [by]):
            theirs = theirs[np.argsort(ids[theirs])]
            for begin in range(0, len(mine), 1024):
                part = mine[begin : begin + 1024]
                gaps = _distances(vectors[part], targets[theirs])
                best = np.argmin(gaps, axis=1)
                rows.append(part)
                chosen.append(ids[theirs[best]])
                distance.append(gaps[np.arange(len(part)), best])
        at = pa.array(np.concatenate(rows))
        return pa.table(
            {
                by: left.column(by).take(at),
                "item_id": left.column("item_id").take(at),
                "centroid": pa.array(np.concatenate(chosen), pa.int64()),
                "gap": pa.array(np.concatenate(distance), pa.float64()),
            }
        )

    previous = None
    for _ in range(max_iterations):
        left, right = keyed_cells(
            points, centers, [by], ["item_id"], ["centroid"], total_rows=total, right_rows=4096
        )
        assigned = cut_lineage(
            cogroup_cells(
                left,
                right,
                ["_b"],
                nearest,
                f"{by} {key_type}, item_id {item_type}, centroid bigint, gap double",
            )
            .groupBy(by, "item_id")
            .agg(F.min(F.struct("gap", "centroid")).alias("m"))
            .select(by, "item_id", "m.centroid")
        )
        if previous is not None and assigned.join(previous, [by, "item_id", "centroid"], "left_anti").isEmpty():
            break
        previous = assigned
        moved = mean_vectors(points.join(assigned, [by, "item_id"]), [by, "centroid"])
        centers = cut_lineage(
            centers.join(moved.select(by, "centroid", F.col("vector").alias("moved")), [by, "centroid"], "left")
            .select(by, "centroid", F.coalesce("moved", "vector").alias("vector"))
        )
    return centers
