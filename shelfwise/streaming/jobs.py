"""Structured Streaming jobs. Each keeps its state in tables of changed rows.

Every micro-batch is folded by the same distributed operators as the batch
jobs, so a key that receives a third of all events is still spread over tasks.
Batches are written under their batch id: a repeated batch replaces itself and
reads the state as it was before that batch. The state tables merge their batches
in levels, so what a batch reads does not grow with the number of batches before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfwise.operators.catalog import accepted, normalize_records
from shelfwise.operators.search import current_metadata
from shelfwise.operators.sessions import register
from shelfwise.operators.wishlist import last_actions, wishlist_state
from shelfwise.sources.stores import append_changes, exists
from shelfwise.sources.upserts import append, current

# Events may arrive this much later than the newest event of their stream.
LATENESS_SECONDS = 600


def _start(stream: DataFrame, fold, folder: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(fold)
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )


# ---- wishlist -----------------------------------------------------------------


def wishlist_stream(events: DataFrame, folder: str, *, lateness: int = LATENESS_SECONDS) -> StreamingQuery:
    """Keep item and size state per user from add / remove events.

    Events newer than the horizon (newest time minus ``lateness``) wait in the
    pending table, because earlier ones may still arrive; events older than the
    previous horizon come too late and go to the late table.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        waiting = _pending(spark, folder, batch_id)
        arrived = batch.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "item_id", "action")
        horizon = _horizon(spark, folder, batch_id)
        newest = arrived.agg(F.max("ts")).first()[0]
        if newest is None:
            append_changes(arrived if waiting is None else waiting, f"{folder}/pending", batch_id)
            return
        late = arrived.filter(F.col("ts") <= F.lit(horizon)) if horizon is not None else arrived.limit(0)
        append_changes(late, f"{folder}/late", batch_id)
        usable = arrived if horizon is None else arrived.filter(F.col("ts") > F.lit(horizon))
        everything = usable if waiting is None else usable.unionByName(waiting)
        step = everything.agg(
            (F.max("ts") - F.expr(f"INTERVAL {lateness} SECONDS")).alias("horizon")
        )
        append_changes(step, f"{folder}/horizon", batch_id)
        bound = step.first()[0]
        if bound is None:
            bound = horizon
        append_changes(everything.filter(F.col("ts") > F.lit(bound)), f"{folder}/pending", batch_id)
        _apply(spark, everything.filter(F.col("ts") <= F.lit(bound)), folder, batch_id)

    return _start(events, fold, folder)


def _apply(spark: SparkSession, ready: DataFrame, folder: str, batch_id: int) -> None:
    touched = ready.select("user_id")
    items = current(spark, f"{folder}/items", ["user_id", "item_id"], before=batch_id, only=touched)
    sizes = current(spark, f"{folder}/sizes", ["user_id"], before=batch_id, only=touched)
    append(wishlist_state(ready, items, sizes), f"{folder}/sizes", ["user_id"], batch_id)
    append(last_actions(ready), f"{folder}/items", ["user_id", "item_id"], batch_id)


def _pending(spark: SparkSession, folder: str, batch_id: int) -> DataFrame | None:
    return spark.read.parquet(f"{folder}/pending/batch={batch_id - 1}") if batch_id > 0 else None


def _horizon(spark: SparkSession, folder: str, batch_id: int):
    if not exists(spark, f"{folder}/horizon"):
        return None
    rows = spark.read.parquet(f"{folder}/horizon").filter(F.col("batch") < batch_id)
    return rows.agg(F.max("horizon")).first()[0]


def wishlist_view(spark: SparkSession, folder: str) -> DataFrame:
    """Current wishlist sizes: the folded state continued by the pending events."""
    sizes = current(spark, f"{folder}/sizes", ["user_id"])
    items = current(spark, f"{folder}/items", ["user_id", "item_id"])
    last = spark.read.parquet(f"{folder}/pending").agg(F.max("batch")).first()[0]
    if last is None:
        return sizes
    waiting = spark.read.parquet(f"{folder}/pending/batch={last}")
    ahead = wishlist_state(waiting, items, sizes)
    if sizes is None:
        return ahead
    return sizes.join(ahead.select("user_id"), "user_id", "left_anti").unionByName(ahead)


# ---- registration ---------------------------------------------------------------


def registration_stream(arrivals: DataFrame, folder: str) -> StreamingQuery:
    """Register participants once; a known id is refused and keeps its group."""

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = current(
            spark, f"{folder}/participants", ["participant_id"], before=batch_id, only=batch.select("participant_id")
        )
        if known is None:
            known = spark.createDataFrame([], "participant_id string")
        append(register(known, batch), f"{folder}/participants", ["participant_id"], batch_id)

    return _start(arrivals, fold, folder)


# ---- catalog re-seeding -----------------------------------------------------------


def _drop_order(drop: str) -> Column:
    """Numbered drops by number, others (dates, names) by text, the same way in a batch and when reading."""
    text = F.col(drop).cast("string")
    return F.struct(text.try_cast("double"), text)


def reseed_stream(drops: DataFrame, folder: str, *, drop: str = "drop") -> StreamingQuery:
    """Replace the catalog by the newest drop; files of one drop may come in several batches."""

    def fold(batch: DataFrame, batch_id: int) -> None:
        newest = batch.agg(F.max_by(drop, _drop_order(drop))).first()[0]
        if newest is None:
            return
        records = normalize_records(batch.filter(F.col(drop) == newest).drop(drop))
        target = f"{folder}/catalog/drop={newest}/batch={batch_id}"
        accepted(records).write.mode("overwrite").parquet(target)

    return _start(drops, fold, folder)


def seeded_catalog(spark: SparkSession, folder: str, *, drop: str = "drop") -> DataFrame:
    """Records of the newest drop."""
    stored = spark.read.parquet(f"{folder}/catalog")
    newest = stored.agg(F.max_by(drop, _drop_order(drop)).alias("d")).scalar()
    return stored.filter(F.col(drop) == newest).drop(drop, "batch")


# ---- metadata cache ---------------------------------------------------------------


def metadata_stream(updates: DataFrame, folder: str, *, ttl_seconds: int) -> StreamingQuery:
    """Refresh stale cache entries from arriving updates; fresh entries stay."""

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        cached = current(spark, f"{folder}/metadata", ["item_id"], before=batch_id, only=batch.select("item_id"))
        columns = ["item_id", "description", "image_url", "fetched_at"]
        newest = batch.groupBy("item_id").agg(
            F.max_by(F.struct(*columns[1:]), F.col("fetched_at")).alias("u")
        ).select("item_id", "u.*")
        if cached is None:
            cached = newest.limit(0)
        # an update is judged at the moment it was fetched
        as_of = F.coalesce(F.col("_fetched_at"), F.col("fetched_at"))
        merged = current_metadata(cached, newest, as_of, ttl_seconds=ttl_seconds)
        append(merged.filter("state = 'refreshed'").drop("state"), f"{folder}/metadata", ["item_id"], batch_id)

    return _start(updates, fold, folder)
