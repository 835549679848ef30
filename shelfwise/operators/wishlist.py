"""Wishlist state from add / remove events, exact for users of any size.

A user's events are cut into time slices. Each slice is folded on its own, the
slices of a user are combined by a running sum over slice totals, and so no
task has to read a whole user in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: list size at which the task counts as completed.
TASK_SIZE = 2
SLICE_SECONDS = 60


def time_slice(ts: Column, seconds: int = SLICE_SECONDS) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(seconds * 1_000_000))


def items_in_wishlist(events: DataFrame) -> DataFrame:
    """(user_id, item_id, since): adding twice or removing twice changes nothing,
    so an item is listed exactly if its last action is an add."""
    last = events.groupBy("user_id", "item_id").agg(
        F.max_by("action", F.struct("ts", "event_id")).alias("last_action"),
        F.max(F.when(F.col("action") == "remove", F.struct("ts", "event_id"))).alias("removed"),
    )
    listed = last.filter("last_action = 'add'").select("user_id", "item_id", "removed")
    moment = F.struct("ts", "event_id")
    return (
        events.filter("action = 'add'")
        .join(listed, ["user_id", "item_id"])
        .filter(F.col("removed").isNull() | (moment > F.col("removed")))
        .groupBy("user_id", "item_id")
        .agg(F.min("ts").alias("since"))
    )


def effective_events(
    events: DataFrame, opening: DataFrame | None = None, *, slice_seconds: int = SLICE_SECONDS
) -> DataFrame:
    """Events that change the list: user_id, slice, ts, event_id, delta (+1 or -1).

    ``opening`` (user_id, item_id, listed) is the state before the first event.
    """
    sliced = events.withColumn("slice", time_slice(F.col("ts"), slice_seconds))
    inside = Window.partitionBy("user_id", "item_id", "slice").orderBy("ts", "event_id")
    marked = sliced.withColumn("before", F.lag("action").over(inside))
    # the action before a slice is the last action of the item's previous slice
    ends = sliced.groupBy("user_id", "item_id", "slice").agg(
        F.max_by("action", F.struct("ts", "event_id")).alias("closing")
    )
    across = Window.partitionBy("user_id", "item_id").orderBy("slice")
    starts = ends.select("user_id", "item_id", "slice", F.lag("closing").over(across).alias("opening"))
    joined = marked.join(starts, ["user_id", "item_id", "slice"])
    earliest = F.lit("remove")
    if opening is not None:
        joined = joined.join(opening.select("user_id", "item_id", "listed"), ["user_id", "item_id"], "left")
        earliest = F.when(F.col("listed") == 1, "add").otherwise("remove")
    before = F.coalesce("before", "opening", earliest)
    return joined.filter(F.col("action") != before).select(
        "user_id", "slice", "ts", "event_id", F.when(F.col("action") == "add", 1).otherwise(-1).alias("delta")
    )


def last_actions(events: DataFrame) -> DataFrame:
    """(user_id, item_id, listed) after the events."""
    last = F.max_by("action", F.struct("ts", "event_id"))
    return events.groupBy("user_id", "item_id").agg((last == "add").cast("int").alias("listed"))


def wishlist_state(
    events: DataFrame,
    opening_items: DataFrame | None = None,
    opening_sizes: DataFrame | None = None,
    *,
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Per user with events: current size, largest size ever, and the completed latch.

    ``events``: event_id, ts, user_id, item_id, action (add or remove). The
    opening tables, as produced by :func:`last_actions` and by this function,
    continue an earlier state.
    """
    changes = effective_events(events, opening_items, slice_seconds=slice_seconds)
    return sizes_after(events.select("user_id").distinct(), changes, opening_sizes)


def sizes_after(users: DataFrame, changes: DataFrame, opening_sizes: DataFrame | None = None) -> DataFrame:
    """The row of :func:`wishlist_state` for every one of ``users``, from effective changes (see :func:`effective_events`)."""
    inside = Window.partitionBy("user_id", "slice").orderBy("ts", "event_id")
    folded = (
        changes.withColumn("running", F.sum("delta").over(inside))
        .groupBy("user_id", "slice")
        .agg(F.sum("delta").alias("total"), F.max("running").alias("peak"))
    )
    before = Window.partitionBy("user_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        folded.withColumn("offset", F.coalesce(F.sum("total").over(before), F.lit(0)))
        .groupBy("user_id")
        .agg(F.sum("total").alias("change"), F.max(F.col("offset") + F.col("peak")).alias("highest"))
    )
    zero = F.lit(0).cast("bigint")
    result = users.join(sizes, "user_id", "left")
    start, past = zero, zero
    if opening_sizes is not None:
        earlier = opening_sizes.select("user_id", F.col("n_items").alias("_start"), F.col("max_items").alias("_past"))
        result = result.join(earlier, "user_id", "left")
        start, past = F.coalesce("_start", zero), F.coalesce("_past", zero)
    highest = F.greatest(past, start + F.coalesce("highest", zero))
    return result.select(
        "user_id",
        (start + F.coalesce("change", zero)).alias("n_items"),
        highest.alias("max_items"),
        (highest >= TASK_SIZE).cast("int").alias("task_completed"),
    )
