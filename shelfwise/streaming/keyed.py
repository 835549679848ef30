"""Streaming jobs with keyed state: rows that wait and timers per bucket of keys in a RocksDB state store.

A bucket keeps only what later rows of its keys can still meet, so the state does not grow with history: events that wait for
the watermark, the items now on a list, the last fetch of an entry. Event-time timers release what waits once the watermark
has passed it, in the order of event time, however the rows arrived. Rows later than the watermark are dropped by the engine and
counted; :func:`late_rows` keeps these counts as a table.

Keys are hashed into a fixed number of buckets and a bucket keeps its rows packed, so a batch costs a few state calls per
bucket and not several per key or row. A batch reads what the buckets it meets keep: an entry of the state is read again when rows
of its bucket arrive or come due. The number of buckets belongs to the checkpoint: it cannot change while a job goes on.

A list is spread over the buckets by user and item, because one user may receive a third of all events; the
sizes of lists, which need all items of a user, are summed over time slices in every batch.

Jobs go on after a restart from the checkpoint in their folder. Rows without a key or a time are left out.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from shelfwise.functions.numbers import study_group
from shelfwise.operators.wishlist import sizes_after, time_slice
from shelfwise.sources.stores import append_changes
from shelfwise.sources.upserts import append, current
from shelfwise.streaming.jobs import LATENESS_SECONDS

BUCKETS = 256
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def _rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; the session's own setting comes back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, _PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _start(changes: DataFrame, fold, folder: str) -> StreamingQuery:
    with _rocksdb(changes.sparkSession):
        return (
            changes.writeStream.foreachBatch(fold)
            .outputMode("append")
            .option("checkpointLocation", f"{folder}/progress")
            .trigger(availableNow=True)
            .start()
        )


def _due(micros):
    """The first millisecond that is not before a moment (or each of a column); timers count in milliseconds."""
    return -(-micros // 1000)


def _bucket(buckets: int, *keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")


class _Packed(StatefulProcessor):
    """State lists whose entries are tables: one entry for all rows that a call adds."""

    def _list(self, handle: StatefulProcessorHandle, name: str, columns: str):
        """A list of tables with these columns (names and Arrow types), and its reader."""
        schema = pa.schema([(name, getattr(pa, kind)()) for name, kind in map(str.split, columns.split(", "))])
        return _PackedRows(handle.getListState(name, "packed binary"), schema)

    def close(self) -> None:
        pass


class _PackedRows:
    def __init__(self, state, schema: pa.Schema) -> None:
        self.state, self.schema = state, schema

    def _pack(self, rows: pd.DataFrame | pa.Table) -> tuple[bytes]:
        if isinstance(rows, pd.DataFrame):
            # column by column: Table.from_pandas also describes the frame, which takes longer than the few rows of a bucket
            columns = [pa.array(rows[field.name], field.type, from_pandas=True) for field in self.schema]
            rows = pa.Table.from_arrays(columns, schema=self.schema)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.schema) as writer:
            writer.write_table(rows)
        return (sink.getvalue().to_pybytes(),)

    def table(self) -> pa.Table:
        parts = [pa.ipc.open_stream(bytes(packed)).read_all() for (packed,) in self.state.get()]
        return pa.concat_tables([self.schema.empty_table(), *parts])

    def get(self) -> pd.DataFrame:
        return self.table().to_pandas()

    def add(self, rows: pd.DataFrame) -> None:
        self.state.appendValue(self._pack(rows))

    def put(self, rows: pd.DataFrame | pa.Table) -> None:
        if len(rows):
            self.state.put([self._pack(rows)])
        else:
            self.state.clear()


class _Waiting(_Packed):
    """Rows wait for the watermark; ``ready`` gets those it has passed, by time."""

    #: Columns that wait, in the order that decides between rows of one moment.
    ROW = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = self._list(handle, "waiting", f"micros int64, {self.ROW}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows))
        self.waiting.add(arrived)
        self.handle.registerTimer(int(_due(arrived["micros"].min())))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = self.waiting.table()
        due = pc.less_equal(rows["micros"], 1000 * (passed - 1))  # _due() is before the watermark
        found = rows.filter(due)
        if len(found):
            later = rows.filter(pc.invert(due))
            self.waiting.put(later)
            if len(later):
                self.handle.registerTimer(_due(pc.min(later["micros"]).as_py()))
            order = [(name, "ascending") for name in self.waiting.schema.names]
            yield from self.ready(found.take(pc.sort_indices(found, order, null_placement="at_start")).to_pandas())

    def ready(self, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        raise NotImplementedError


# ---- wishlist -----------------------------------------------------------------


class _Lists(_Waiting):
    """The listed items of a bucket of users and items; adding twice or removing twice changes nothing."""

    ROW = "event_id int64, item_id int64, action string, user_id int64"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.listed = self._list(handle, "listed", "user_id int64, item_id int64")

    def ready(self, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        entry = ["user_id", "item_id"]
        before = self.listed.get()
        # what was listed comes first, then the events in their order
        told = pd.concat([before, rows[entry]], ignore_index=True)
        told["added"] = np.append(np.full(len(before), True), rows["action"] == "add")
        earlier = told.groupby(entry, sort=False)["added"].shift(fill_value=False).astype(bool)
        last = ~told.duplicated(entry, keep="last")
        self.listed.put(told.loc[last & told["added"], entry])
        delta = told["added"].astype("int64") - earlier.astype("int64")
        told = rows[["user_id", "micros", "event_id"]].assign(delta=delta.to_numpy()[len(before) :])
        changes = told[told["delta"] != 0]
        # users whose events change nothing are known from now on
        silent = told[~told["user_id"].isin(changes["user_id"])].drop_duplicates("user_id")
        yield pd.concat([changes, silent])


def wishlist_lists(events: DataFrame, folder: str, *, lateness: int = LATENESS_SECONDS, buckets: int = BUCKETS) -> StreamingQuery:
    """Sizes of wishlists from add and remove events: event_id, ts, user_id, item_id, action.

    The rows are those of :func:`shelfwise.streaming.jobs.wishlist_stream` after the events the watermark has passed. Changes
    leave the state in the order of event time, batch after batch, so every batch continues the sizes of the one before.
    """
    rows = (
        events.filter("ts IS NOT NULL AND user_id IS NOT NULL AND item_id IS NOT NULL")
        .select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "item_id", F.coalesce("event_id", F.lit(0)).alias("event_id"), "action")
        .withWatermark("ts", f"{lateness} seconds")
        .withColumns({"micros": F.unix_micros("ts"), "bucket": _bucket(buckets, "user_id", "item_id")})
    )
    changes = rows.groupBy("bucket").transformWithStateInPandas(
        _Lists(), "user_id long, micros long, event_id long, delta long", "Append", "EventTime"
    )

    def fold(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read several times; the state must not be advanced by each
        try:
            if not batch.count():
                # events arrived that still wait: an empty run, without the plan for the sizes
                append(batch.select("user_id").limit(0), f"{folder}/sizes", ["user_id"], batch_id)
                return
            moved = batch.withColumn("ts", F.timestamp_micros("micros")).withColumn("slice", time_slice(F.col("ts")))
            # no user is null; saying so lets both joins below share one shuffle of the users
            touched = batch.select("user_id").filter("user_id IS NOT NULL").distinct()
            sizes = current(batch.sparkSession, f"{folder}/sizes", ["user_id"], before=batch_id, only=touched)
            append(sizes_after(touched, moved.filter("delta <> 0"), sizes), f"{folder}/sizes", ["user_id"], batch_id)
        finally:
            batch.unpersist()

    return _start(changes, fold, folder)


def wishlist_sizes(spark: SparkSession, folder: str) -> DataFrame | None:
    return current(spark, f"{folder}/sizes", ["user_id"])


# ---- registration -------------------------------------------------------------


class _Arrivals(_Packed):
    """The first arrivals of participants; one is forgotten when the watermark has passed the last by the lateness."""

    def __init__(self, lateness: int) -> None:
        self.lateness = lateness

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = self._list(handle, "seen", "participant_id string, until int64")

    def _keep(self, seen: pd.DataFrame) -> None:
        self.seen.put(seen)
        if len(seen):
            self.handle.registerTimer(int(seen["until"].min()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows)).groupby("participant_id", sort=False)["micros"].agg(["min", "max"]).reset_index()
        seen = self.seen.get()
        until = arrived.assign(until=_due(arrived["max"]) + 1000 * self.lateness)[["participant_id", "until"]]
        self._keep(pd.concat([seen, until]).groupby("participant_id", sort=False, as_index=False)["until"].max())
        first = arrived[~arrived["participant_id"].isin(seen["participant_id"])]
        yield first[["participant_id", "min"]].rename(columns={"min": "micros"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(timerValues.getCurrentWatermarkInMs() - 1, expiredTimerInfo.getExpiryTimeInMs())
        seen = self.seen.get()
        if (seen["until"] <= passed).any():
            self._keep(seen[seen["until"] > passed])
        yield from ()


def registrations(arrivals: DataFrame, folder: str, *, lateness: int = LATENESS_SECONDS, buckets: int = BUCKETS) -> StreamingQuery:
    """Register participants once, from participant_id and ts; a known id keeps its group and its first arrival.

    Arrivals repeated within the lateness end at the keyed state and never reach the table of participants; the
    table refuses those that come back after it. The earliest of the arrivals of one batch counts.
    """
    rows = (
        arrivals.filter("ts IS NOT NULL AND participant_id IS NOT NULL")
        .select("participant_id", F.col("ts").cast("timestamp").alias("ts"))
        .withWatermark("ts", f"{lateness} seconds")
        .withColumns({"micros": F.unix_micros("ts"), "bucket": _bucket(buckets, "participant_id")})
    )
    first = rows.groupBy("bucket").transformWithStateInPandas(
        _Arrivals(lateness), "participant_id string, micros long", "Append", "EventTime"
    )

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            append_changes(batch.agg(F.count(F.lit(1)).alias("passed")), f"{folder}/passed", batch_id)
            new = batch.select("participant_id", F.timestamp_micros("micros").alias("ts"))
            known = current(spark, f"{folder}/participants", ["participant_id"], before=batch_id, only=batch.select("participant_id"))
            if known is not None:
                new = new.join(known.select("participant_id"), "participant_id", "left_anti")
            new = new.withColumn("study_group", study_group(F.col("participant_id")))
            append(new, f"{folder}/participants", ["participant_id"], batch_id)
        finally:
            batch.unpersist()

    return _start(first, fold, folder)


# ---- metadata with an age limit -----------------------------------------------


class _Entries(_Waiting):
    """The cached entries of a bucket of items. A fresh entry stays; a stale one is asked for once and served until an update comes."""

    ROW = "description string, image_url string, item_id int64"

    def __init__(self, ttl_seconds: int) -> None:
        self.ttl = ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.fetched = self._list(handle, "fetched", "item_id int64, micros int64, asked bool_")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        yield from self._ask(timerValues.getCurrentWatermarkInMs())

    def _keep(self, fetched: pd.DataFrame) -> None:
        self.fetched.put(fetched)
        fresh = fetched.loc[~fetched["asked"], "micros"]
        if len(fresh):
            self.handle.registerTimer(int(_due(fresh.min() + self.ttl)))

    def _ask(self, passed: int) -> Iterator[pd.DataFrame]:
        """Requests for the entries that became stale before the watermark."""
        fetched = self.fetched.get()
        stale = ~fetched["asked"] & (_due(fetched["micros"] + self.ttl) < passed)
        if stale.any():
            self._keep(fetched.assign(asked=fetched["asked"] | stale))
            yield _entry_rows([(item, "expired", micros + self.ttl, None, None) for item, micros in fetched.loc[stale, ["item_id", "micros"]].itertuples(index=False)])

    def ready(self, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        fetched = {item: (micros, asked) for item, micros, asked in self.fetched.get().itertuples(index=False)}
        found = []
        for item, micros, description, image_url in rows[["item_id", "micros", "description", "image_url"]].itertuples(index=False):
            if item in fetched:
                before, asked = fetched[item]
                if micros <= before + self.ttl:
                    continue
                if not asked:
                    found.append((item, "expired", before + self.ttl, None, None))
            fetched[item] = (micros, False)
            found.append((item, "refreshed", micros, description, image_url))
        if found:
            self._keep(pd.DataFrame([(item, *entry) for item, entry in fetched.items()], columns=["item_id", "micros", "asked"]))
            yield _entry_rows(found)


def _entry_rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["item_id", "kind", "micros", "description", "image_url"])


def metadata_entries(updates: DataFrame, folder: str, *, ttl_seconds: int, lateness: int = LATENESS_SECONDS, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep a cache of entries (item_id, description, image_url, fetched_at) and ask for those that become stale.

    An update counts if it was fetched more than ``ttl_seconds`` after the entry it replaces. ``refreshes`` gets a row
    for every entry that grew too old, when event time passes its limit: item_id and stale_since. The entry is still served.
    """
    rows = (
        updates.filter("fetched_at IS NOT NULL AND item_id IS NOT NULL")
        .select("item_id", "description", "image_url", F.col("fetched_at").cast("timestamp").alias("fetched_at"))
        .withWatermark("fetched_at", f"{lateness} seconds")
        .withColumns({"micros": F.unix_micros("fetched_at"), "bucket": _bucket(buckets, "item_id")})
    )
    entries = rows.groupBy("bucket").transformWithStateInPandas(
        _Entries(ttl_seconds), "item_id long, kind string, micros long, description string, image_url string", "Append", "EventTime"
    )

    def fold(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("at", F.timestamp_micros("micros")).persist()
        try:
            append_changes(batch.filter("kind = 'expired'").select("item_id", F.col("at").alias("stale_since")), f"{folder}/refreshes", batch_id)
            newest = batch.filter("kind = 'refreshed'").groupBy("item_id").agg(F.max_by(F.struct("description", "image_url", F.col("at").alias("fetched_at")), "at").alias("e"))
            append(newest.select("item_id", "e.*"), f"{folder}/metadata", ["item_id"], batch_id)
        finally:
            batch.unpersist()

    return _start(entries, fold, folder)


def refresh_requests(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/refreshes").drop("batch")


# ---- accounting ---------------------------------------------------------------


def record_progress(query: StreamingQuery, folder: str) -> None:
    """Add what a finished run tells about its batches to the status table of the job."""
    rows = []
    for progress in query.recentProgress:
        operators = progress["stateOperators"]
        rows.append((
            progress["batchId"], progress["numInputRows"], sum(o["numRowsDroppedByWatermark"] for o in operators),
            sum(o["numRowsTotal"] for o in operators), progress["eventTime"].get("watermark"),
        ))
    spark = SparkSession.active()
    table = spark.createDataFrame(rows, "batch_id long, input_rows long, late_rows long, state_rows long, watermark string")
    table.coalesce(1).write.mode("append").parquet(f"{folder}/status")  # a few rows: one file


def late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """One row per batch that had input or dropped rows: batch_id, input_rows, late_rows, state_rows, watermark.

    The engine may report a batch more than once; its largest figures count.
    """
    status = spark.read.parquet(f"{folder}/status").groupBy("batch_id").agg(
        F.max("input_rows").alias("input_rows"), F.max("late_rows").alias("late_rows"), F.max("state_rows").alias("state_rows"), F.max("watermark").alias("watermark")
    )
    return status.filter("input_rows > 0 OR late_rows > 0")
