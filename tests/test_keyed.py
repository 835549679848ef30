"""Keyed streaming state: what waits, what is forgotten, what is counted."""

import random

import pandas as pd
from pyspark.sql import functions as F

from shelfwise.streaming import keyed


def run(spark, tmp_path, schema, batches, start):
    """One run of the job per batch; the folder."""
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        frame = spark.createDataFrame(rows, schema)
        frame.coalesce(1).write.mode("append").parquet(source)
        stream = start(spark.readStream.schema(frame.schema).parquet(source), folder)
        stream.awaitTermination()
        keyed.record_progress(stream, folder)
    return folder


def test_repeated_arrivals_end_at_the_state(spark, tmp_path):
    def start(stream, folder):
        return keyed.registrations(stream.select("participant_id", F.timestamp_seconds("s").alias("ts")), folder)

    batches = [
        [("participant-1", 1000), ("participant-1", 990), ("participant-2", 1000), (None, 1000)],
        [("participant-1", 1100), ("participant-3", 1200)],  # the first within the lateness: the table is not asked
        [("participant-4", 9000)],
        [("participant-1", 9100), ("participant-2", 500)],  # the first is forgotten and refused by the table, the second is late
    ]
    folder = run(spark, tmp_path, "participant_id string, s long", batches, start)
    stored = {r["participant_id"]: r["s"] for r in keyed.current(spark, f"{folder}/participants", ["participant_id"]).select("participant_id", F.unix_seconds("ts").alias("s")).collect()}
    assert stored == {"participant-1": 990, "participant-2": 1000, "participant-3": 1200, "participant-4": 9000}
    assert spark.read.parquet(f"{folder}/passed").agg(F.sum("passed")).first()[0] == 5
    late = {r["batch_id"]: r["late_rows"] for r in keyed.late_rows(spark, folder).collect()}
    assert sum(late.values()) == 1


def test_state_of_lists_does_not_grow_with_history(spark, tmp_path):
    def start(stream, folder):
        return keyed.wishlist_lists(stream.withColumn("ts", F.timestamp_seconds("s")), folder, lateness=10)

    schema = "event_id long, s long, user_id long, item_id long, action string"
    batches = [[(100 * b + i, 1000 * b + i, 1, i % 2, "add" if i % 4 < 2 else "remove") for i in range(40)] for b in range(4)]
    batches[2].append((None, 2000, None, 1, "add"))
    folder = run(spark, tmp_path, schema, batches, start)
    sizes = keyed.wishlist_sizes(spark, folder).collect()
    assert [(r["user_id"], r["max_items"], r["task_completed"]) for r in sizes] == [(1, 2, 1)]
    states = [r["state_rows"] for r in keyed.late_rows(spark, folder).orderBy("batch_id").collect()]
    assert max(states[1:]) <= states[1] + 4


def test_sizes_are_computed_only_for_batches_with_changes(spark, tmp_path, monkeypatch):
    """A batch whose events all wait leaves an empty run; in the others the users are shuffled once for both joins."""
    plans, planned = [], keyed.sizes_after

    def sizes_after(users, changes, opening):
        after = planned(users, changes, opening)
        plans.append((changes.count(), after))
        if opening is not None:
            after.collect()
            reused.append(after._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("ReusedExchange"))
        return after

    reused = []
    monkeypatch.setattr(keyed, "sizes_after", sizes_after)

    def start(stream, folder):
        return keyed.wishlist_lists(stream.withColumn("ts", F.timestamp_seconds("s")), folder, lateness=10, buckets=8)

    schema = "event_id long, s long, user_id long, item_id long, action string"
    batches = [[(100 * b + u, 1000 * b + u, u, b, "add") for u in range(30)] + [(100 * b, 1000 * b + 40, None, b, "add")] for b in range(1, 4)]
    broadcasts = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(broadcasts)
    spark.conf.set(broadcasts, "-1")
    try:
        folder = run(spark, tmp_path, schema, batches, start)
    finally:
        spark.conf.set(broadcasts, before)
    counted = [changes for changes, _ in plans]
    assert all(counted) and reused and min(reused) >= 1
    runs = {int(path.name.split("-")[1]): path for path in (tmp_path / "out" / "sizes").glob("_run=0-*")}
    filled = [batch for batch, path in runs.items() if list(path.rglob("*.parquet"))]
    assert len(filled) == len(counted) < len(runs) and all((path / "_SUCCESS").exists() for path in runs.values())
    assert sorted(runs) == list(range(len(runs)))
    sizes = {r["user_id"]: (r["n_items"], r["max_items"], r["task_completed"]) for r in keyed.wishlist_sizes(spark, folder).collect()}
    assert sizes == {u: (3, 3, 1) if u < 19 else (2, 2, 1) for u in range(30)}


def test_old_entries_are_asked_for_once_and_served(spark, tmp_path):
    def start(stream, folder):
        rows = stream.select("item_id", F.col("text").alias("description"), F.lit("").alias("image_url"), F.timestamp_seconds("s").alias("fetched_at"))
        return keyed.metadata_entries(rows, folder, ttl_seconds=100, lateness=10)

    batches = [[(1, "first", 1000), (1, "too early", 1050), (2, "other", 1000)], [(2, "fresh", 1080)], [(3, "third", 1500)], [(1, "later", 1600)], [(3, None, 5000)]]
    folder = run(spark, tmp_path, "item_id long, text string, s long", batches, start)
    served = {r["item_id"]: r["description"] for r in keyed.current(spark, f"{folder}/metadata", ["item_id"]).collect()}
    assert served == {1: "later", 2: "other", 3: "third"}
    asked = sorted((r["item_id"], r["s"]) for r in keyed.refresh_requests(spark, folder).select("item_id", F.unix_seconds("stale_since").alias("s")).collect())
    assert asked == [(1, 1100), (1, 1700), (2, 1100), (3, 1600)]


def test_many_keys_share_state_entries(spark, tmp_path):
    """State calls cost time per entry: what waits or is kept must not be one entry per key."""
    schema = "event_id long, s long, user_id long, item_id long, action string"
    events = lambda *starts: [[(10_000 * b + u, start + u % 5, u, u % 3, "add") for u in range(2000)] for b, start in enumerate(starts)]

    def entries(folder):
        return max(r["state_rows"] for r in keyed.late_rows(spark, folder).collect())

    def lists(stream, folder):
        return keyed.wishlist_lists(stream.withColumn("ts", F.timestamp_seconds("s")), folder, lateness=10, buckets=8)

    folder = run(spark, tmp_path / "lists", schema, events(1000, 1000, 2000), lists)
    rows = keyed.wishlist_sizes(spark, folder).collect()
    assert sorted((r["user_id"], r["n_items"], r["max_items"]) for r in rows) == [(u, 1, 1) for u in range(2000)]
    assert entries(folder) < 100


def test_many_participants_and_items_share_state_entries(spark, tmp_path):
    arrivals = [[(f"participant-{u}", 1000 + u % 5) for u in range(2000)], [(f"participant-{u}", 1010) for u in range(2000)]]

    def registrations(stream, folder):
        return keyed.registrations(stream.select("participant_id", F.timestamp_seconds("s").alias("ts")), folder, buckets=8)

    folder = run(spark, tmp_path / "participants", "participant_id string, s long", arrivals, registrations)
    assert spark.read.parquet(f"{folder}/passed").agg(F.sum("passed")).first()[0] == 2000
    assert keyed.late_rows(spark, folder).agg(F.max("state_rows")).first()[0] < 100

    def entries(stream, folder):
        rows = stream.select("item_id", F.lit("x").alias("description"), F.lit("").alias("image_url"), F.timestamp_seconds("s").alias("fetched_at"))
        return keyed.metadata_entries(rows, folder, ttl_seconds=100, lateness=10, buckets=8)

    updates = [[(i, 1000 + i % 5) for i in range(2000)], [(i, 1200) for i in range(2000)]]
    folder = run(spark, tmp_path / "entries", "item_id long, s long", updates, entries)
    assert keyed.refresh_requests(spark, folder).count() == 2000
    assert keyed.late_rows(spark, folder).agg(F.max("state_rows")).first()[0] < 100


class Entries:
    """A state list, the handle that gives it and its timers, without a running query."""

    def __init__(self):
        self.rows, self.timers = [], []

    def getListState(self, name, schema):
        return Entries()

    def registerTimer(self, at):
        self.timers.append(at)

    def get(self):
        return iter(self.rows)

    def appendValue(self, row):
        self.rows.append(row)

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.rows = []

    def getCurrentWatermarkInMs(self):
        return self.passed


def test_bucket_of_lists_against_a_plain_fold():
    """Rows of one moment, unknown actions and ids beyond 2**53, over several timers; every change keeps its exact event id."""
    draw, big = random.Random(3), 2**53
    bucket, handle = keyed._Lists(), Entries()
    bucket.init(handle)
    columns = ["user_id", "item_id", "event_id", "action", "micros"]
    waiting, listed = [], set()
    for step in range(8):
        rows = [(draw.randrange(6), draw.randrange(4), big + draw.randrange(9), draw.choice(["add", "remove", None]), 2_000_000 * step + 500 * draw.randrange(6000)) for _ in range(60)]
        assert list(bucket.handleInputRows(0, iter([pd.DataFrame(rows, columns=columns)]), None)) == []
        handle.passed = 2000 * step + draw.randrange(3000)
        got = [tuple(row) for frame in bucket.handleExpiredTimer(0, handle, None) for row in frame.itertuples(index=False)]
        waiting += rows
        due = [row for row in waiting if -(-row[4] // 1000) < handle.passed]
        waiting = [row for row in waiting if row not in due]
        # user_id, micros, event_id, delta; a missing action sorts first
        changes, seen = [], {}
        for user, item, event, action, micros in sorted(due, key=lambda r: (r[4], r[2], r[1], r[3] or "", r[0])):
            delta = (action == "add") - ((user, item) in listed)
            (listed.add if action == "add" else listed.discard)((user, item))
            changes += [(user, micros, event, delta)] if delta else []
            seen.setdefault(user, (user, micros, event, 0))
        silent = [row for user, row in seen.items() if user not in {c[0] for c in changes}]
        assert got == changes + silent
        assert {tuple(row) for row in bucket.listed.get().itertuples(index=False)} == listed
        assert len(bucket.waiting.get()) == len(waiting)
        if due and waiting:
            assert handle.timers[-1] == -(-min(row[4] for row in waiting) // 1000)
