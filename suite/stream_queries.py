"""Jobs with keyed streaming state, fed in several runs with late rows among them.

The events of a table arrive in ``PARTS`` parts by time; every twentieth comes two parts too late. Each part is one run of
the job, which is started anew from its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.session import work_folder
from shelfwise.streaming import keyed
from suite.recommend_queries import _GROUP_SQL
from suite.registry import query

PARTS = 4
_DAYS = 8


def _fed(fx, rows, start, name):
    """Run the job of ``start(stream, folder)`` once per part; the folder of its tables."""
    spark = fx.spark
    base = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / (_DAYS * 86_400_000_000))
    base = F.least(base, F.lit(PARTS - 1))
    part = F.when(F.col("event_id") % 20 == 0, F.least(base + 2, F.lit(PARTS - 1))).otherwise(base)
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("part", part.cast("int"))
    folder = work_folder(spark, name)
    rows.write.partitionBy("part").parquet(f"{folder}/parts")
    schema = rows.drop("part").schema
    for number in range(PARTS):
        spark.read.schema(schema).parquet(f"{folder}/parts/part={number}").write.mode("append").parquet(f"{folder}/arrived")
        run = start(spark.readStream.schema(schema).parquet(f"{folder}/arrived"), folder)
        run.awaitTermination()
        keyed.record_progress(run, folder)
    return folder


def _arrivals_sql(rows: str) -> str:
    """CTEs over rows with event_id and ts: ``told`` (with part and the watermark that met it), ``usable``, ``closing``."""
    day = f"least(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01'), {PARTS * _DAYS * 86_400_000_000 - 1}) // {_DAYS * 86_400_000_000}"
    return f"""source AS ({rows}),
    dealt AS (SELECT *, CASE WHEN event_id % 20 = 0 THEN least({day} + 2, {PARTS - 1}) ELSE {day} END AS part FROM source),
    newest AS (SELECT part, max(epoch_ms(ts)) AS ms FROM dealt GROUP BY part),
    told AS (SELECT d.*, (SELECT max(ms) - 600000 FROM newest n WHERE n.part < d.part) AS mark FROM dealt d),
    usable AS (SELECT * FROM told WHERE mark IS NULL OR epoch_us(ts) > mark * 1000),
    closing AS (SELECT max(ms) - 600000 AS mark FROM newest)"""


_CLICKS = "SELECT event_id, ts, user_id, event_id % 7 AS item_id, CASE WHEN event_type = 'click' THEN 'add' ELSE 'remove' END AS action FROM events WHERE event_type IN ('click', 'error')"


def _clicks(fx):
    action = F.when(F.col("event_type") == "click", "add").otherwise("remove")
    return fx.table("events").filter("event_type IN ('click', 'error')").select("event_id", "ts", "user_id", (F.col("event_id") % 7).alias("item_id"), action.alias("action"))


@query(
    "wishlist_keyed",
    f"""WITH {_arrivals_sql(_CLICKS)},
    ready AS (SELECT u.* FROM usable u, closing c WHERE (epoch_us(u.ts) + 999) // 1000 < c.mark),
    lagged AS (SELECT *, lag(action, 1, 'remove') OVER (PARTITION BY user_id, item_id ORDER BY ts, event_id) AS before FROM ready),
    running AS (SELECT user_id, CASE WHEN action = before THEN 0 WHEN action = 'add' THEN 1 ELSE -1 END AS delta, ts, event_id FROM lagged),
    sizes AS (SELECT user_id, delta, sum(delta) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS size FROM running)
    SELECT user_id, CAST(sum(delta) AS BIGINT) AS n_items, CAST(greatest(max(size), 0) AS BIGINT) AS max_items,
           CAST(greatest(max(size), 0) >= 2 AS INTEGER) AS task_completed FROM sizes GROUP BY user_id""",
)
def wishlist_keyed(fx):
    return keyed.wishlist_sizes(fx.spark, _fed(fx, _clicks(fx), keyed.wishlist_lists, "lists"))


@query(
    "late_rows",
    f"""WITH {_arrivals_sql(_CLICKS)}
    SELECT CAST(part AS INTEGER) AS part, count(*) AS input_rows, count(*) FILTER (mark IS NOT NULL AND epoch_us(ts) <= mark * 1000) AS late_rows FROM told GROUP BY part""",
)
def late_rows(fx):
    status = keyed.late_rows(fx.spark, _fed(fx, _clicks(fx), keyed.wishlist_lists, "lists"))
    # a part may be followed by a batch without input, which only moves the watermark
    told = status.groupBy().agg(F.array_sort(F.collect_list(F.struct("batch_id", "input_rows", "late_rows"))).alias("b"))
    return told.select(F.posexplode(F.filter("b", lambda b: b["input_rows"] > 0)).alias("part", "b")).select("part", "b.input_rows", "b.late_rows")


@query(
    "register_keyed",
    f"""WITH {_arrivals_sql("SELECT event_id, ts, 'participant-' || user_id AS participant_id FROM events WHERE event_type = 'signup'")},
    firsts AS (SELECT participant_id, arg_min(ts, (part, ts)) AS first_seen FROM usable GROUP BY participant_id)
    SELECT participant_id, {_GROUP_SQL.format('participant_id')} AS study_group, first_seen FROM firsts""",
)
def register_keyed(fx):
    name = F.concat(F.lit("participant-"), F.col("user_id").cast("string"))
    arrivals = fx.table("events").filter("event_type = 'signup'").select("event_id", "ts", name.alias("participant_id"))
    folder = _fed(fx, arrivals, keyed.registrations, "registrations")
    stored = keyed.current(fx.spark, f"{folder}/participants", ["participant_id"])
    return stored.select("participant_id", "study_group", F.col("ts").cast("timestamp_ntz").alias("first_seen"))


_TTL = 2 * 86_400
_UPDATES = "SELECT event_id, ts, user_id AS item_id, props AS description FROM events"
_CHAIN = f"""RECURSIVE {_arrivals_sql(_UPDATES)},
    ready AS (SELECT DISTINCT u.item_id, u.ts FROM usable u, closing c WHERE (epoch_us(u.ts) + 999) // 1000 < c.mark),
    chain AS (
        SELECT item_id, min(ts) AS ts FROM ready GROUP BY item_id
        UNION ALL
        SELECT item_id, ts FROM (
            SELECT r.item_id, r.ts, row_number() OVER (PARTITION BY r.item_id ORDER BY r.ts) AS place
            FROM chain c JOIN ready r ON r.item_id = c.item_id AND epoch_us(r.ts) > epoch_us(c.ts) + {_TTL * 1_000_000}
        ) WHERE place = 1
    )"""


def _entries(fx):
    updates = fx.table("events").select("event_id", "ts", F.col("user_id").alias("item_id"), F.col("props").alias("description"))

    def start(stream, folder):
        entries = stream.select("item_id", "description", F.lit("").alias("image_url"), F.col("ts").alias("fetched_at"))
        return keyed.metadata_entries(entries, folder, ttl_seconds=_TTL)

    return _fed(fx, updates, start, "entries")


@query("metadata_keyed", f"WITH {_CHAIN} SELECT item_id, max(ts) AS fetched_at FROM chain GROUP BY item_id")
def metadata_keyed(fx):
    stored = keyed.current(fx.spark, f"{_entries(fx)}/metadata", ["item_id"])
    return stored.select("item_id", F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at"))


@query(
    "refresh_requests",
    f"""WITH {_CHAIN}, aged AS (SELECT item_id, ts, ts + INTERVAL {_TTL} SECOND AS stale, lead(ts) OVER (PARTITION BY item_id ORDER BY ts) AS next FROM chain)
    SELECT item_id, stale AS stale_since FROM aged, closing WHERE next IS NOT NULL OR (epoch_us(stale) + 999) // 1000 < mark""",
)
def refresh_requests(fx):
    asked = keyed.refresh_requests(fx.spark, _entries(fx))
    return asked.select("item_id", F.col("stale_since").cast("timestamp_ntz").alias("stale_since"))
